import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larder.llm.maxscore import KINDS, Lists, Shard, competitive, pack, ranked, search, terms_of, unpack

SCHEMA = "rank int, doc_id long, text string, score string"
ITEMS = "item_id long, text string, doc_id long, term string"


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    own = [(d, Counter(split(t))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in own:
            m = 75 + 25 * size * n // total
            found.append((sum(u * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, u in Counter(split(text)).items() if c[t]), d))
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found)]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, **options):
    found = ranked(spark.createDataFrame([(1, d, t, "x") for d, t in docs], SCHEMA).repartition(parts), spark.createDataFrame([(i, t, 5, "y") for i, t in items], ITEMS), **options)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(dice, n):
    words = [f"w{i}" for i in range(300)]
    return [(d, " ".join(words[min(299, int(dice.paretovariate(0.6)) - 1)] for _ in range(dice.randint(1, 80)))) for d in range(n)]


def test_terms():
    text = "Ab-9é\x80  x\x00y_Z ÀB {q}"
    assert [t.decode() for t in terms_of(text.encode())] == split(text)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000, "block": 4, "queries": 3}])
def test_against_all_scores(spark, options):
    dice = random.Random(2)
    docs = corpus(dice, 400) + [(1000 + i, "w1 w2 w250") for i in range(40)]  # ties
    docs += [(None, "w1 w2 w250"), (2000, None), (2001, ""), (2002, " -- "), (2003, "W7 w7 É é ß w250"), (2004, "w3 " * 30_000), (2005, "w250 w250"), (2005, "w250 w250")]
    items = [(i, " ".join(f"w{int(dice.paretovariate(0.5)) - 1}" for _ in range(dice.randint(1, 30)))) for i in range(12)]
    items += [(100, "W250 w1 w2 w2"), (101, None), (102, ""), (103, "unheard-of"), (100, "é w7 w250"), (None, "w250"), (104, "w3")]
    assert run(spark, docs, items, **options) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], []) == run(spark, [(1, " ")], [(1, "a")])


def test_blocks():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 2**20):
        docs, tf = np.unique(rng.integers(0, top + 1, 128)), None
        tf = rng.integers(1, top + 1, len(docs))
        d, c = unpack(int(docs[0]), pack(docs, tf))
        assert (d == docs).all() and (c == tf).all()
    assert competitive(np.array([1, 3, 3, 2, 5]), np.array([4, 9, 7, 8, 30])) == [5, 30, 3, 7, 1, 4]


def test_blocks_are_rejected_unread():
    """A frequent and a rare term: the frequent one's blocks without the rare term's documents stay packed."""
    shard = Shard(b"\x01" * (1 << 23))
    dice = random.Random(4)
    for d in range(20_000):
        shard.add(d, b"common " * dice.randint(1, 3) + (b"rare rare" if d < 40 or d == 15_000 else b"other"))
    rows = pa.Table.from_batches(list(shard.rows(0, 128)), KINDS)
    sizes = np.array(rows.column("sizes")[0].as_py())
    lists = Lists(rows.slice(1), sizes, len(sizes), int(sizes.sum()))
    terms = rows.column("term").to_pylist()[1:]
    docs, found = search(lists, np.array([terms.index(b"common"), terms.index(b"rare")]), np.array([10, 9000]), 20)
    assert len(docs) == 20 and (np.diff(found) <= 0).all() and lists.unpacked < 20 < len(lists.tops)
