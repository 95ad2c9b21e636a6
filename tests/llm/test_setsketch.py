import random
import re

import numpy as np
import pytest

from larder.llm.common import mix64
from larder.llm.components import components
from larder.llm.setsketch import likely, merge, near_duplicates, registers

SCHEMA = "doc_id long, text string, n long, key string"


def brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


@pytest.mark.parametrize("block", [128, 3])
def test_against_all_pairs(spark, block):
    dice = random.Random(block)
    rows, d = [], 0
    for _ in range(12):  # chains: each text changes a little of the one before, so ends are far apart
        text = [f"w{dice.randint(0, 9999)}" for _ in range(dice.randint(40, 90))]
        for _ in range(dice.randint(1, 9)):
            text = list(text)
            for _ in range(dice.randint(0, 2)):
                text[dice.randrange(len(text))] = f"w{dice.randint(0, 9999)}"
            rows.append((d, " ".join(text)))
            d += 1
    template = [f"t{i}" for i in range(60)]  # alike, though below the limit
    for _ in range(25):
        text = list(template)
        for i in dice.sample(range(60), 5):
            text[i] = f"v{dice.randint(0, 99999)}"
        rows.append((d, " ".join(text)))
        d += 1
    dice.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two  WORDS"), (905, "É two"), (906, "é two"), (907, "a b " * 20000), (908, "b a " * 9000)]
    for words in (4, 5):
        got = near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA), words=words, block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, words, 80)


def test_null_and_repeated_ids_and_empty_table(spark):
    got = near_duplicates(spark.createDataFrame([(None, "a b c d e f", 0, ""), (4, "A b c d e f", 0, ""), (4, "A b c d e f", 0, "")], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == ["(4, 2, 4, True)", "(4, 2, 4, True)", "(None, 2, 4, False)"]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_estimate_and_merge():
    x = mix64(np.arange(4000, dtype=np.uint64) * np.uint64(77777))
    a, b, c = registers(x[:3000], 128), registers(x[300:3000], 128), registers(x[1500:], 128)
    assert (merge(b, a) == a).all() and (merge(a, c) == registers(x, 128)).all()
    n = lambda *s: np.array(s, float)
    assert likely(np.stack((a, a)), np.stack((b, c)), n(3000, 3000), n(2700, 2500), 80).tolist() == [True, False]


def test_components_of_a_long_path(spark):
    dice = random.Random(5)
    names = dice.sample(range(10_000), 300)
    links = [(names[i], names[i + 1]) for i in range(0, 199)] + [(names[200], names[i]) for i in range(201, 300)] + [(5, 5)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(names[:200]) if i < 200 else min(names[200:]) for i, n in enumerate(names)}


def test_words_that_a_polynomial_would_confuse(spark):
    signs = [0]
    while len(signs) < 1024:
        signs += [1 - x for x in signs]
    rows = [(1, "".join("ab"[x] for x in signs)), (2, "".join("ba"[x] for x in signs))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True)}


def test_long_words_in_any_partitioning(spark):
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(11))
    text = [word() for _ in range(64)]
    rows = [(1, " ".join(text[:63])), (2, " ".join(text)), (5, " ".join(text[:30])), (6, " ".join(text[:30]))]
    rows += [(10 + i, " ".join(word() + "x" * dice.randint(0, 30) for _ in range(dice.randint(1, 99)))) for i in range(40)]
    rows += [(100 + d, t + " tail") for d, t in rows]
    want = brute(rows, 4, 80)
    assert {x[0]: x[2] for x in want}[2] == 1 and {x[0]: x[2] for x in want}[6] == 5
    for parts in (1, 2, 16):
        df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(parts)
        assert sorted(map(tuple, near_duplicates(df, words=4).collect())) == want
