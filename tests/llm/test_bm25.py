import random
from collections import Counter

import numpy as np

from larder.llm.bm25 import B, K1, Index, Matcher, leaks, question_and_answer, without_leaks, words_of

DOCS = "doc_id long, text string, item_id long, score string"


def brute_scores(items, passage):
    """Scores over threshold of all items, by the formula."""
    split = [words_of(t) for _, t in items]
    df, mean = Counter(w for x in split for w in set(x)), np.mean([len(x) for x in split])
    out = []
    for x in split:
        weight = {w: np.log1p((len(split) - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for w, c in Counter(x).items()}
        out.append(sum(v for w, v in weight.items() if w in passage) / (0.6 * sum(weight.values())))
    return df, mean, out


def test_wand_loses_nothing():
    dice = random.Random(2)
    items = [(i, " ".join(f"w{int(dice.paretovariate(0.5)) % 400}" for _ in range(dice.randint(1, 30)))) for i in range(150)]
    for _ in range(60):
        passage = {f"w{dice.randint(0, 400)}" for _ in range(dice.randint(5, 250))}
        df, mean, want = brute_scores(items, passage)
        index = Index.build(items, df, len(items), mean, 0.6, 5)
        terms = np.array(sorted(index.terms[w] for w in passage if w in index.terms), int)
        got = Matcher(index, 0.7).scores(terms, np.arange(-(-len(items) // 4))) if len(terms) else {}
        assert sorted(got) == [i for i, s in enumerate(want) if s >= 1 - 1e-9]
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
        live = np.flatnonzero(index.hopeful(terms)) if len(terms) else terms
        assert not len(terms) or Matcher(index, 0.7).scores(terms, live) == got


def test_planted_items_are_found_and_others_left(spark):
    dice = random.Random(4)
    text = lambda n: " ".join(f"w{dice.randint(0, 3000)}" for _ in range(n))
    items = [(i, text(dice.randint(8, 60))) for i in range(90)] + [(90, "What is it? The answer"), (91, None), (92, " .. ")]
    rows, want = [], set()
    for d in range(200):
        body = text(dice.randint(0, 900)).split()
        if d % 4 == 0:
            item = dice.choice(items[:90])
            at = dice.randint(0, len(body))
            body[at:at] = item[1].upper().replace(" ", ",\n").split(" ")
            want.add((d, item[0]))
        if d % 4 == 1:  # the question alone
            body += question_and_answer(items[3][1])[0]
        rows.append((d, " ".join(body), 0, "x"))
    rows += [(900, None, 0, ""), (901, "", 0, ""), (None, "so: what is it? the ANSWER.", 0, "")]
    want.add((None, 90))
    docs, tests = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for shard_chars in (8_000_000, 5_000):
        got = {(r.doc_id, r.item_id) for r in leaks(docs, tests, shard_chars=shard_chars).collect()}
        assert got == want
        kept = without_leaks(docs, tests, shard_chars=shard_chars)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_empty_tables(spark):
    docs, tests = spark.createDataFrame([(1, "a b", 0, "")], DOCS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(docs.limit(0), tests).count() == 0 and leaks(docs, tests.limit(0)).count() == 0 and without_leaks(docs, tests.limit(0)).count() == 1
