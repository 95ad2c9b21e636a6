import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larder.llm.rlbwt import RunLengthIndex, remove_repeats

SCHEMA = "doc_id long, text string, anchor long, h string"


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    uses = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if uses[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **options).collect()), key=str)


def fixture(seed):
    dice = random.Random(seed)
    shared = ["".join(dice.choice("abcé \n") for _ in range(dice.randint(20, 200))) for _ in range(5)]
    rows = []
    for d in range(60):
        parts = [dice.choice(shared) if dice.random() < 0.5 else "".join(dice.choice("abcdefgh") for _ in range(dice.randint(1, 90))) for _ in range(dice.randint(0, 5))]
        rows.append((d, "".join(parts)))
    return rows + [(100, rows[7][1]), (101, rows[7][1] + "x"), (102, None), (103, ""), (104, "a" * 2500), (105, "ab" * 600), (None, rows[9][1]), (7, rows[3][1] + "!"), (7, rows[3][1] + "!")]


@pytest.mark.parametrize("most_contents", [512, 1])
def test_against_every_string(spark, most_contents):
    rows = fixture(most_contents)
    assert run(spark, rows, window=30, k=6, shard_bytes=3000, most_contents=most_contents) == brute(rows, 30)
    assert run(spark, rows, window=64, k=16, most_contents=most_contents) == brute(rows, 64)


def test_index_is_a_bwt():
    contents = [b"banana", b"bandana", b"ananas", b"xyz", b""]
    index = RunLengthIndex.build(contents, 3)
    text = np.concatenate([[*(np.frombuffer(c, np.uint8).astype(int) + 5), i] for i, c in enumerate(contents)]).astype(int)
    suffixes = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    bwt = [int(text[i - 1]) for i in suffixes]
    sizes = np.diff([*index.run_starts, len(text)])
    assert np.repeat(index.run_heads, sizes).tolist() == bwt
    assert index.run_end_samples.tolist() == [suffixes[i] for i in np.cumsum(sizes) - 1]
    got = index.long_matches(np.array([len(c) for c in contents]))
    subs = Counter(c[i : i + 3] for c in contents for i in range(len(c) - 2))
    assert [x.tolist() for x in got] == [[i for i in range(len(c) - 2) if subs[c[i : i + 3]] > 1] for c in contents]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_table_at_the_registered_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 400)
    assert run(spark, rows) == want and run(spark, rows, most_contents=1) == want and sum(r[2] for r in want) > 0


def test_matching_statistics_are_the_longest_matches():
    dice = random.Random(5)
    for _ in range(20):
        contents = [bytes(dice.choice(b"ab\0") for _ in range(dice.randint(0, 25))) for _ in range(6)]
        got = RunLengthIndex.build(contents, 3).matching_statistics(sum(len(c) + 1 for c in contents))
        suffixes = [c[i:] for c in contents for i in range(len(c) + 1)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got.tolist() == [max(common(x, y) for j, y in enumerate(suffixes) if i != j) for i, x in enumerate(suffixes)]
