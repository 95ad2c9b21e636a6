import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm.line_join import BLANKS, within, without_repeated_lines

SCHEMA = "doc_id long, text string, id long, key string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, tau, min_chars):
    lines = sorted({x.strip(BLANKS) for _, t in rows for x in (t or "").split("\n")} - {""})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    uses = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in lines], np.int32).reshape(-1, 256)
    for i, a in enumerate(lines):
        # an edit changes two counts of characters by one, of bytes by at most four each
        for j in np.flatnonzero(np.abs(uses[i + 1 :] - uses[i]).sum(axis=1) <= 8 * tau):
            b = lines[i + 1 + j]
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                root[find(b)] = find(a)
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(BLANKS):
                first.setdefault(find(x.strip(BLANKS)), (d, i))
    out = []
    for d, t in rows:
        parts = None if t is None else t.split("\n")
        left = None if t is None else [x for i, x in enumerate(parts) if not x.strip(BLANKS) or first[find(x.strip(BLANKS))] == (d, i)]
        out.append((d, None if t is None else "\n".join(left), sum(bool(x.strip(BLANKS)) for x in parts or []), len(parts or []) - len(left or [])))
    return sorted(out)


def fixture(seed, n=60):
    dice = random.Random(seed)
    base = ["".join(dice.choice("abcdé ") for _ in range(dice.randint(6, 40))) for _ in range(30)]

    def edited(x, k):
        x = list(x)
        for _ in range(k):
            i = dice.randrange(len(x) + 1)
            x[i : i + dice.randint(0, 1)] = dice.choice(["", "z", "y", "é"])
        return "".join(x)

    rows = [(d, "\n".join(dice.choice(["", "  "]) + edited(dice.choice(base), dice.choice([0, 0, 1, 1, 2, 3])) for _ in range(dice.randint(0, 8)))) for d in range(n)]
    return rows + [(500, None), (501, ""), (502, "\n \n"), (503, "x" * 5000), (504, "x" * 5001), (505, "one\none\r\n one")]


@pytest.mark.parametrize("tau,bucket", [(1, 64), (1, 2), (2, 64), (2, 3)])
def test_against_all_pairs(spark, tau, bucket):
    rows = fixture(tau * 10 + bucket)
    got = without_repeated_lines(spark.createDataFrame([(d, t, 1, "k") for d, t in rows], SCHEMA), tau=tau, min_chars=8, bucket=bucket)
    assert got.columns == ["doc_id", "text", "id", "key", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(rows, tau, 8)


def test_two_edits_are_near_and_hot_buckets_split(spark):
    rows = [(1, "permitted provided that the year 2019 holds here"), (2, "permitted provided that the year 2024 holds here"), (3, "permitted provided that the year 2024 helds here")]
    got = without_repeated_lines(spark.createDataFrame([(d, t, 1, "k") for d, t in rows], SCHEMA))
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "", 3: ""}
    rows = fixture(7)
    got = without_repeated_lines(spark.createDataFrame([(d, t, 1, "k") for d, t in rows], SCHEMA), min_chars=8, bucket=2)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(rows, 2, 8)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_automaton_is_the_edit_distance(spark, tau):
    dice = random.Random(tau)
    pairs = []
    for _ in range(400):
        a = "".join(dice.choice("ab") for _ in range(dice.randint(0, 9)))
        b = list(a)
        for _ in range(dice.randint(0, 5)):
            i = dice.randrange(len(b) + 1)
            b[i : i + dice.randint(0, 1)] = dice.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within(F.col("a"), F.col("b"), tau).alias("near")).collect()
    assert [r.near for r in got] == [distance(a, b) <= tau for a, b in pairs]


def test_names_of_the_counts_and_of_helpers_may_be_taken(spark):
    line = "a line of enough characters"
    rows = [(1, line, 7, 8, "r", "g", "l"), (2, line, 7, 8, "r", "g", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, n_removed long, row string, gone string, left string")
    got = without_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "row", "gone", "left", "n_lines", "n_removed"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, line, "r", "g", "l", 1, 0), (2, "", "r", "g", "l", 1, 1)]
    got = without_repeated_lines(docs, counts=("a", "b"))
    assert got.columns == [*docs.columns, "a", "b"] and got.where("b = 1").select("n_removed").collect()[0][0] == 8


def test_null_and_repeated_ids_and_empty_table(spark):
    line = "a line of enough characters"
    got = without_repeated_lines(spark.createDataFrame([(None, line, 0, ""), (4, line, 0, ""), (4, line, 0, ""), (4, f"x\n{line}", 0, "")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("4", line), ("4", line), ("4", "x"), ("None", "")]
    assert without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_one_number_are_judged_apart(spark, monkeypatch):
    monkeypatch.setattr("larder.llm.line_join.number", lambda line: F.pmod(F.xxhash64(line), F.lit(61)))
    dice = random.Random(5)
    base = ["".join(dice.choice("abcdefghij ") for _ in range(dice.randint(20, 40))) for _ in range(40)]
    rows = [(d, "\n".join(x if dice.random() < 0.7 else x[:5] + dice.choice("xyz") + x[6:] for x in dice.sample(base, 4))) for d in range(25)]
    got = without_repeated_lines(spark.createDataFrame([(d, t, 1, "k") for d, t in rows], SCHEMA))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(rows, 2, 20)
