import math
import random

import numpy as np
import pytest

from larder.llm.langid import entries, identify, keep_known, train
from larder.llm.queries import op6_language_id

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_held_out_accuracy(spark):
    got = op6_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in got if r.held_out and r.lang is not None]
    assert len(got) == 200 and sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    dice = random.Random(3)
    voices = {"xx": "ba be bi bo bu bam".split(), "yy": "kra kre kri kro kru krak".split()}
    rows = [(i, " ".join(dice.choice(voices[v]) for _ in range(30)), v, "s", "s") for i in range(60) for v in ("xx", "yy")]
    rows += [(900, None, "xx", "s", "s"), (901, "", None, None, None), (902, "12 !? 34", "yy", "s", "s"), (None, "BA be bobam", None, "s", "s"), (904, "krikrak kre", None, "s", "s"), (905, "kra " * 50000, None, "s", "s"), (906, "日本語", None, "s", "s"), (907, "½ ² 12", None, "s", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(df).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 907)] == ["und"] * 4 and got[900].score == 0
    assert got[None].lang_pred == "xx" and got[904].lang_pred == "yy" and got[905].lang_pred == "yy"
    assert got[906].lang_pred == "xx" and got[906].score == 0.5
    kept = keep_known(df, train(df), 0.6)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "some words", None, "s", "s")], SCHEMA)
    assert [tuple(r)[2:] for r in identify(df).collect()] == [("und", 0.0)]
    assert identify(df.limit(0)).count() == 0


def test_model_against_plain_counts(spark):
    """Words and n-grams counted by hand give the model's logs, and the fixture's predictions follow from them."""
    rows = [(1, "ab ab ba", "xx", "", ""), (2, "ab cd", "yy", "", "")]
    model = train(spark.createDataFrame(rows, SCHEMA), longest=2)
    plain = {}
    for _, text, lang, _, _ in rows:
        for word in text.split():
            for n, gram in [(0, word), *((1, c) for c in word), *((2, f" {word} "[i : i + 2]) for i in range(3))]:
                plain.setdefault((n, gram), [0, 0])["xy".index(lang[0])] += 1
    totals = [[sum(v[j] for (m, _), v in plain.items() if m == n) for j in (0, 1)] for n in range(3)]
    sizes = [sum(m == n for m, _ in plain) for n in range(3)]
    for (n, gram), uses in plain.items():
        logs = [math.log((u + 0.5) / (t + 0.5 * (sizes[n] + 1))) for u, t in zip(uses, totals[n])]
        top = math.log(sum(map(math.exp, logs)))
        key = entries([gram], n)[1] if n < 2 else {f" {w} "[i : i + 2]: k for w in ("ab", "ba", "cd") for i, k in enumerate(entries([w], 2)[1])}[gram]
        assert [float(x) for x in model.logs[model.places(np.atleast_1d(key))[0]]] == pytest.approx([x - top for x in logs], abs=1e-5)
    assert len(model.keys) == len(plain)


def test_one_repeated_or_null_doc_id_still_trains(spark):
    rows = [(None, f"ba be {i}", "xx", "", "") for i in range(20)] + [(None, f"kra kri {i}", "yy", "", "") for i in range(20)]
    model = train(spark.createDataFrame(rows, SCHEMA), sample_docs=10)
    assert model.langs == ["xx", "yy"] and 0 < len(model.keys)
