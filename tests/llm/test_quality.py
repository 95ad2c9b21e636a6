import re
import sys
import zlib
from collections import Counter

import numpy as np

from larder.llm.quality import LABELLERS, Features, classify, fit_labels, train, votes
from larder.llm.queries import op3_quality_classifier


def test_agrees_with_labels(spark):
    got = op3_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.97 * len(got)


def test_label_model_learns_accuracies():
    counts = {"222": 800, "022": 30, "220": 30, "200": 20, "002": 20, "000": 90, "020": 10, "111": 5}
    posterior, accuracy, share = fit_labels(counts)
    assert posterior["222"] > 0.95 and posterior["000"] < 0.05 and 0.8 < share < 0.95 and (accuracy > 0.8).all()


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, kept string"
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " \n ", "", ""), (None, "A fine text of words.", "", ""), (5, "$$$ " * 30000, "", ""), (5, "A fine text of words.", "", "")]
    got = classify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.score == 0.0} >= {1, 2, 3} and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    empty = spark.createDataFrame([], schema)
    assert classify(empty).count() == 0 and train(empty)[1] == {}
    assert len(LABELLERS) == 10


ODD = [b"", b" \n\x0b", b"x", b"$$$ " * 300, "Größe Größe 12ab34 ABCdef\n\nend.".encode(), bytes(range(1, 128)) * 3, b"one one two! #tag A1B22CC " * 40, b"word"]


def steps(f) -> int:
    """How many lines of Python f runs."""
    n = 0

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        f()
    finally:
        sys.settrace(before)
    return n


def test_features_follow_their_definition():
    for most in (300_000, 0):
        features = Features(16, most)
        for text, (index, value) in zip(ODD * 2, [*features.of(ODD), *features.of(ODD)], strict=True):
            words = text.split()
            own = Counter(zlib.crc32(w.lower(), 1) & 65535 for w in words)
            shapes = Counter(zlib.crc32(re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Z]{2,}", b"AA", w)))[:12], 2) & 65535 for w in words)
            sure, n = len(words) / (len(words) + 10), max(1, len(words))
            x = [0.3 * sure * np.sqrt(own[i] / n) for i in sorted(own)] + [sure * np.sqrt(shapes[i] / n) for i in sorted(shapes)]
            x = np.array([*x, 2 * sure * np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n)])
            assert index.tolist() == [*sorted(own), *sorted(shapes), zlib.crc32(b"repeat", 3) & 65535]
            assert np.allclose(value, x / np.sqrt((x * x).sum() + 0.25), rtol=1e-12, atol=0)


def test_marked_words_vote():
    at = LABELLERS.index("marked_words")
    for text in ODD[2:]:
        words = text.split()
        share = sum(w[-1:] in b"#$%&*|!" or not w[:1].isalnum() and w[0] < 128 for w in words) / len(words)
        assert votes(text)[at] == (-1 if share >= 0.4 else 0)


def test_no_python_step_for_each_word():
    text = b"a few words again and again, " * 4000
    assert steps(lambda: votes(text)) < 500 and steps(lambda: list(Features(16).of([text]))) < 500
