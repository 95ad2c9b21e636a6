import hashlib
import random

import pytest

from larder.llm.anchors import word_items
from larder.llm.debruijn import confirmed, remove_repeats

SCHEMA = "doc_id long, text string, anchor string, h string"


def brute(rows, window):
    """Every window of every text against the smallest doc_id that has it."""
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def run(spark, rows, parts=None, **options):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    df = df.repartition(parts) if parts else df
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed):
    dice = random.Random(seed)
    words = ["ab", "c", "dé", "e,", "ff", "\x85x", "g\xa0h"]
    shared = [[dice.choice(words) for _ in range(dice.randint(8, 60))] for _ in range(4)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(dice.randint(0, 6)):
            text += dice.choice(shared) if dice.random() < 0.5 else [dice.choice(words) for _ in range(dice.randint(1, 30))]
        rows.append((d, dice.choice([" ", "\n", " \t"]).join(text)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " tail"), (102, None), (103, ""), (104, " \n "), (105, "a " * 3000), (106, "a " * 100)]
    for window, k in ((10, 3), (20, 8)):
        assert run(spark, rows, window=window, k=k) == brute(rows, window)


def test_repeated_ids_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = run(spark, [(3, text), (3, text), (7, text + " z")], window=10, k=3)
    assert [x[:3] for x in got] == [(3, 30, 0), (3, 30, 0), (7, 31, 30)]
    got = remove_repeats(spark.createDataFrame([(None, text, "", ""), (4, text, "", "")], SCHEMA), window=10, k=3).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, 30), (4, 0)}


def test_branching_contents_that_repeat_inside_a_document(spark):
    for seed in range(3):
        dice = random.Random(seed)
        p, x, y, u, v = ([f"w{dice.randrange(10**6)}" for _ in range(n)] for n in (80, 60, 60, 60, 60))
        rows = [(3, " ".join(u + p + v)), (5, " ".join(2 * (x + p + y))), (9, " ".join(y + 3 * (x + p)))]
        got = run(spark, rows, window=50, k=8)
        assert got == brute(rows, 50) and got[1][2] == 160


def test_empty_table(spark):
    assert run(spark, []) == []


def long_words(dice, n):
    return ["".join(dice.choice("abcdeé") for _ in range(dice.randint(1, 40))) for _ in range(n)]


def test_a_words_hash_is_its_own():
    dice = random.Random(3)
    words = [w.encode() for w in long_words(dice, 300)] + [b"x" * n for n in range(1, 100)]
    alone = [int(word_items([w])[0][0]) for w in words]
    assert len(set(alone)) == len(set(words))
    for texts in ([b" ".join(words)], [b" ".join(words[i::7]) for i in range(7)], words):
        h, _ = word_items(texts)
        assert dict(zip([w for t in texts for w in t.split()], h.tolist())) == dict(zip(words, alone))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_words_of_all_lengths_in_any_partitioning(spark, parts):
    dice = random.Random(11)
    shared = [long_words(dice, dice.randint(15, 80)) for _ in range(5)]
    rows = [(d, " ".join(sum((dice.choice(shared) if dice.random() < 0.5 else long_words(dice, dice.randint(1, 90)) for _ in range(dice.randint(1, 5))), []))) for d in range(60)]
    assert run(spark, rows, parts, window=10, k=3) == brute(rows, 10)


def test_a_span_without_its_words_is_an_error():
    with pytest.raises(ValueError):
        confirmed(b"a b c d", [{"first": 0, "last": 1, "h": 5}], 2)
    with pytest.raises(ValueError):
        confirmed(b"a b c d", [{"first": 3, "last": 3, "h": 5}], 2)


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    got = run(spark, [(1, a), (3, a + " z"), (3, b), (7, b + " " + a)], window=10, k=3)
    assert [x[:3] for x in got] == [(1, 30, 0), (3, 30, 0), (3, 31, 30), (7, 60, 60)]
