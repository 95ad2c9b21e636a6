import numpy as np
import pytest

from larder.llm.itq import near_links, unit
from larder.llm.queries import op1_embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, rep long, n string"


def brute(ids, x, cosine=0.9):
    x = unit(x)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    ids = np.array(ids)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), label)}
        label = new


@pytest.mark.parametrize("block", [1024, 7])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 30), 24)) * 0.18 for c in centres])
    x = np.concatenate((x, x[:5], x[:5] * 3.0))
    ids = rng.permutation(len(x) * 2)[: len(x)].tolist()
    got = near_links(spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in zip(ids, x)], SCHEMA), block=block).collect()
    want = brute(ids, x)
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got)
    assert len(got) == len(ids) and links > 500 and 0.98 * links <= found <= links
    assert all(r.n_links <= want[r.vec_id][0] and r.kept == (r.vec_id == r.component_id) for r in got)
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) > 0.97


def test_each_length_has_its_tables(spark):
    """Vectors of floats in three lengths; each length links as it would alone, and copies over several tables count once."""
    rng = np.random.default_rng(5)
    parts, rows = [], []
    for n, d in ((300, 16), (200, 24), (5, 8)):
        x = (np.repeat(rng.standard_normal((n // 5, d)), 5, axis=0) + rng.standard_normal((n, d)) * 0.1).astype(np.float32)
        ids = list(range(len(rows), len(rows) + n))
        parts.append(brute(ids, x.astype(float)))
        rows += [(i, v.tolist(), 0, "") for i, v in zip(ids, x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_links(spark.createDataFrame(rows, SCHEMA.replace("double", "float")), block=32).collect()}
    for want in parts:
        links, found = sum(n for n, _ in want.values()), sum(got[i][0] for i in want)
        assert 0.98 * links <= found <= links and np.mean([got[i] == w for i, w in want.items()]) > 0.97


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {r.vec_id: (r.n_links, r.component_id) for r in op1_embedding_dedup(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (None, [1.0, 1.0]), (9, [1e300, 1e300]), (10, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_links(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)).collect()}
    assert {i: x[0] for i, x in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 3, 8: 3, None: 3, 9: 3, 10: 0}
    assert got[9] == (3, 7, False) and got[7] == (3, 7, True) and got[None][1] == 7 and got[1] == (0, 1, True)
    for bad in ([], [(1, None, 0, ""), (2, [], 0, "")]):
        assert near_links(spark.createDataFrame(bad, SCHEMA)).count() == len(bad)
