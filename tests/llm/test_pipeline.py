import base64

import public_tokenizers as P
import pyarrow as pa
import tiktoken

from corpus_pipeline import STAGES, run
from larder.llm.common import BATCH_KEY, cut, read_table, small_batches
from tests.llm.test_line_join import brute as brute_lines
from tests.llm.test_setsketch import brute as brute_sets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cut(stage(spark, docs, SF))
        kept.append((name, before, docs.collect()))
        assert name == "byte_bpe" or docs.columns == columns
    (_, all_docs, known), (_, _, lines), (_, _, sets), (_, _, clean), (_, last, encoded) = kept
    assert {r.doc_id for r in known} >= {d for d, t in all_docs.items() if t and len(t.split()) > 3}
    want = {d: t for d, t, n, gone in brute_lines([(r.doc_id, r.text) for r in known], 2, 20) if not n or gone < n}
    assert {r.doc_id: r.text for r in lines} == want
    groups = brute_sets([(r.doc_id, r.text) for r in lines], 5, 80)
    assert {r.doc_id for r in sets} == {d for d, _, _, keep in groups if keep}
    items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in sets if any(i in r.text for i in items)}.isdisjoint({r.doc_id for r in clean}) and len(clean) > 0.8 * len(sets)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in encoded} == {d: len(library.encode_ordinary(t)) for d, t in last.items()}


def test_run_gives_the_same(spark):
    assert run(spark, SF).count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, n_lines long, n_removed long, part string"


def odd_rows():
    voices = {"xx": "ba be bi bo bu bam bem bim bom bum", "yy": "kra kre kri kro kru krak krek krik krok kruk"}
    rows = [(i, " ".join(voices[v].split()[(i * j) % 10] + "aeiou"[j % 5] for j in range(1, 60)), v, "s", 1, "r", 1, 1, "p") for i in range(1, 40) for v in ("xx", "yy")]
    rows = [(2 * r[0] + (r[2] == "yy"), *r[1:]) for r in rows]
    text = "bam bem bim bom bum ba be bi bo bu " * 3 + "once"
    rows += [(None, text, "xx", None, None, None, None, None, None)] * 2 + [(500, text, "xx", "s", 1, "r", 1, 1, "p")] * 2
    other = "kru krak krek krik krok kruk kra kre kri kro " * 3
    rows += [(500, other + "twice", "yy", "s", 1, "r", 1, 1, "p"), (None, other + "here and there it ends otherwise altogether krik", None, None, None, None, None, None, None)]
    return rows + [(600, None, "xx", "s", 1, "r", 1, 1, "p"), (601, "", None, "s", 1, "r", 1, 1, "p"), (602, "½ 12 !", "yy", "s", 1, "r", 1, 1, "p"), (603, "kra " * 30_000, "yy", "s", 1, "r", 1, 1, "p")]


def test_odd_rows_and_clashing_names_in_every_stage(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    stages = dict(STAGES)
    known = stages["language_id"](spark, docs, SF)
    ids = [r.doc_id for r in known.collect()]
    assert known.columns == docs.columns and {600, 601, 602}.isdisjoint(ids) and {603, None, 500} <= set(ids)
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns
    left = lines.collect()
    # the row of doc 500 and its repeat are one document, whose line comes first; those without an id lose it and go
    assert sum(r.doc_id == 500 for r in left) == 3 and sum(r.doc_id is None for r in left) == 1
    assert {600, 601} <= {r.doc_id for r in left} and all(r.n_lines == 1 for r in left if r.doc_id == 500)
    sets = stages["near_dedup"](spark, docs, SF)
    left = sets.collect()
    assert sets.columns == docs.columns and sum(r.doc_id == 500 for r in left) == 2 and sum(r.doc_id is None for r in left) == 1
    assert {600, 601, 602, 603} <= {r.doc_id for r in left}
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    encoded = stages["byte_bpe"](spark, docs, SF).collect()
    assert len(encoded) == docs.count() and {r.n_tokens for r in encoded if r.doc_id in (600, 601)} == {0}


def test_empty_table_in_every_stage(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "byte_bpe" or got.columns == docs.columns)


def test_stages_hand_tasks_few_texts_at_a_time(spark):
    docs = spark.createDataFrame([(i, "kra " * 25_000) for i in range(100)], "doc_id long, text string").repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for before, most in (("64m", 4 << 20), ("1m", 1 << 20)):  # a smaller limit of the session's own stays
        spark.conf.set(BATCH_KEY, before)
        dict(STAGES)["byte_bpe"](spark, docs, SF)
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 10_000_000 and max(got) < most + 200_000
    spark.conf.set(BATCH_KEY, "64m")
    small_batches(spark, 1 << 30)
    assert spark.conf.get(BATCH_KEY) == "64m"
    spark.conf.unset(BATCH_KEY)
