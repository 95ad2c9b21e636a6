"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .oracles import EMBEDDING_DEDUP, HARD_NEGATIVES, NEAR_DEDUP, RANKED_SEARCH, SUBSTRING_DEDUP


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import near_links

    return near_links(read_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlbwt import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and the hash of the text left."""
    from pyspark.sql import functions as F

    from .line_join import without_repeated_lines

    cleaned = without_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that it leaks."""
    from .bm25 import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_diff import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_decode

    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kronecker import hard_negatives, moved_labels

    return hard_negatives(moved_labels(read_table(spark, sf_dir, "embeddings")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import ranked

    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels come from words of the host name; the trees see its features, never its words."""
    from .url_filter import filter_urls, seed_labels

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, seed_labels(pages))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_substring_dedup, op3_quality_classifier, op4_suffix_dedup, op5_line_dedup, op6_language_id, op7_decontamination,
        op8_html_extraction, op9_byte_bpe, op10_minhash_dedup, op11_hard_negatives, op12_ranked_search, op13_url_filters,
    )
}
ORACLE_SQL = {"op1_embedding_dedup": EMBEDDING_DEDUP, "op2_substring_dedup": SUBSTRING_DEDUP, "op10_minhash_dedup": NEAR_DEDUP, "op11_hard_negatives": HARD_NEGATIVES, "op12_ranked_search": RANKED_SEARCH}
