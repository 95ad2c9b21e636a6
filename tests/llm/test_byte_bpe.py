import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm.byte_bpe import bpe, decode, encode_decode

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", "it's  a\x1c\x1cb 12 ½²  \n\n x", "a" * 30000, "日本語 tekst 🎉🎉", "日本語 tekst 🎉🎉", " \n\t ", "<|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merges_like_the_library(word):
    assert bpe(word, RANKS) == ENCODING._encode_single_piece(word)


@pytest.mark.parametrize("block_chars,part_chars", [(24_000_000, 1_000_000), (10, 5)])
def test_texts_as_the_library_encodes_them(spark, block_chars, part_chars):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), PATH, P.PATTERN, digest=False, block_chars=block_chars, part_chars=part_chars).collect()
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in got} == {d: (len(i := ENCODING.encode_ordinary(t or "")), " ".join(map(str, i)), t or "") for d, t, _ in rows}


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_decode_joins_the_token_table(spark):
    text = "Some ids, décodés 🎉"
    ids = spark.createDataFrame([(7, i, t) for i, t in enumerate(ENCODING.encode_ordinary(text))], "doc_id long, pos long, id int")
    assert decode(ids.orderBy(F.desc("pos")), PATH).first().data.decode() == text
