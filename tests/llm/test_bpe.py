"""Encoding against the tiktoken library; appends, edits and decoding."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from pressroute.llm.bpe import PrefixTable, TextEncoder, bpe_decode, bpe_encode, vocabulary
from pressroute.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "1", "é", "中", "\x1c", "　", ".", ", ", "\xa0", "\x00", "😀", "ing"]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(PATH).ranks, special_tokens={})


def test_random_texts_equal_the_library(tik):
    rng, encode = random.Random(3), TextEncoder(PATH, public_tokenizers.PATTERN)
    for _ in range(5000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        assert array("I", encode(text)).tolist() == tik.encode_ordinary(text), repr(text)


def test_appends_and_edits_equal_a_fresh_encoding(tik):
    rng, voc = random.Random(4), vocabulary(PATH)
    for _ in range(500):
        data = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 80))).encode()
        table, start = PrefixTable(voc, data), rng.randint(0, len(data))
        stop, new = rng.randint(start, len(data)), rng.choice(BITS).encode()
        table.replace(start, stop, new)
        assert table.ids() == PrefixTable(voc, data[:start] + new + data[stop:]).ids()
        assert not table.data or voc.encode(table.data) == table.ids()
        table.append(b" end")
        whole = data[:start] + new + data[stop:] + b" end"
        assert table.ids() == tik._core_bpe.encode_single_piece(whole)


def test_an_edit_in_a_long_piece_stays_local():
    table = PrefixTable(vocabulary(PATH), b"abcdefgh" * 5000)
    assert table.replace(20000, 20001, b"x") < 500
    assert table.ids() == PrefixTable(vocabulary(PATH), table.data).ids()


def test_null_empty_long_repeated_rows_and_extra_columns(spark, tik):
    long = "word " * 40_000 + "x" * 20_000
    rows = [(1, None, "i"), (2, "", "i"), (3, "one two", "i"), (3, "one two", "i"), (None, "one", "i"), (5, long, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe_encode(docs, PATH, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, bytes(r.ids)) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, array("I", tik.encode_ordinary(t or "")).tobytes()) for i, t, _ in rows), key=repr)
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in bpe_decode(encoded, PATH, ["doc_id"]).collect()), key=repr)
    assert back == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=repr)
    assert bpe_encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library(spark, tik):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    for r in LLM_QUERIES["op6_bpe_prefix_dp"](spark, base).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
