"""Forward sums against all segmentations; the query's accuracy on the held-out fold."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from pressroute.llm.bpe import vocabulary
from pressroute.llm.language_id import WordScores, expected_pieces, identify_language, letter_words, train_language_model
from pressroute.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BASE = "/root/testdata/sf0.01"


def segmentations(data, ranks):
    if not data:
        yield []
    for cut in range(1, len(data) + 1):
        if (piece := ranks.get(data[:cut])) is not None:
            for rest in segmentations(data[cut:], ranks):
                yield [piece, *rest]


def test_forward_sum_and_expected_uses_equal_enumeration():
    voc = vocabulary(PATH)
    table = np.random.default_rng(1).random((2, len(voc.tokens)))
    table /= table.sum(axis=1, keepdims=True)
    scores = WordScores(PATH, table)
    for word in ["the", "été", "nicht", "zuä"]:
        data = f" {word}".encode()
        ways = list(segmentations(data, voc.ranks))
        assert len(ways) > 3
        for lang in range(2):
            each = [math.prod(table[lang, p] for p in way) for way in ways]
            assert scores.score(data)[lang] == pytest.approx(math.log(sum(each)))
            assert scores._score_long(data)[lang] == pytest.approx(math.log(sum(each)))
            uses = expected_pieces(word, table[lang].tolist(), voc)
            piece = ways[0][0]
            want = sum(p * way.count(piece) for p, way in zip(each, ways)) / sum(each)
            assert uses[piece] == pytest.approx(want)
    long = "abc" * 40
    assert sum(expected_pieces(long, table[0].tolist(), voc).values()) > 10
    assert math.isfinite(scores.score(f" {long}".encode())[0])


def test_held_out_rows_and_fold(spark):
    got = {r.doc_id: r for r in LLM_QUERIES["op3_language_id"](spark, BASE).collect()}
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert {d.doc_id for d in held} == {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der Hund und die Katze", "de", "x"), (2, "der Hund und die Katze", "de", "x"),
            (3, None, "de", "x"), (4, "", "en", "x"), (5, "123 ½ !!", None, "x"), (None, "the dog", None, "x"), (7, "the " * 60_000 + "y" * 5000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score string")
    model = train_language_model(docs, PATH)
    assert model.languages == ["de", "en"]
    got = sorted(((r.doc_id, r.lang_pred) for r in identify_language(docs, model, keep=["doc_id"]).collect()), key=repr)
    assert got == sorted([(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "en")], key=repr)
    assert identify_language(docs.where("false"), model, keep=["doc_id"]).count() == 0
    nothing = train_language_model(docs.where("lang is null"), PATH)
    assert {r.lang_pred for r in identify_language(docs, nothing).collect()} == {"und"}
    assert letter_words("½²") == []
