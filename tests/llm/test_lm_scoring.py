"""Base scores against brute force; the filter against exact counts; blocks against one filter."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pressroute.llm import lm_scoring as lm
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.001"


def brute(docs, training):
    counts = Counter(t for text in training for t in lm.words_of((text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        tokens = lm.words_of((text or "").encode())
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    return out, counts, n, v


def exact_model(text, training, counts, n, v):
    """The model with quantised exact counts in place of the filter."""
    pairs = Counter()
    for t in training:
        own = lm.words_of((t or "").encode())
        pairs.update(zip([b"\n", *own], own))
    near = lambda c: float(lm.count_of_level(lm.levels(np.array([c])))[0])
    own, total = lm.words_of((text or "").encode()), 0.0
    for before, word in zip([b"\n", *own], own):
        pair, seen = near(pairs[before, word]), near(counts[before])
        total += math.log10((min(pair, seen) + lm.PRIOR * (near(counts[word]) + 0.5) / (n + 0.5 * (v + 1))) / (seen + lm.PRIOR))
    return total


@pytest.mark.parametrize("common", [0, 50, 300_000])
def test_query_base_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    want, counts, n, v = brute(docs, training)
    got = {r.doc_id: r for r in LLM_QUERIES["op10_bloom_lm"](spark, BASE).collect()}
    texts = dict(docs)
    for i, tokens, known, n, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    near = [abs(got[i].score / exact_model(texts[i], training, counts, n, v) - 1) for i, *_ in want[:40]]
    assert max(near) < 0.1 and sum(near) / len(near) < 0.02


def test_levels_never_fall_short():
    rng = random.Random(5)
    grams = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    counts = np.array([1 + int(rng.paretovariate(0.7)) % 10**6 for _ in range(5000)])
    held = lm.Filter(1, {0: lm.make_bits(grams, lm.levels(counts, 1)).tobytes()})
    found = held.level(grams, np.zeros(5000, np.int64))
    assert (found >= lm.levels(counts, 1)).all() and (found == lm.levels(counts, 1)).mean() > 0.9
    others = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    assert (held.level(others, np.zeros(5000, np.int64)) == 0).mean() > 0.95


def test_levels_and_their_bound():
    assert lm.levels(np.array([0, 6, 7, 13, 14, 27, 28]), 7).tolist() == [0, 0, 1, 1, 2, 2, 3]
    assert lm.count_of_level(np.array([0, 1, 2, 3]), 1).tolist() == [0.0, 1.0, 2.5, 5.5]
    rng = np.random.default_rng(3)
    counts = rng.zipf(1.3, 200_000).clip(max=10**7)
    unit = max(1, -(-int(counts.sum()) // 1000))
    assert lm.levels(counts, unit).sum() <= 2 * 1000


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (3, "A a\tb"), (None, "zzz zzz"), (6, "b " * 50_000 + "é" * 5000), (7, " x \x1c y")]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, token string, row int")
    training = docs.where("doc_id != 1 or doc_id is null")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_documents(docs, training).collect()), key=repr)
    want, *_ = brute(rows, [t for i, t in rows if i != 1])
    assert got == sorted([(*w[:4], round(w[4], 6)) for w in want], key=repr)
    assert lm.score_documents(docs.where("false"), training).count() == 0
    untrained = lm.score_documents(docs, docs.where("false")).collect()
    assert all(r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_a_full_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(lm, "CACHED_WORDS", 5)
    words = lm._Words({b"a3": 9})
    for k in range(4):
        own = [b"a%d" % i for i in range(k, k + 8)]
        rows = words.rows(own)
        assert words.hash[rows].tolist() == [lm.word_hash(w) for w in own]
        assert words.exact[rows].tolist() == [9 if w == b"a3" else -1 for w in own]


def test_rare_words_and_pairs_of_a_large_corpus_are_kept(spark):
    """17 million training tokens, among them a word and a pair that stand once."""
    training = spark.range(170).selectExpr("repeat('a ', 100000) as text").unionByName(spark.createDataFrame([("rare pair",)], "text string"))
    docs = spark.createDataFrame([(1, "rare pair"), (2, "pair rare"), (3, "none such")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(docs, training).collect()}
    counts, n = Counter({b"a": 17_000_000, b"rare": 1, b"pair": 1, b"\n": 171}), 17_000_173
    pairs = {(b"\n", b"rare"): 1, (b"rare", b"pair"): 1, (b"pair", b"\n"): 1}
    assert [got[i].n_known for i in (1, 2, 3)] == [3, 3, 1]
    assert got[1].train_tokens == n and got[1].score > got[2].score > got[3].score
    near = lambda c: float(lm.count_of_level(lm.levels(np.array([c]), 1), 1)[0])
    for i, own in [(1, [b"rare", b"pair", b"\n"]), (2, [b"pair", b"rare", b"\n"])]:
        want = sum(math.log10((near(pairs.get((a, w), 0)) + lm.PRIOR * (near(counts[w]) + 0.5) / (n + 0.5 * 5)) / (near(counts[a]) + lm.PRIOR))
                   for a, w in zip([b"\n", *own], own))
        assert got[i].score == pytest.approx(want, rel=1e-9)


def test_scores_do_not_hang_on_what_is_looked_up_together(spark, monkeypatch):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.score for r in lm.score_documents(docs, docs).collect()}
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 500)
    monkeypatch.setattr(lm, "LOOKED_UP", 1000)
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    assert {r.doc_id: r.score for r in lm.score_documents(docs, docs).collect()} == pytest.approx(whole, rel=0.05)


def test_scores_do_not_hang_on_the_session(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (before, "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            scores.append({r.doc_id: r.score for r in lm.score_documents(docs, docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1]


def test_a_part_is_looked_up_one_asker_at_a_time(monkeypatch):
    """Every asker asks each part, so all their n-grams together grow with the corpus; one asker's are bounded."""
    import pandas as pd

    grams = np.sort(lm._mix(np.arange(1, 3001, dtype=np.uint64)))
    bits = lm.make_bits(grams[:2000], lm.levels(np.arange(1, 2001)))
    asked = pd.DataFrame({"asker": [0, 1, 2], "part": [0, 0, 0],
                          "words": [lm._pack_grams(grams[k::3]) for k in range(3)], "pairs": [lm._pack_grams(grams[:0])] * 3})
    sizes, level = [], lm.Filter.level
    monkeypatch.setattr(lm.Filter, "level", lambda self, g, p: sizes.append(len(g)) or level(self, g, p))
    got = lm._answer(asked, pd.DataFrame({"part": [0], "bits": [bits.tobytes()]}))
    assert max(sizes) <= 1000
    whole = lm.Filter(1, {0: bits.tobytes()}).level(grams, np.zeros(len(grams), np.int64))
    for k in range(3):
        assert np.frombuffer(got["words"][k], np.int8).tolist() == whole[k::3].tolist()


def test_a_part_is_built_a_slice_at_a_time(monkeypatch):
    grams = np.sort(lm._mix(np.arange(1, 3001, dtype=np.uint64)))
    level = lm.levels(np.arange(1, 3001))
    whole = lm.make_bits(grams, level)
    sizes, place = [], lm._place
    monkeypatch.setattr(lm, "PLACED", 700)
    monkeypatch.setattr(lm, "_place", lambda g, *a: sizes.append(len(g)) or place(g, *a))
    assert lm.make_bits(grams, level).tobytes() == whole.tobytes()
    assert max(sizes) <= 700
