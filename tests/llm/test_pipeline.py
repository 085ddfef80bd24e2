"""The pipeline against brute-force versions of its stages."""

import hashlib
from array import array

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from pressroute.llm.bpe import vocabulary
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_components, brute_fingerprint

BASE = "/root/testdata/sf0.001"


def brute(docs, items):
    """Ids and texts that stay, by stage. ``docs`` are those with a known language."""
    last = {}
    for i, t in docs:
        last[t] = max(i, last.get(t, i))
    exact = sorted((i, t) for t, i in last.items())
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in exact])
    near = [(i, t) for (i, t), (_, c) in zip(exact, groups) if i == c]
    dirty = {d for d, n, hit, _ in brute_contamination(near, items) if hit and 20 * hit >= n}
    return exact, near, [(i, t) for i, t in near if i not in dirty]


def test_run_equals_brute_force(spark, tmp_path):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    longest = sorted(docs, key=lambda d: -len(d[1]))[:6]
    docs += [(10_000 + i, t + " altered") for i, t in longest]  # the small tables hold no near copies
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    base = str(tmp_path)
    spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in docs + [(20_000, "12 34"), (20_001, None)]],
                          "doc_id long, text string, lang string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert all(any(c.isalpha() for c in t) for _, t in docs)
    exact, near, clean = brute(docs, items)
    assert len(docs) > len(exact) > len(near) > len(clean)
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(cp.VOCABULARY).ranks, special_tokens={})
    want = []
    for i, t in clean:
        ids = array("I", tik.encode_ordinary(t))
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.tobytes()))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.ids)) for r in cp.run(spark, base).collect())
    assert got == sorted(want)


def test_stages_keep_columns_and_take_odd_rows(spark):
    prose = " ".join(["the house and the garden are near the river where we were"] * 3)
    other = "der Hund und die Katze gehen in den Garten und an den Fluss"
    long = "the long road to the house " * 5000
    item = spark.read.parquet(f"{BASE}/benchmark.parquet").first().text
    rows = [(1, prose, "en", "a", 1), (2, prose, "en", None, 1), (2, prose, "en", None, 1), (3, None, "en", "a", 0), (4, "", None, "a", 0),
            (5, "12 34 !!", None, "b", 9), (6, other, "de", "b", 9), (7, prose.replace("river where we were", "river where we were", 1) + " x", "en", "b", 9),
            (None, other + " einmal", "de", "c", 9), (9, long, "en", "c", 9), (10, item, "es", "c", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, `__lang` string, spans string"
    docs = spark.createDataFrame([(*r, "k", 1, "l", "s") for r in rows], schema)
    kept = docs
    for name, step in cp.STAGES[:-1]:
        before = kept
        kept = cp.stage(step(spark, kept, BASE), "test")
        assert kept.columns == docs.columns, name
        assert step(spark, docs.where("false"), BASE).count() == 0
        ids = sorted((r.doc_id for r in kept.collect()), key=repr)
        assert len(ids) <= before.count()
        if name == "language":
            assert ids == sorted([1, 2, 2, 6, 7, None, 9, 10], key=repr)
        if name == "exact copies":
            assert ids == sorted([2, 6, 7, None, 9, 10], key=repr)
        if name == "decontamination":
            assert 10 not in ids and {9, 6, None} <= set(ids)
    assert cp.encode(spark, docs, BASE).count() == len(rows)
