"""Fingerprints and components against brute force."""

import random
import re

import pytest
import xxhash

from pressroute.llm import simhash
from pressroute.llm.components import connected_components
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: least reachable id} of [(id, fp)]."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        least[find(p)] = min(i, least.get(find(p), i))
    return [(i, least[find(p)]) for i, p in prints]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    prints = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    want = sorted((i, f"{p:016x}", c) for (i, p), (_, c) in zip(prints, brute_components(prints)))
    got = sorted(map(tuple, LLM_QUERIES["op7_simhash_pivots"](spark, BASE).collect()))
    assert got == want
    assert len({c for _, _, c in got}) < len(got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("paired", [2, 64])
def test_links_of_crowded_and_sparse_buckets(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = random.Random(paired)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):  # chains of small steps
            values.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    centre = rng.getrandbits(64)
    values |= {centre ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)}
    values = sorted(values)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.linked_fingerprints(prints), "test").collect()}
    want = brute_components([(signed(v), v) for v in values])
    assert [(i, found.get(i, i)) for i, _ in want] == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(1000, 1300)}, 7: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(4, None, 1), (3, "", 1), (9, "\t \n", 1), (5, "One two", 1), (5, "one TWO", 1), (None, "one two", 1), (8, long, 1), (6, "É", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id, r.fp % 2**64) for r in simhash.simhash_groups(docs).collect()), key=repr)
    want = [(4, 3), (3, 3), (9, 3), (5, 5), (5, 5), (None, 5), (8, 8), (6, 6)]
    assert got == sorted([(i, c, brute_fingerprint(t)) for (i, c), (_, t, _) in zip(want, rows)], key=repr)
    assert simhash.simhash_groups(docs.where("false")).count() == 0
