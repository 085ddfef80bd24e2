"""Sizes, slots and links of the shards."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from pressroute.llm.queries import LLM_QUERIES
from pressroute.llm.sharding import allowed_moves, cut_links, quotas, shard_documents

BASE = "/root/testdata/sf0.01"


def check(rows, docs, shards):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_query_keeps_its_law(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    rows = LLM_QUERIES["op2_balanced_sharding"](spark, BASE).collect()
    check(rows, docs, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


@pytest.mark.parametrize("groups, least", [([2] * 60, 0), ([200, 3, 3, 5], 150), ([30] * 12, 40), ([400], 350)])
def test_links_are_kept_together(spark, groups, least):
    """``least``: what must be cut when a shard has 50 rows (of 12 groups of 30, four give up 10 rows each)."""
    rng, docs = random.Random(1), []
    for g, n in enumerate(groups):
        docs += [f"group {g}"] * n
    docs += [f"single {i}" for i in range(400 - len(docs))]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    placed = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=8)
    check(placed.collect(), docs, 8)
    got = cut_links(placed).first()
    assert got["cut"] <= least + 0.1 * got["links"], (got, least)


def test_moves_fit(spark):
    assert quotas(10, 4) == [3, 3, 2, 2]
    allowed = allowed_moves({(0, 1): 5, (1, 0): 3, (2, 1): 4}, [0, 3, 0])
    assert allowed == {(0, 1): 5, (1, 0): 3, (2, 1): 1}  # shard 1 gains 6, gives 3, had room for 3


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, ""), (2, ""), (None, "x"), (5, "long " * 50_000), (5, "other")]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, size int, shard string")
    check(shard_documents(frame, shards=3).collect(), docs, 3)
    check(shard_documents(frame, shards=24).collect(), docs, 24)
    assert shard_documents(frame.where("false")).count() == 0
