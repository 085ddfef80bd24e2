"""Repeated passages against a brute-force search of all runs."""

import random

import numpy as np
import pytest

from pressroute.llm import suffix_dedup as sd
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.001"


def brute(docs):
    owners, texts = {}, {}
    for i, text in docs:
        texts[i, text] = words = (text or "").encode().lower().split()
        for s in range(len(words) - 49):
            owners.setdefault(tuple(words[s:s + 50]), set()).add(i)
    out = []
    for (i, _), words in texts.items():
        starts = [s for s in range(len(words) - 49) if len(owners[tuple(words[s:s + 50])]) > 1]
        while starts:
            first = last = starts.pop(0)
            while starts and starts[0] <= last + 50:
                last = starts.pop(0)
            out.append((i, first, last - first + 50))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    got = LLM_QUERIES["op5_sparse_suffix_dedup"](spark, BASE).collect()
    assert sorted(((r.doc_id, r.first_word, r.n_words) for r in got), key=repr) == brute(docs)
    assert got and all(r.other_doc_id != r.doc_id and r.other_doc_id is not None for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    passages = [fresh(n) for n in (49, 50, 51, 64, 120, 300)]
    parts = lambda: f"{fresh(rng.randint(0, 60))} {rng.choice(passages).upper() if rng.random() < 0.2 else rng.choice(passages)} {fresh(rng.randint(0, 30))}"
    docs = [(i, " \n".join(parts() for _ in range(rng.randint(1, 3)))) for i in range(30)]
    docs += [(100 + i, fresh(80)) for i in range(5)]
    docs += [(200 + i, " ".join(passages[4].split()[i * 9:i * 9 + 70])) for i in range(5)]  # overlapping parts
    got = sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.first_word, r.n_words) for r in got), key=repr) == brute(docs)


def test_one_run_over_many_partitions(spark):
    line = " ".join(f"x{i}" for i in range(60))
    docs = [(i, f"a{i} {line} b{i}") for i in range(300)]
    got = sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in got) == [(i, 1, 60) for i in range(300)]


def test_odd_rows(spark):
    long = " ".join(f"y{i}" for i in range(60_000))
    copy = " ".join(f"z{i}" for i in range(50))
    repeated = " ".join([copy.replace("z", "q")] * 3)
    rows = [(1, None), (2, ""), (3, long), (4, " ".join(long.split()[5000:5055])), (5, copy), (6, copy), (6, copy), (7, repeated), (7, repeated),
            (None, copy), (8, "short text"), (9, "short text")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, pos int, head string")
    got = sorted(((r.doc_id, r.first_word, r.n_words) for r in sd.repeated_passages(docs).collect()), key=repr)
    assert got == brute(rows)
    assert sd.repeated_passages(docs.where("false")).count() == 0


def test_kept_starts_agree_on_equal_runs():
    rng = np.random.default_rng(1)
    a, b, shared = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (100, 70, sd.PASSAGE))
    one, two = (sd.kept_starts(sd.run_hashes(np.concatenate([x, shared, x]), sd.GRAM)) for x in (a, b))
    inside = lambda at, off: {s - off for s in at.tolist() if 0 <= s - off <= sd.PASSAGE - sd.GRAM}
    assert inside(one, 100) & inside(two, 70)
    runs = sd.run_hashes(np.concatenate([a, shared, b, shared]), 50)
    assert runs[100] == runs[220] and len(set(runs.tolist())) == len(runs) - 1
