"""Ranked search against the SQL, brute force and the bounds it rests on."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pressroute.llm import ball_tree_search as search
from pressroute.llm.queries import LLM_ORACLE, LLM_QUERIES
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"


def brute_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, keep=10):
    words = [(i, brute_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in set(brute_terms(text)) if tf[t])
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:keep], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_equals_its_sql(spark):
    name = "op11_ball_tree_search"
    assert compare(spark, connect(BASE), LLM_QUERIES[name], LLM_ORACLE[name], BASE) is None


def corpus(seed, n=150, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(vocabulary)], k=rng.randint(0, 30))) for _ in range(n)]
    texts += [texts[3]] * 70  # copies: many equal scores
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs, [(k, " ".join(rng.sample(words, rng.randint(1, 8)))) for k in range(12)]


@pytest.mark.parametrize("leaf,tree,block", [(2, 16, 1 << 20), (64, 50, 100)])
def test_small_trees_and_blocks_equal_brute_force(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    docs, items = corpus(leaf)
    # the tasks import the module anew, so tree sizes are tried in this process
    assert ranked(spark, docs, items, keep=7) == brute(docs, items, 7)
    vocabulary = sorted({t for _, x in items for t in brute_terms(x)})
    number = {t: i for i, t in enumerate(vocabulary)}
    monkeypatch.setattr(search, "LEAF_DOCS", leaf)
    rows = [(i, Counter(number[t] for t in brute_terms(x) if t in number)) for i, x in docs]
    rows = [(i, sorted(c.items())) for i, c in rows if c]
    for _, text in items:
        own = np.array(sorted(number[t] for t in set(brute_terms(text))))
        weights = np.array([100 + 7 * k for k in own.tolist()])
        query = {"terms": own, "weights": weights, "norm": math.sqrt(float(weights @ weights)) * (1 + search.SLACK)}
        best, want = [], []
        for at in range(0, len(rows), tree):
            part = rows[at:at + tree]
            built = search.BallTree(np.array([i for i, _ in part], object), np.cumsum([0, *(len(c) for _, c in part)]),
                                    np.array([t for _, c in part for t, _ in c]), np.array([v * 1000 for _, c in part for _, v in c]), len(vocabulary))
            built.search(query, best, 5)
            scores = {i: sum(100 * 1000 * v + 7 * t * 1000 * v for t, v in c if t in set(own.tolist())) for i, c in part}
            want = heapq.nlargest(5, want + [(s, -i) for i, s in scores.items() if s])
            for node in built.nodes:
                under = node["docs"] if node["docs"] is not None else []
                assert all(scores[built.ids[d]] <= built.bound(node, query) for d in under)
        assert sorted(best, reverse=True) == want


def test_balls_prune_leaves_of_other_words():
    """Documents of another vocabulary are not scored."""
    ids = np.arange(4 * search.LEAF_DOCS).astype(object)
    own = np.array([0] * (2 * search.LEAF_DOCS) + [1] * (2 * search.LEAF_DOCS))
    built = search.BallTree(ids, np.arange(len(ids) + 1), own, np.full(len(ids), 1000), 2)
    scored = []
    entries = built._entries
    built._entries = lambda docs: scored.append(docs) or entries(docs)
    best = []
    built.search({"terms": np.array([1]), "weights": np.array([5]), "norm": 5.0}, best, 10)
    assert sorted(-i for _, i in best) == list(range(2 * search.LEAF_DOCS, 2 * search.LEAF_DOCS + 10))
    assert all(own[d] == 1 for docs in scored for d in docs)


def test_odd_rows(spark):
    long = "alpha " * 40_000 + "Öl"
    docs = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha BETA"), (7, long), (-5, "beta"), (8, "gamma_delta öl Öl")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "?!"), (4, "absent"), (5, "beta Öl delta"), (None, "gamma")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b", 6, "y")], "doc_id long, text string, n int, rank string")
    asked = spark.createDataFrame([(9, "b", 1)], "item_id int, text string, score int")
    assert [r[2] for r in search.search(clash, asked).orderBy("rank").collect()] == [2, 1]
