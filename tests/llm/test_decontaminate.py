"""Decontamination against brute force and against its SQL."""

import random
import re

import pytest

from pressroute.llm.decontaminate import contamination, is_contaminated, words_hit
from pressroute.llm.queries import LLM_ORACLE, LLM_QUERIES
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s:s + 13]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, owners = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    owners |= found
        out.append((d, len(w), len(hit), sorted(owners)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "e", 1) for x in docs], "doc_id long, text string, words string, k1 int")
    i = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, window string")
    found = contamination(d, i).select("doc_id", "n_words", words_hit("spans").alias("n_hit"), "item_ids")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()), key=repr)


def test_query_equals_sql(spark):
    name = "op9_positional_decontamination"
    assert compare(spark, connect(BASE), LLM_QUERIES[name], LLM_ORACLE[name], BASE) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_of_few_words(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "The", "a", "b", "é", "c3", "d-e", "the the"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (52, "the")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{text(5)}, {t} {text(4)}") for i, t in items] + [(200, None), (201, ""), (201, "")]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_text_copies_null_ids_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    long = "zero " * 20_000 + passage + " zero" * 20_000
    docs = [(1, long), (1, long), (None, passage), (3, " ".join(passage.split()[:12])), (4, " ".join(passage.split()[5:19]))]
    items = [(7, passage), (8, passage), (9, "w1 w3")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_share_of_words(spark):
    rows = spark.createDataFrame([(0, 0), (13, 260), (13, 261), (1, 1)], "h long, n long")
    assert [r[0] for r in rows.select(is_contaminated(rows.h, rows.n)).collect()] == [False, True, False, True]
