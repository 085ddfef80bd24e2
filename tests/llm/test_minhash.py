"""MinHash groups against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from pressroute.llm import minhash
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.001"


def brute_set(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(docs):
    """[(doc_id, n_shingles, component_id, kept)] by comparing all pairs of sets."""
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return sorted([(i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))], key=repr)


def groups(spark, docs):
    return sorted(map(tuple, minhash.minhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    got = sorted(map(tuple, LLM_QUERIES["op13_minhash_bbit"](spark, BASE).collect()), key=repr)
    assert got == brute(docs)
    assert not all(kept for *_, kept in got)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"new{rng.random()}"], [words[at], f"more{rng.random()}"]])
    return words


@pytest.mark.parametrize("seed", [1])
def test_crowds_of_more_and_less_changed_copies(spark, seed):
    """Copies around the threshold of common ancestors, copies of copies, and texts that share only a passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for _ in range(3):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 120, 400]))]
        chain = base
        for k in range(45):
            docs.append(edited(rng, base, rng.randrange(max(2, len(base) // 15))))
            if k % 3 == 0:
                chain = edited(rng, chain, max(1, len(base) // 90))
                docs.append(chain)
    docs += [[f"v{rng.random()}" for _ in range(rng.randrange(5, 60))] + passage for _ in range(60)]
    docs += [docs[4]] * 5
    texts = [" ".join(d) for d in docs]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    assert groups(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 7000}" for i in range(90_000))
    docs = [(5, None), (4, ""), (3, " \t\n"), (9, "One"), (8, "one "), (7, "one two"), (6, "One\x0bTWO"), (2, "one two three"), (None, "one two three"),
            (None, "alone in the world"), (1, long), (0, long + " x"), (0, long + " x"), (11, "ÀB c d"), (12, "àb c d"), (13, "a\x00b c d")]
    assert groups(spark, docs) == brute(docs)
    assert groups(spark, []) == []
    clash = spark.createDataFrame([(1, "a b c", 5, 6), (2, "A B C", 7, 8)], "doc_id int, text string, key int, id int")
    assert sorted(map(tuple, minhash.minhash_groups(clash).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_codes_of_very_many_words_stay_exact(monkeypatch):
    words = [f"{i % 97}".encode() for i in range(400)]
    want = len({tuple(words[i:i + 3]) for i in range(398)})
    assert len(minhash.shingle_codes(words, {})) == want
    narrow = minhash.shingle_hashes(words)
    monkeypatch.setattr(minhash, "WORD_BITS", 5)
    assert minhash.shingle_codes(words, {}).dtype == object and len(minhash.shingle_codes(words, {})) == want
    assert sorted(minhash.shingle_hashes(words)) == sorted(narrow)


def test_low_bits_estimate_similarity():
    """Agreement of the low bits, corrected for chance, is near the similarity; a pair at the threshold is not discarded."""
    rng, minima = np.random.default_rng(3), minhash.signer()
    off = []
    for similarity in (0.2, 0.5, 0.85, 0.95):
        for _ in range(25):
            both = round(2000 * similarity / (1 + similarity))
            every = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            a, b = minima(every[:(2000 + both) // 2]), minima(every[(2000 - both) // 2:])
            agree = int((((a ^ b) & ((1 << minhash.LOW_BITS) - 1)) == 0).sum())
            true = len(set(every[:(2000 + both) // 2].tolist()) & set(every[(2000 - both) // 2:].tolist())) / 2000
            off.append((agree / minhash.MINIMA - 2 ** -minhash.LOW_BITS) / (1 - 2 ** -minhash.LOW_BITS) - true)
            assert true < 0.85 or agree >= minhash.least_agreement()
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
