"""Helpers that the operators share."""

from pressroute.llm.common import RecentCache


def test_a_cache_stays_within_its_bytes_and_keeps_what_is_asked_for():
    worked = []

    def work(key):
        worked.append(key)
        return key * 2

    cache = RecentCache(work, 40_000)
    for i in range(5000):
        assert cache["hot"] == "hothot" and cache[f"k{i}"] == f"k{i}" * 2
        assert cache.held <= 20_000 and len(cache) + len(cache.older) < 300
    assert worked.count("hot") == 1 and len(worked) == 5001
    assert cache["x" * 1000] == "x" * 2000 and "x" * 1000 not in cache  # too large beside the others
    cache.forget()
    assert not cache and not cache.older and cache["hot"] == "hothot" and worked.count("hot") == 2
