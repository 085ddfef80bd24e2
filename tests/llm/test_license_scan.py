"""Base phrases against brute force; templates on planted wordings."""

import re

from pressroute.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.01"


def words(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def brute(text):
    w, places = words(text), []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        places += [(label, s) for s in range(len(w) - len(p) + 1) if w[s:s + len(p)] == p]
    return len(w), sorted(places), sorted({x for x, _ in places})


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, k1 int")
    return [(r.doc_id, r.n_words, sorted((p.label, p.start) for p in r.base_places), r.base_labels, r.labels, r.score)
            for r in scan_licenses(docs).collect()]


def test_query_equals_brute_force_in_the_base_columns(spark):
    got = {r.doc_id: r for r in LLM_QUERIES["op8_license_scan"](spark, BASE).collect()}
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, places, labels = brute(d.text)
        starts, r = [s for _, s in places], got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) - {""} and 0 <= r.score <= 1
        for line, label in [("Released under the MIT License.", "mit-notice"), ("Apache License, Version 2.0.", "apache-2.0-notice"),
                            ("GNU General Public License, version 3.", "gpl-3-notice")]:
            assert (label in r.labels.split(",")) == (line in d.text), (d.doc_id, label)
        assert (r.score > 0) == bool(labels)


def test_every_wording_is_found_and_altered_ones_are_not(spark):
    filler = "plain words that say nothing much " * 20
    rows = [(i, f"{filler} {wording}. {filler}") for i, (_, wording, _) in enumerate(TEMPLATES)]
    rows += [(100, f"{filler} mit was here and a license there {filler}"), (101, "Version 2.0 of the public notice " + filler)]
    rows += [(1000 + i, filler + str(i)) for i in range(60)]
    got = {r[0]: r for r in result(spark, rows)}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i][4], (label, got[i])
        assert got[i][5] >= 0.8
    assert all(got[i][3:] == ([], [], 0.0) for i in [100, 101, *range(1000, 1060)])


def test_odd_rows(spark):
    many = "MIT License " * 20_000
    rows = [(1, None), (2, ""), (3, "mit mit license license"), (3, "mit mit license license"), (None, "the Mit-License"), (6, many),
            (7, "Ämit license apache license"), (8, "general public license general public license")]
    got = sorted((r[:4] for r in result(spark, rows)), key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert result(spark, []) == []


def test_every_place_of_a_template_is_checked(spark):
    """Both versions in one text, in either order, and a wording without its version before the whole one."""
    wording = {label: text for label, text, _ in TEMPLATES}
    two, three, filler = wording["gpl-2-text"], wording["gpl-3-text"], "plain words 2 and 3 that say nothing much " * 20
    rows = [(1, f"{two} {filler} {three}"), (2, f"{three} {filler} {two}"),
            (3, f"{three.replace('version 3 of the License', 'some version')} {filler} {three}")]
    rows += [(1000 + i, filler + str(i)) for i in range(60)]
    got = {r[0]: r[4] for r in result(spark, rows)}
    assert all({"gpl-2-text", "gpl-3-text"} <= set(got[i]) for i in (1, 2)) and "gpl-3-text" in got[3] and "gpl-2-text" not in got[3]


def test_a_file_with_many_licences_has_all_their_labels(spark):
    wordings = {label: text for label, text, _ in TEMPLATES}
    filler = "plain words that say nothing much " * 20
    rows = [(1, f" {filler} ".join(wordings.values()))] + [(1000 + i, filler + str(i)) for i in range(60)]
    got = {r[0]: r[4] for r in result(spark, rows)}
    assert set(wordings) <= set(got[1])
