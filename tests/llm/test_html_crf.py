"""Blocks, the field's sums and decoding, and the main text of pages."""

import itertools
import math
import random
import re
from html import unescape

import numpy as np
import pytest

from pressroute.llm.html_blocks import blocks_of, features
from pressroute.llm.html_crf import Extractor, _marginals, extract_main_text, labelled_pages, train_extractor
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return train_extractor(labelled_pages())


def test_blocks_of_untidy_html():
    html = ("<body><nav><ul><li><a href=x>One<li>Two</ul></nav><p>a &amp;\n b<p><b>c<br>d<script>var t='</p>';</script>"
            "<div>e<!-- no --><i>f</i></div>g</table><textarea>h</textarea>&eacute;&#x4e2d;&nbsp;i")
    assert [(b.text, b.tag) for b in blocks_of(html)] == [
        ("One", "li"), ("Two", "li"), ("a & b", "p"), ("c d", "p"), ("ef", "div"), ("gé中 i", "body")]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> \n</p>") == []


def scores(model, blocks_gain, same, path):
    total = model.start[path[0]]
    for i, y in enumerate(path):
        total += blocks_gain[i] * y + (model.steps[same[i]][path[i - 1]][y] if i else 0)
    return total


def test_sums_and_decoding_equal_enumeration():
    rng = random.Random(2)
    gains = np.array([rng.uniform(-2, 2) for _ in range(6)])
    same = [rng.randint(0, 1) for _ in range(6)]
    steps = [[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)]
    model = Extractor({}, steps, [0.3, -0.2])
    paths = list(itertools.product([0, 1], repeat=6))
    each = [math.exp(scores(model, gains, same, p)) for p in paths]
    single, pairs = _marginals(gains, np.array(steps), np.array(model.start), same)
    for i in range(6):
        assert single[i, 1] == pytest.approx(sum(e for e, p in zip(each, paths) if p[i]) / sum(each))
    assert pairs[2][1, 0] == pytest.approx(sum(e for e, p in zip(each, paths) if p[2] and not p[3]) / sum(each))


def test_viterbi_equals_enumeration():
    rng = random.Random(3)
    for turn in range(20):
        html = "".join(rng.choice(["<p>{}</p>", "<div><p>{}</p></div>"]).format("w" * (i + 1) + " x" * rng.choice([0, 5, 40])) for i in range(7))
        blocks = blocks_of(html)
        model = Extractor({"words:1": -0.4, "words:10": 0.5, "words:many": 0.2, "words:60": 0.9, "tag:p": 0.1},
                          [[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)], [0.1, 0.0])
        from pressroute.llm.html_blocks import features
        gains = [sum(model.weight.get(f, 0) for f in features(b, i, 7)) for i, b in enumerate(blocks)]
        same = [0, *(int(a.container == b.container) for a, b in zip(blocks, blocks[1:]))]
        best = max(itertools.product([0, 1], repeat=7), key=lambda p: scores(model, gains, same, p))
        assert model.labels(blocks) == [bool(y) for y in best]


def test_new_layouts(model):
    right = total = 0
    for html in labelled_pages(200, seed=5):
        blocks = blocks_of(html)
        for b, y in zip(blocks, model.labels(blocks)):
            right, total = right + (b.label == y), total + 1
    assert right >= 0.985 * total
    page = ("<html><body><header><h1>My site</h1></header><div class='article-body'><h2>News of today</h2><p>First.</p><div class='cookie-notice'>"
            "<p>We use cookies.</p></div><p>Second &amp; last.</p></div><div class='comments'><p>Nice one, thanks!</p></div>"
            "<form><p>Sign up</p></form><aside><p>Read more.</p></aside><footer>&copy; x</footer></body></html>")
    assert model.text(page) == "News of today\nFirst.\nSecond & last."


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{BASE}/pages.parquet").collect()}
    got = LLM_QUERIES["op1_html_crf"](spark, BASE).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S).group(1)
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<article>" + "<p>Some words here.</p>" * 20_000 + "</article>"
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>", "t"), (4, "no tags at all, only words.", "t"), (4, "no tags at all, only words.", "t"),
            (None, "<article><p>Hello there.</p></article>", "t"), (6, deep, "t"), (7, long, "t"), (8, "<script>never closed", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract_main_text(pages, model, keep=["page_id"]).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == by[8] == ""
    assert by[None] == "Hello there." and by[7].count("\n") == 19_999
    assert extract_main_text(pages.where("false"), model).count() == 0


def test_an_open_head_and_open_silent_elements_end_as_in_a_browser():
    from pressroute.llm.html_blocks import blocks_of, features

    texts = lambda html: [b.text for b in blocks_of(html)]
    assert texts("<html><head><title>t</title><body><article><p>One.</article>") == ["One."]
    assert texts("<head><title>t</title><script>x</script><p>One.") == ["One."]
    assert texts("<head><title>t</title> One.") == ["One."]
    assert texts("<div><svg><path><p>One.</p></div>") == ["One."]
    assert texts("<div><button>a<button>b</button> One.</div>") == ["One."]
    assert texts("<p>Let <math><mi>x</mi></math> be <object>two</object>.") == ["Let x be two."]
    assert texts("<div><svg><title>a</title><foreignobject><div>b</div></foreignobject></svg>One.</div>") == ["One."]


def test_names_after_many_classes_and_signs_late_in_a_block_count(model):
    """Utility classes in front of a name, and a copyright sign at the end of a long block."""
    utility = " ".join(f"px-{i} md:w-{i}" for i in range(60))
    pages = []
    for front in ("", f"{utility} "):
        pages.append(f'<body><div class="{front}nav menu"><a href="/a">Home</a> <a href="/b">News</a></div><article><h1>A heading of words</h1>'
                     f'<p>{"The article goes on for some words. " * 12}</p><p>{"And here it goes on again, quite long. " * 9}</p></article>'
                     f'<div class="{front}comments comment-list"><p>{"A reader says a thing or two. " * 4}</p></div></body>')
    labels = [model.labels(blocks_of(p)) for p in pages]
    assert labels[0] == labels[1] and not labels[1][-1] and any(labels[1])
    block = blocks_of(f"<footer><p>{'word ' * 60}© 2024</p></footer>")[0]
    assert "text:copyright" in features(block, 0, 1)
    names = blocks_of(pages[1])[0].context
    assert "named:nav" in names
