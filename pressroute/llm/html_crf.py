"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pressroute.llm.html_blocks import LABEL, Block, blocks_of, features

ROWS_PER_BATCH = 128


@dataclass
class Extractor:
    """``weight`` of each feature for main text (less its weight for the rest) and the scores of label pairs.

    ``steps[same][before][now]``: ``same`` says whether two neighbouring blocks have the same parent element.
    """

    weight: dict[str, float]
    steps: list[list[list[float]]]
    start: list[float]

    def __post_init__(self):
        self.known = frozenset(f for f in self.weight if f.startswith(("in:", "named:")))

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The likeliest sequence of labels (Viterbi); of equal ones the one with less main text."""
        if not blocks:
            return []
        get, back = self.weight.get, []
        total = len(blocks)
        gains = [sum(get(f, 0.0) for f in features(b, i, total)) for i, b in enumerate(blocks)]
        rest, main = self.start[0], self.start[1] + gains[0]
        for i in range(1, total):
            (a, b), (c, d) = self.steps[blocks[i].container == blocks[i - 1].container]
            from_rest, from_main = rest + a >= main + c, rest + b >= main + d
            back.append((not from_rest, not from_main))
            rest, main = (rest + a if from_rest else main + c), (rest + b if from_main else main + d) + gains[i]
        now, found = main > rest, []
        for before in reversed(back):
            found.append(now)
            now = before[now]
        found.append(now)
        return found[::-1]

    def text(self, html: str | None) -> str:
        """The main text: its blocks in page order, one a line."""
        blocks = blocks_of(html, self.known)
        return "\n".join(b.text for b, main in zip(blocks, self.labels(blocks)) if main)


def _marginals(gains: np.ndarray, steps: np.ndarray, start: np.ndarray, same: list[int]):
    """Probabilities of label 1 at each block and of each label pair (forward and backward sums in logarithms)."""
    n = len(gains)
    emit = np.stack([np.zeros(n), gains], axis=1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = start + emit[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp(ahead[i - 1, 0] + steps[same[i], 0], ahead[i - 1, 1] + steps[same[i], 1]) + emit[i]
    for i in range(n - 2, -1, -1):
        to = steps[same[i + 1]] + emit[i + 1] + back[i + 1]
        back[i] = np.logaddexp(to[:, 0], to[:, 1])
    total = np.logaddexp(*ahead[-1])
    single = np.exp(ahead + back - total)
    pairs = [np.exp(ahead[i - 1][:, None] + steps[same[i]] + emit[i] + back[i] - total) for i in range(1, n)]
    return single, pairs


def train_extractor(pages: list[str], epochs: int = 10, rate: float = 0.4, decay: float = 1e-4, seed: int = 7) -> Extractor:
    """Fit by stochastic gradient ascent of the pages' log-likelihood, with step sizes by feature (AdaGrad).

    In a labelled page an element with ``data-main="1"`` holds main text and one with ``"0"`` does not;
    without a label it is as its parent. The list of pages is the fit's whole input, so its length bounds it.
    """
    data = []
    index: dict[str, int] = {}
    for html in pages:
        blocks = blocks_of(html)
        if blocks:
            rows = [[index.setdefault(f, len(index)) for f in features(b, i, len(blocks))] for i, b in enumerate(blocks)]
            same = [0, *(int(a.container == b.container) for a, b in zip(blocks, blocks[1:]))]
            data.append((rows, same, [int(b.label) for b in blocks]))
    weight, steps, start = np.zeros(len(index)), np.zeros((2, 2, 2)), np.zeros(2)
    sums = [np.full(x.shape, 1e-6) for x in (weight, steps, start)]
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for rows, same, gold in data:
            gains = np.array([weight[r].sum() for r in rows])
            single, pairs = _marginals(gains, steps, start, same)
            slope_w, slope_s, slope_0 = {}, np.zeros_like(steps), -single[0]
            slope_0[gold[0]] += 1
            for r, p, y in zip(rows, single[:, 1], gold):
                for f in r:
                    slope_w[f] = slope_w.get(f, 0.0) + y - p
            for i, pair in enumerate(pairs, 1):
                slope_s[same[i]] -= pair
                slope_s[same[i], gold[i - 1], gold[i]] += 1
            at = np.fromiter(slope_w, np.int64, len(slope_w))
            change = np.fromiter(slope_w.values(), float, len(slope_w)) - decay * weight[at]
            sums[0][at] += change**2
            weight[at] += rate * change / np.sqrt(sums[0][at])
            for x, total, change in ((steps, sums[1], slope_s - decay * steps), (start, sums[2], slope_0 - decay * start)):
                total += change**2
                x += rate * change / np.sqrt(total)
    return Extractor({f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-4}, steps.tolist(), start.tolist())


def labelled_pages(count: int = 600, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts, made up by a rule: the training set.

    A page has an article (in a semantic element, or in a ``div`` whose name says so, or in a plain one)
    and, around and inside it, some of what is not main text: menus, headers, footers, sidebars, notices,
    adverts, forms and comments, in elements named in the usual ways or by their tag alone. Words are made
    of random syllables, so that nothing is learned from them.
    """
    return [_page(random.Random(seed * 100_003 + i)) for i in range(count)]


# Usual names of page parts.
_MAIN = ["content", "article", "post", "entry", "main", "story", "article-body", "post-content", "text", "page-content"]
_ASIDE = ["sidebar", "side", "widget", "related", "recommended", "popular", "links", "tags", "share", "social", "author-box", "breadcrumb"]
_NOTICE = ["notice", "cookie", "cookie-banner", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "banner", "paywall", "message"]
_ADVERT = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "banner-ad"]
_COMMENT = ["comments", "comment", "comment-list", "replies", "reply", "discussion", "responses", "reader-comments", "disqus"]
_MENU = ["nav", "menu", "navbar", "navigation", "topbar", "main-menu", "links"]
_HEAD = ["header", "masthead", "site-header", "top", "logo", "branding"]
_FOOT = ["footer", "site-footer", "bottom", "copyright", "legal", "foot"]


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(["ba", "ne", "ti", "or", "lu", "sha", "en", "mi", "ko", "é", "ing", "st", "ra"]) for _ in range(rng.randint(1, 4)))


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(low, high)))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 1, 14).capitalize() + rng.choice([".", ".", ".", "!", "?", ",", ""]) for _ in range(rng.randint(low, high)))


def _paragraph(rng: random.Random) -> str:
    body = _sentences(rng, 1, rng.choice([1, 1, 3, 8, 14]))
    noise = rng.random()
    if noise < 0.08:  # main text may look like anything
        body = body.replace(" ", rng.choice([" | ", "%%% ", " · ", " » ", "@x.example "]))
    elif noise < 0.14:
        body = f"{rng.randint(0, 10**9)} {rng.randint(0, 10**6)} {body[:20].lower()}"
    elif noise < 0.17:
        body = rng.choice([f"&copy; {body}", f"{body} https://{_word(rng)}.example/", body.lower(), _word(rng)])
    if rng.random() < 0.25:
        body = body.replace(" ", f' <a href="/x">{_words(rng, 1, 3)}</a> ', 1)
    if rng.random() < 0.15:
        return f"<p><b>{body}<br>"
    kind = rng.random()
    if kind < 0.06:
        return f"<ul>{''.join(f'<li>{_sentences(rng, 1, 2)}</li>' for _ in range(rng.randint(2, 4)))}</ul>"
    if kind < 0.12:
        return f"<h{int(kind * 50)}>{_words(rng, 2, 8)}</h{int(kind * 50)}>"  # h3 to h5
    if kind < 0.15:
        return f"<blockquote>{body}</blockquote>"
    if kind < 0.17:
        return f"<table><tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 6)}</td></tr></table>"
    if kind < 0.19:
        return f"<figure><img src='x'><figcaption>{body}</figcaption></figure>"
    return f"<p>{body}</p>"


def _named(rng: random.Random, names: list[str], tag: str = "div") -> str:
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", " box", " x1"])}" {LABEL}="0">'


def _list(rng: random.Random) -> str:
    return f"<ul>{''.join(f'<li><a href=/{i}>{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(3, 8)))}</ul>"


def _other(rng: random.Random, kind: str) -> str:
    """A part that is not main text."""
    p = f"<p>{_sentences(rng, 1, 3)}</p>" if rng.random() < 0.6 else _sentences(rng, 1, 2)
    if kind == "menu":
        body = _list(rng) if rng.random() < 0.7 else " | ".join(f"<a href=/>{_words(rng, 1, 2)}</a>" for _ in range(5))
        return f'<nav {LABEL}="0">{body}</nav>' if rng.random() < 0.6 else f"{_named(rng, _MENU)}{body}</div>"
    if kind == "head":
        body = f"<h1>{_words(rng, 1, 3)}</h1>{p if rng.random() < 0.4 else _words(rng, 2, 5)}"
        return f'<header {LABEL}="0">{body}</header>' if rng.random() < 0.5 else f"{_named(rng, _HEAD)}{body}</div>"
    if kind == "foot":
        body = rng.choice([f"&copy; {_word(rng)} &middot; {_sentences(rng, 1, 2)}", p, _list(rng) + f"Copyright {_word(rng)}", _words(rng, 2, 6)])
        return f'<footer {LABEL}="0">{body}</footer>' if rng.random() < 0.6 else f"{_named(rng, _FOOT)}{body}</div>"
    if kind == "aside":
        body = f"<h3>{_words(rng, 1, 3)}</h3>" + (_list(rng) if rng.random() < 0.6 else p)
        tag = rng.choice(["div", "section"])
        return f'<aside {LABEL}="0">{body}</aside>' if rng.random() < 0.5 else f"{_named(rng, _ASIDE, tag)}{body}</{tag}>"
    if kind == "form":
        return f'<form {LABEL}="0"><label>{_words(rng, 1, 3)}</label><input name=x><p>{_sentences(rng, 1, 1)}</p><button>{_word(rng)}</button></form>'
    if kind == "comments":
        tag = rng.choice(["div", "section", "ol"])
        inner = "".join(rng.choice([f"<p>{_sentences(rng, 1, 5)}</p>", f"<div><b>{_word(rng)}</b><p>{_sentences(rng, 1, 3)}</p></div>",
                                    f"<li>{_sentences(rng, 1, 3)}</li>"]) for _ in range(rng.randint(1, 4)))
        return f"{_named(rng, _COMMENT, tag)}<h3>{_words(rng, 1, 2)}</h3>{inner}</{tag}>"
    tag = rng.choice(["div", "div", "aside", "section", "p"])
    return f"{_named(rng, _NOTICE if kind == 'notice' else _ADVERT, tag)}{_sentences(rng, 1, 2) if tag == 'p' else p}</{tag}>"


def _page(rng: random.Random) -> str:
    title = f"<h1>{_words(rng, 3, 9)}</h1>" if rng.random() < 0.8 else ""
    parts = [title, *(_paragraph(rng) for _ in range(rng.choice([1, 2, 4, 8, 12])))]
    for kind in ("advert", "notice", "aside", "comments", "form", "menu"):
        if rng.random() < 0.16:
            parts.insert(rng.randint(1, len(parts)) if kind != "comments" else len(parts), _other(rng, kind))
    tag = rng.random()
    if tag < 0.45:
        open_, close = f'<article {LABEL}="1">', "</article>"
    elif tag < 0.6:
        open_, close = f'<main {LABEL}="1">', "</main>"
    elif tag < 0.9:
        open_, close = f'<div class="{rng.choice(_MAIN)}{rng.choice(["", "", " box", " x1"])}" {LABEL}="1">', "</div>"
    else:
        open_, close = f'<div {LABEL}="1">', "</div>"
    before = [_other(rng, k) for k in ("head", "menu", "notice", "advert", "aside") if rng.random() < 0.5]
    after = [_other(rng, k) for k in ("comments", "aside", "advert", "form", "notice") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    foot = [_other(rng, "foot")] if rng.random() < 0.9 else []
    body = "".join([*before, open_, *parts, close, *after, *foot])
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
    return (f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 6)}</title><style>p{{}}</style></head><body>{body}"
            + ("</body></html>" if rng.random() < 0.9 else ""))


def extract_main_text(pages: DataFrame, model: Extractor, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` and ``text``, the main text of the whole page.

    Blocks of text come in page order, one a line; white space inside a block is one space and character
    references are decoded. A null or empty page, and one without main text, has the empty text. Repeated
    rows and null keys pass through; columns not named in ``keep`` are ignored; nothing is cut off.
    """
    import pyarrow as pa

    keep = keep or []

    def extract(batches: Iterator):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                yield pa.record_batch([*[part.column(i) for i in range(len(keep))],
                                       pa.array([model.text(h.as_py()) for h in part.column(len(keep))], pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.mapInArrow(extract, f"{fields}text string")
