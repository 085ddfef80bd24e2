"""Leaf blocks of a page in page order, with the features that the extractor reads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What stands inside is not text of the page.
SILENT_TAGS = frozenset("script style template svg foreignobject desc iframe textarea select button head title canvas audio video".split())
#: A start tag of the key ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What can stand in a head; any other start tag, and text, ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: A start tag among the values ends an open silent element of the key that it stands directly in.
ENDS_SILENT = {"button": {"button"}, "select": {"select", "input", "textarea", "button"},
               "svg": frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                                "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())}
_TOKEN = re.compile(r"[a-z]+")
#: Attribute of labelled pages: "1" on an element whose text is main text, "0" on one inside it whose text is not.
LABEL = "data-main"


@dataclass
class Block:
    text: str
    tag: str
    context: frozenset[str]
    container: int
    link_share: float
    label: bool = False


@dataclass
class _Element:
    tag: str
    number: int
    context: frozenset[str]
    label: bool
    silent: bool = False
    breaks: bool = field(default=True)


class BlockParser(HTMLParser):
    """Collects blocks: runs of text that no block element begins or ends in.

    Forgiving like a browser: a block start ends an open paragraph, missing end tags end with their
    parent, stray end tags are ignored. Character references are decoded, white space becomes one space.
    """

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known, self.blocks, self.count = known, [], 0
        self.stack = [_Element("", 0, frozenset(), False)]
        self.text: list[str] = []
        self.letters, self.linked, self.in_link = 0, 0, False

    def _context(self, tag: str, attrs) -> frozenset[str]:
        parent = self.stack[-1].context
        own = {f"in:{tag}"}
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                own.update(f"named:{t}" for t in _TOKEN.findall(value.lower()))
        if self.known is not None:
            own &= self.known
        return parent if own <= parent else parent | own

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            container = self.stack[-2].number if len(self.stack) > 1 else 0
            self.blocks.append(Block(text, top.tag, top.context, container, self.linked / max(1, self.letters), top.label))
        self.text, self.letters, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        top = self.stack[-1].tag
        if top == "head" and tag not in HEAD_TAGS or tag in ENDS_SILENT.get(top, ()):
            self.stack.pop()
        if tag == "a":
            self.in_link = True
        if tag == "br":
            self.text.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            return
        if tag in BLOCK_TAGS:
            self._flush()
            self._close_open({"p"} | ENDS.get(tag, set()))
            if tag == "hr":
                return
        elif tag not in SILENT_TAGS:
            return
        self.count += 1
        parent, label = self.stack[-1], dict(attrs).get(LABEL)
        self.stack.append(_Element(tag, self.count, self._context(tag, attrs), parent.label if label is None else label == "1",
                                   parent.silent or tag in SILENT_TAGS))

    def _close_open(self, tags: set[str]) -> None:
        """Ends the innermost elements down to one of these kinds, if only inline or such elements are open above it."""
        while len(self.stack) > 1 and self.stack[-1].tag in tags:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag in SILENT_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in BLOCK_TAGS or tag in SILENT_TAGS:
            at = len(self.stack) - 1
            while at and self.stack[at].tag != tag:
                at -= 1
            if at:
                if tag in BLOCK_TAGS:
                    self._flush()
                del self.stack[at:]

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and data.strip():
            self.stack.pop()
        if not self.stack[-1].silent:
            self.text.append(data)
            size = len(data)
            self.letters += size
            self.linked += size if self.in_link else 0

    def unknown_decl(self, data):
        """CDATA sections and the like are no text."""


def blocks_of(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    parser = BlockParser(known)
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.blocks


def features(block: Block, at: int, total: int) -> list[str]:
    """Names of the binary features of a block: its ancestors and their names, its tag, its text."""
    words = block.text.count(" ") + 1
    size = "1" if words < 2 else "4" if words < 5 else "10" if words < 11 else "25" if words < 26 else "60" if words < 61 else "many"
    links = "none" if block.link_share == 0 else "some" if block.link_share < 0.4 else "most" if block.link_share < 0.9 else "all"
    end = block.text[-1]
    lowered = block.text.lower()
    found = [*block.context, "bias", f"tag:{block.tag}", f"words:{size}", f"links:{links}", f"tag:{block.tag}/words:{size}",
             f"words:{size}/links:{links}", "end:stop" if end in ".!?…\"'”»。" else "end:other"]
    if "©" in lowered or "copyright" in lowered:
        found.append("text:copyright")
    if "|" in lowered or "·" in lowered or "»" in lowered:
        found.append("text:separator")
    if "@" in lowered or "http" in lowered:
        found.append("text:address")
    if sum(c.isdigit() for c in lowered) * 4 > len(lowered):
        found.append("text:digits")
    if block.text[:1].islower():
        found.append("start:lower")
    found.append("place:first" if at == 0 else "place:last" if at == total - 1 else "place:inner")
    return found
