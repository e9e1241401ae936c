"""Cards of a listing page: nested elements of HTML, found by a stack of open tags in Arrow batches.

Each page is read once from front to end, whatever its nesting. A card takes the first of each kind of field inside it; when it
closes, the card around it takes over what that one still lacks, so an event touches one card only and the work grows
with the page alone. Elements that are never closed end with the element around them, or with the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARXIV_ID

# Elements without content, those whose content is no markup, and which open element a new one closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {**{x: ("p",) for x in BLOCKS}, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Within these, an element of that name further out stays open.
WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "p": ("table", "td", "th", "button")}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ID = re.compile(ARXIV_ID, re.ASCII)
_STOP = re.compile("[\"'>]")
#: Texts of more than so many characters count as lines of a card, and as many of them are told.
LINE, LINES = 10, 3


def events(page: str) -> Iterator[tuple]:
    """("text", s), ("open", name, attributes as they stand) and ("close", name), in order. Comments and raw content are left out."""
    at, size, unpaired = 0, len(page), set()
    lower = page.lower()
    lower = lower if len(lower) == size else re.sub("[A-Z]", lambda m: m[0].lower(), page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        if start > at:
            yield "text", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<"
                at = start + 1
            continue
        end = name.end()
        while m := _STOP.search(page, end):
            end = m.end()
            if m[0] == ">":
                break
            if m[0] not in unpaired:  # a quote that nothing closes is a character like any other, and looked for once
                to = page.find(m[0], end)
                if to < 0:
                    unpaired.add(m[0])
                else:
                    end = to + 1
        else:
            end = size
        tag, at = name[0].lower(), end
        if closing:
            yield "close", tag
            continue
        yield "open", tag, page[name.end() : end]
        if tag in RAW:
            to = lower.find(f"</{tag}", at)
            at = size if to < 0 else to
        if tag in VOID:
            yield "close", tag


def attributes(said: str) -> dict[str, str]:
    """Names in lower case; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(said):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


class Card:
    __slots__ = ("number", "parent", "title", "arxiv_id", "code_url", "abstract", "text_id", "link_id", "lines")

    def __init__(self, number: int, parent: Card | None):
        self.number, self.parent = number, parent
        self.title = self.arxiv_id = self.code_url = self.abstract = self.text_id = self.link_id = ""
        self.lines: list[str] = []

    def text(self, said: str, heading: bool, body: bool) -> None:
        plain = html.unescape(said).strip()
        if not plain:
            return
        if heading and not self.title:
            self.title = plain[:200]
        if body and not self.abstract:
            self.abstract = plain[:500]
        if not self.text_id and (m := _ID.search(plain)):
            self.text_id = m[1]
        if len(self.lines) < LINES and len(plain) > LINE and plain not in self.lines:
            self.lines.append(plain)

    def link(self, address: str) -> None:
        m = None if self.arxiv_id and self.link_id else _ID.search(address)
        if m and not self.link_id:
            self.link_id = m[1]
        if m and not self.arxiv_id and "arxiv" in address:
            self.arxiv_id = m[1]
        if not self.code_url and "github.com" in address:
            self.code_url = address

    def close(self) -> None:
        p = self.parent
        if p is None:
            return
        for c in ("title", "arxiv_id", "code_url", "abstract", "text_id", "link_id"):
            if not getattr(p, c):
                setattr(p, c, getattr(self, c))
        p.lines += [x for x in self.lines if x not in p.lines][: LINES - len(p.lines)]


def is_card(tag: str, kind: str) -> bool:
    """An article, or a block with paper or card in its class."""
    return tag == "article" or tag == "div" and ("paper" in kind or "card" in kind)


def cards(page: str, card=is_card) -> list[Card]:
    """The cards of a page in the order in which they begin."""
    out: list[Card] = []
    stack: list[tuple[str, Card | None, bool, bool]] = []  # tag, its card, whether text in it is a heading, a body
    depths: defaultdict[str, list[int]] = defaultdict(list)
    inner: list[Card] = []

    def innermost(tags: tuple[str, ...]) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    def pop(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Closes the innermost open one of the tags, unless it is outside of an open one of the others, and all that is open within it."""
        to = innermost(tags)
        if to <= innermost(within):
            return
        while len(stack) > to:
            tag, own, _, _ = stack.pop()
            depths[tag].pop()
            if own is not None:
                inner.pop().close()

    for e in events(page):
        if e[0] == "text":
            if inner and stack:
                inner[-1].text(e[1], stack[-1][2], stack[-1][3])
        elif e[0] == "close":
            pop((e[1],))
        else:
            tag = e[1]
            if tag in CLOSES:
                pop(CLOSES[tag], WITHIN.get(CLOSES[tag][0], ()))
            has = attributes(e[2]) if tag in ("a", "div", "article") or card is not is_card else {}
            kind, own = has.get("class", ""), None
            if card(tag, kind):
                own = Card(len(out), inner[-1] if inner else None)
                out.append(own)
                inner.append(own)
            address = has.get("href", "") if tag == "a" else ""
            if address and inner:
                inner[-1].link(address)
            depths[tag].append(len(stack))
            stack.append((tag, own, tag in ("h2", "h3") or "/papers/" in address, tag == "p" or tag == "div" and "abstract" in kind))
    while inner:
        inner.pop().close()
    return out


def page_cards(pages: DataFrame, key: str = "page_id", column: str = "html", card=is_card) -> DataFrame:
    """key, card (from 0 in each page), parent (the card around it, -1 if none), and of its inside: title (first text of a
    second- or third-level heading, or of a link to a paper), arxiv_id (first in a link to arXiv), code_url (first link to a repository
    host), abstract (first text of a paragraph), text_id (first identifier in text, else in a link), lines (the first three texts
    of some length). Missing fields are ''. A null page has no card.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(1)):
                found = cards(page.as_py() or "", card)
                if found:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([i] * len(found))), pa.array([c.number for c in found], pa.int32()), pa.array([c.parent.number if c.parent else -1 for c in found], pa.int32()),
                        *(pa.array([f(c) for c in found], pa.string()) for f in (lambda c: c.title, lambda c: c.arxiv_id, lambda c: c.code_url, lambda c: c.abstract, lambda c: c.text_id or c.link_id)),
                        pa.array([c.lines for c in found], pa.list_(pa.string())),
                    ], names=[key, "card", "parent", "title", "arxiv_id", "code_url", "abstract", "text_id", "lines"])

    of = dict(pages.dtypes)[key]
    return pages.select(key, column).mapInArrow(run, f"`{key}` {of}, card int, parent int, title string, arxiv_id string, code_url string, abstract string, text_id string, lines array<string>")


def listed_papers(found: DataFrame, source: str = "hf_papers") -> DataFrame:
    """Cards with a title and an identifier, as search results."""
    return found.filter("title <> '' and arxiv_id <> ''").select("*", F.lit(source).alias("source"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("source_url"))
