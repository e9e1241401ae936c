"""Operator 7, secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams that any match must hold is derived. For a slice of
documents, postings (trigram -> documents) are built for all trigrams that some query names; queries are evaluated by
intersecting and uniting postings; only the documents left are searched with the expression itself. Rules from which
no mandatory trigram follows are searched in every document.

Null text counts as empty: zero counts and the hash of the empty string. Null or repeated doc_ids and further columns
don't matter: a row gives a row. Whole texts are searched. A narrow map: no shuffle. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts (0: the match) and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, in this order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds of public credential formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("urlauth", r"[a-z][a-z0-9+]{1,9}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)

# ---- from an expression to a Boolean query ---------------------------------------------------------------------------
# A query is True (no condition), a frozenset of trigrams (all needed), or ("or", queries) / ("and", queries).
MOST_STRINGS = 64


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _either(qs):
    qs = list(dict.fromkeys(qs))
    return True if True in qs else qs[0] if len(qs) == 1 else ("or", tuple(qs))


def _grams(s: str):
    out = frozenset(s[i : i + 3] for i in range(len(s) - 2))
    return out or True


def _literal(strings: set[str]):
    return _either([_grams(s) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(the strings that the items can match, lower-cased, or None if too many; a query beyond those strings)."""
    strings: set[str] | None = {""}
    query: object = True

    def close():
        nonlocal strings, query
        if strings:
            query = _both(query, _literal(strings))
        strings = None

    def extend(more: set[str] | None, q: object):
        nonlocal strings, query
        query = _both(query, q)
        if more is None:
            close()
        elif strings is None:
            strings = set(more)
        elif len(strings) * len(more) > MOST_STRINGS:
            close()
            strings = set(more)
        else:
            strings = {a + b for a in strings for b in more}

    for op, arg in items:
        if op is _c.LITERAL and arg < 128:
            extend({chr(arg).lower()}, True)
        elif op is _c.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is _c.LITERAL and x < 128:
                    chars.add(chr(x).lower())
                elif kind is _c.RANGE and x[1] - x[0] < 6 and x[1] < 128:
                    chars |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            extend(chars if chars and len(chars) <= 6 else None, True)
        elif op is _c.SUBPATTERN:
            extend(*_walk(arg[3]))
        elif op is _c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None and q is True for s, q in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
                extend(set().union(*(s for s, _ in parts)), True)
            else:
                extend(None, _either([_both(q, _literal(s)) if s else q for s, q in parts]))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = arg
            got, q = _walk(inner)
            if low == 0 and high == 1 and got is not None and q is True:
                extend(got | {""}, True)
            elif low == 0:
                extend(None, True)
            elif low == high and got is not None and len(got) ** min(low, 8) <= MOST_STRINGS and low <= 8:
                for _ in range(low):
                    extend(got, q)
            else:
                extend(got, q)
                close()
        elif op is _c.AT:
            continue
        else:
            close()
    return strings, query


def trigram_query(pattern: str):
    """What trigrams (lower case) a text must hold if the expression matches in it; True if none follow."""
    strings, query = _walk(_p.parse(pattern))
    return _both(query, _literal(strings)) if strings else query


def trigrams_of(query) -> set[str]:
    return set() if query is True else set(query) if isinstance(query, frozenset) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of a slice of texts for a fixed set of trigrams."""

    def __init__(self, grams: set[str]):
        self.grams = sorted(grams)
        self.slot = np.zeros(1 << 21, np.int16)  # three 7-bit characters
        for i, g in enumerate(self.grams):
            self.slot[ord(g[0]) << 14 | ord(g[1]) << 7 | ord(g[2])] = i + 1
        self.lower = np.full(256, 0, np.uint32)
        self.lower[:128] = [ord(chr(i).lower()) for i in range(128)]

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """trigram -> a flag for each text."""
        out = {g: np.zeros(len(texts), np.bool_) for g in self.grams}
        if not texts:
            return out
        codes = self.lower[np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)]
        got = self.slot[codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]]
        at = np.flatnonzero(got)
        starts = np.cumsum([0, *(len(x) + 2 for x in texts[:-1])])
        which = np.searchsorted(starts, at, side="right") - 1
        for i, g in enumerate(self.grams):
            out[g][which[got[at] == i + 1]] = True
        return out


def evaluate(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.ones(n, np.bool_)
    if isinstance(query, frozenset):
        return np.logical_and.reduce([postings[g] for g in query])
    parts = [evaluate(q, postings, n) for q in query[1]]
    return np.logical_or.reduce(parts) if query[0] == "or" else np.logical_and.reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        # A run of one class that must have a least length fails sooner if the expression says so; matches are the same.
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.fast = {"hex": re.compile(r"[0-9a-f]{16}")}
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(set().union(*map(trigrams_of, self.queries)))

    def found(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), in order of start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.postings([x.encode("utf-8", "surrogatepass") for x in texts])
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            fast = self.fast.get(rule.kind)
            for i in np.flatnonzero(evaluate(query, postings, len(texts))):
                if fast and not fast.search(texts[i]):
                    continue
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for x in out:
            x.sort()
        return out


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of the base spans, and all spans as kind:start:end.

    Positions are code points, the end is exclusive. rules must begin with BASE.
    """

    def make():
        scanner, kinds = Scanner(rules), [r.kind for r in rules]
        said = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)

        def work(part: pa.RecordBatch) -> list:
            found = scanner.found(whole_texts(part.column("text")))
            base = [[s for s in x if s[1] < len(BASE)] for x in found]
            return [
                part.column("doc_id"),
                *(pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE))),
                pa.array([hashlib.sha256(said(x).encode()).hexdigest() for x in base]),
                pa.array([said(x) for x in found], pa.string()),
                pa.array([len(x) for x in found], pa.int64()),
            ]

        return work

    return map_texts(docs, SCHEMA, make)
