"""Operator 8, edit-aware token counts.

Each document keeps its pre-tokens under a segment tree with the sums of characters and of tokens. An edit re-encodes only
the pre-tokens that it touches, those before it that look at text it changes, and those after it until the old and the new
cuts meet again; then the sums on the way to the root are updated. Counts equal those of the edited text encoded anew.
The text lies in pieces in the leaves, so an edit copies those leaves that it touches and never the whole; a leaf that has grown is
split.

The registered query revises every text: long numbers are masked, and a passage is inserted, one cut out and one
replaced at places that a hash of the text draws, so that each document's tree is edited. Edits at equal places come in that order.

Null text counts as empty: zero tokens, no edits. Null or repeated doc_ids and further columns don't matter; each row is
counted by itself. A narrow map: no shuffle, memory for one slice and a bounded memo of pre-tokens. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

#: How far past its end a pre-token of the expression below looks: a run of white space gives its last one to the next word.
LOOK_AHEAD = 2
#: Pre-tokens in a leaf of the tree.
LEAF = 32
MEMO_WORDS = 400_000

Edit = tuple[int, int, str]


class PreTokens:
    """Cuts by the tokenizer's expression, and tokens of each pre-token through a memo."""

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO_WORDS):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.memo, self.most = regex.compile(pattern), {}, memo
        # Of one pre-token at a time: the expression of the encoding takes it whole.
        self.encoding = tiktoken.Encoding("counted", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo[x] for x in parts]
        except KeyError:
            pass
        if len(memo) > self.most:
            memo.clear()
        encode = self.encoding.encode_ordinary
        out = []
        for x in parts:
            n = memo.get(x)
            if n is None:
                n = len(encode(x))
                if len(x) <= 64:
                    memo[x] = n
            out.append(n)
        return out


class CountTree:
    """A document's pre-tokens, with its text in pieces, in leaves of a segment tree with sums of characters and tokens."""

    def __init__(self, text: str, pre: PreTokens):
        self.pre, self.reencoded = pre, 0
        parts = pre.cut(text)
        self._plant(parts, pre.counts(parts))

    def _plant(self, parts: list[str], counts: list[int]) -> None:
        cuts = range(0, max(1, len(parts)), LEAF)
        self.texts = ["".join(parts[i : i + LEAF]) for i in cuts]
        self.lengths = [list(map(len, parts[i : i + LEAF])) for i in cuts]
        self.counts = [counts[i : i + LEAF] for i in cuts]
        self._sum_up()

    def _sum_up(self) -> None:
        self.leaves = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = ([0] * (2 * self.leaves) for _ in range(2))
        for tree, leaves in ((self.chars, self.lengths), (self.tokens, self.counts)):
            tree[self.leaves : self.leaves + len(leaves)] = map(sum, leaves)
            for i in range(self.leaves - 1, 0, -1):
                tree[i] = tree[2 * i] + tree[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds character ``at`` (the end: past the last)."""
        if at >= self.chars[1]:
            leaf = len(self.lengths) - 1
            return leaf, len(self.lengths[leaf]), self.chars[1]
        i, begin = 1, 0
        while i < self.leaves:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        leaf = i - self.leaves
        for k, n in enumerate(self.lengths[leaf]):
            if at < begin + n:
                return leaf, k, begin
            begin += n
        raise AssertionError("sums don't fit the leaves")

    def _update(self, leaf: int) -> None:
        i = self.leaves + leaf
        self.chars[i], self.tokens[i] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while i > 1:
            i >>= 1
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, put: str) -> None:
        """text[start:end] becomes ``put``."""
        leaf, k, at = self._find(max(0, start - LOOK_AHEAD))
        kept = sum(self.lengths[leaf][:k])
        # Places from here on count from the first doubtful pre-token; near is the text that has been looked at so far.
        start, end, last = start - at, end - at, leaf
        near, shift = self.texts[leaf][kept:], len(put) - (end - start)

        def load(least: int) -> str:
            """The text of further leaves, ``least`` characters of it if there are as many."""
            nonlocal last
            got, n = [], 0
            while last + 1 < len(self.texts) and n < least:
                last += 1
                got.append(self.texts[last])
                n += len(got[-1])
            return "".join(got)

        if len(near) < end:
            near += load(end - len(near))
        near = near[:start] + put + near[end:]
        # The old cuts, walked along with the new ones: the place of the next one, and which leaf and place in it come after it.
        old, x, j = 0, leaf, k
        parts: list[str] = []
        new, resume = 0, start + len(put)
        match = self.pre.pattern.match
        while True:
            while old + shift < new or old < end:
                while j >= len(self.lengths[x]) and x + 1 < len(self.lengths):
                    x, j = x + 1, 0
                if j >= len(self.lengths[x]):
                    break
                old, j = old + self.lengths[x][j], j + 1
            if new >= resume and old >= end and old + shift == new:
                break
            if new + LOOK_AHEAD >= len(near):
                near += load(LOOK_AHEAD + 1)
            if new >= len(near):
                break
            m = match(near, new)
            while m.end() + LOOK_AHEAD > len(near) and (more := load(len(near))):
                near += more
                m = match(near, new)
            parts.append(m.group())
            new = m.end()
        self.reencoded += len(parts)
        lengths, counts, text = list(map(len, parts)), self.pre.counts(parts), near[:new]
        gone = sum(self.lengths[x][:j])
        if leaf == x:
            self.texts[leaf] = self.texts[leaf][:kept] + text + self.texts[leaf][gone:]
            self.lengths[leaf][k:j], self.counts[leaf][k:j] = lengths, counts
        else:
            self.texts[leaf], self.texts[x] = self.texts[leaf][:kept] + text, self.texts[x][gone:]
            self.lengths[leaf][k:], self.counts[leaf][k:] = lengths, counts
            for i in range(leaf + 1, x):
                self.texts[i], self.lengths[i], self.counts[i] = "", [], []
                self._update(i)
            self.lengths[x][:j], self.counts[x][:j] = [], []
            self._update(x)
        if len(self.lengths[leaf]) > 4 * LEAF:
            self._split(leaf)
        else:
            self._update(leaf)

    def _split(self, leaf: int) -> None:
        """A leaf that has grown becomes several."""
        text, lengths, counts = self.texts[leaf], self.lengths[leaf], self.counts[leaf]
        ends = np.cumsum([0, *lengths])
        cuts = range(0, len(lengths), LEAF)
        self.texts[leaf : leaf + 1] = [text[ends[i] : ends[min(i + LEAF, len(lengths))]] for i in cuts]
        self.lengths[leaf : leaf + 1] = [lengths[i : i + LEAF] for i in cuts]
        self.counts[leaf : leaf + 1] = [counts[i : i + LEAF] for i in cuts]
        self._sum_up()


_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")


def mask_long_numbers(text: str) -> list[Edit]:
    """Edits that put <number> for each number of 13 to 19 digits, from the end of the text to its start."""
    return [(m.start(), m.end(), "<number>") for m in _LONG_NUMBER.finditer(text)][::-1]


def revise(text: str) -> list[Edit]:
    """What the registered query does to a text: long numbers masked, a passage inserted, one cut out and one replaced.

    Places and lengths are drawn by a hash of the text, so that every part of a text, its ends too, has its turn.
    """
    out = mask_long_numbers(text)
    if not text:
        return out
    from xxhash import xxh64_intdigest

    n = len(text) + sum(len(put) - (end - start) for start, end, put in out)
    draw = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    for k, put in enumerate((" [added 12 words]\n", "", "it's replaced")):
        draw = draw * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1
        start = (draw >> 32) % (n + 1)
        end = start if k == 0 else min(n, start + draw % 41)
        out.append((start, end, put))
        n += len(put) - (end - start)
    return out


SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_reencoded bigint"


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, edits: Callable[[str], list[Edit]] = mask_long_numbers) -> DataFrame:
    """A row for each document: tokens before and after its edits, and how many pre-tokens the edits had encoded again.

    edits: gives a text's edits (start, end, replacement), each in terms of the text as the edits before left it.
    """

    def make():
        pre = PreTokens(ranks_path, pattern)

        def counted(text: str) -> tuple:
            tree = CountTree(text, pre)
            n, before, some = sum(map(len, tree.lengths)), tree.total, edits(text)
            for e in some:
                tree.edit(*e)
            return n, before, len(some), tree.total, tree.reencoded

        def work(part: pa.RecordBatch) -> list:
            rows = np.array([counted(x) for x in whole_texts(part.column("text"))], np.int64).reshape(-1, 5)
            return [part.column("doc_id"), *(pa.array(c) for c in rows.T)]

        return work

    return map_texts(docs, SCHEMA, make)
