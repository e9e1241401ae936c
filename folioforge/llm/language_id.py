"""Operator 2, language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded amount of labelled text is built. A text is parsed into the longest
phrases that occur in that training text (phrases restart at the borders of ``BLOCK``-letter blocks, so that any text,
however long, is parsed in parallel lanes). The language with the fewest phrases, each weighed by the logarithm of its
training text's length, wins; ties go to the first language in order of name.

Training: at most ``slots`` documents and ``train_letters`` letters a language, chosen by hash of doc_id among those with
text, language and a doc_id that ``learn`` admits; each of these documents gives as many letters as any other that is long enough, of a
very long one from a place that its doc_id draws. Of several texts with one doc_id the one with the least hash counts. Beyond ten languages each gets ``MOST_STATES`` / 2 letters divided by their number. These bounds don't
grow with the input; every text is predicted whole. Transitions are hashed, some hundred bytes a state, so memory doesn't
depend on the size of an alphabet.

Null text, or text without a letter: ``und``, score 0. Null doc_id: predicted, never learnt from, held_out false. No
language to learn from: ``und`` everywhere. Repeated rows and further columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BLOCK = 256
TRAIN_LETTERS = 20_000
SLOTS = 64
#: States of all automata together; with very many languages each gets less training text.
MOST_STATES = 400_000
UNKNOWN = "und"


def letters(text: str) -> str:
    """Lower case, every run of other characters than letters as one space, a space at either end."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def suffix_automaton(s: str) -> list[dict[str, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root and no transition's target."""
    to: list[dict[str, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in s:
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


class Transitions:
    """(state, symbol) -> state, 0 for none: a hash table of four slots or more a transition, whatever the alphabet's size.

    A slot is one number, state and symbol above TO_BITS bits of the state that follows; -1 is a free slot.
    """

    TO_BITS = 24

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, n_symbols: int):
        self.n_symbols = np.int64(n_symbols)
        self.bits = max(4, (4 * len(to) - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        key = states * self.n_symbols + symbols
        if len(key) and (int(to.max()) >> self.TO_BITS or int(key.max()) >> 63 - self.TO_BITS):
            raise ValueError("too many states or symbols")
        cell, at = key << self.TO_BITS | to, self._slot(key)
        while len(cell):  # the first to come to a free slot takes it, the others go on to the next one
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free[::-1]]] = cell[free[::-1]]
            left = self.slots[at] != cell
            cell, at = cell[left], (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = states * self.n_symbols + symbols
        slot = self._slot(key)
        held = self.slots[slot]
        other = (held >> self.TO_BITS) != key
        out = held & ((1 << self.TO_BITS) - 1)
        out[other] = 0
        flat = out.reshape(-1)
        at = np.flatnonzero(other & (held >= 0))
        key, slot = key.reshape(-1)[at], slot.reshape(-1)[at]
        while len(at):  # what another key has taken the place of
            slot = (slot + 1) & self.mask
            held = self.slots[slot]
            hit = held >> self.TO_BITS == key
            flat[at[hit]] = held[hit] & ((1 << self.TO_BITS) - 1)
            on = np.flatnonzero(~hit & (held >= 0))
            at, key, slot = at[on], key[on], slot[on]
        return out


class Parser:
    """All languages' automata in one table of transitions."""

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        self.weight = np.array([math.log2(max(2, len(training[x]))) for x in self.langs])
        used = sorted(set().union(*map(set, training.values()))) if training else []
        self.symbols = len(used) + 1  # the last one: a letter no language has shown
        number = {c: i for i, c in enumerate(used)}
        built = [suffix_automaton(training[x]) for x in self.langs]
        self.root = np.cumsum([1, *map(len, built)])[:-1].astype(np.int64)
        rows = [(root + i, number[c], root + j) for root, states in zip(self.root.tolist(), built, strict=True) for i, step in enumerate(states) for c, j in step.items()]
        self.table = Transitions(*np.array(rows, np.int64).reshape(-1, 3).T.copy(), self.symbols)
        # code point -> symbol + 1; 0: no letter. Lower case where that is one character.
        self.code = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.code[i] = 1 + number.get(low if len(low) == 1 else c, self.symbols - 1)
        self.space = 1 + number.get(" ", self.symbols - 1)

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts one after another, and each text's number of them (0: no letter)."""
        data = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        code = self.code[data]
        gap = code == 0
        keep = ~gap
        keep[0] = True
        np.logical_or(keep[1:], ~gap[:-1], out=keep[1:])  # a run of others: one space
        sizes = np.cumsum([0, *(len(x) + 1 for x in texts)])
        keep[sizes[:-1]] |= True  # a space, or the first letter
        counts = np.add.reduceat(keep.astype(np.int64), sizes[:-1])
        some = np.add.reduceat((~gap).astype(np.int64), sizes[:-1])
        code = code[keep]
        code[code == 0] = self.space
        dropped = np.repeat(some == 0, counts)
        return (code[~dropped] - 1).astype(np.int32), np.where(some > 0, counts, 0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by each language, and each text's symbols."""
        stream, counts = self.stream(texts)
        out = np.zeros((len(texts), len(self.langs)))
        blocks = -(-counts // BLOCK)
        if not blocks.sum() or not self.langs:
            return out, counts
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(counts) - counts)[owner] + nth * BLOCK
        length = np.minimum(counts[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        lanes = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # lanes longer than t
        table, n = self.table, len(self.langs)
        roots = self.root[:, None]
        first = table(roots, np.arange(self.symbols))
        state = np.broadcast_to(roots, (n, len(owner))).copy()
        found = np.zeros((n, len(owner)), np.int32)
        for t in range(int(length[0])):
            k = lanes[t]
            c = stream[begin[:k] + t]
            now = state[:, :k]
            ahead = table(now, c)
            miss = ahead == 0
            again = first[:, c]
            found[:, :k] += miss & (now != roots)
            found[:, :k] += again == 0
            state[:, :k] = np.where(miss, np.where(again == 0, roots, again), ahead)
        found += state != roots
        for i in range(n):
            out[:, i] = np.bincount(owner, weights=found[i], minlength=len(texts))
        return out, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: the winner's share of 2 ** -bits, bits a letter by the language's phrases."""
        got, counts = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = got * self.weight / np.maximum(counts, 1)[:, None]
        best = np.argmin(bits, axis=1)
        shares = np.exp2(4 * (bits.min(axis=1, keepdims=True) - bits))
        score = np.where(counts > 0, 1 / shares.sum(axis=1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist(), strict=True)], score


_PARSERS: dict[tuple, Parser] = {}


def parser_of(training: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each Python worker."""
    if training not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[training] = Parser(dict(training))
    return _PARSERS[training]


def training_texts(docs: DataFrame, learn: Column, train_letters: int = TRAIN_LETTERS, slots: int = SLOTS) -> tuple[tuple[str, str], ...]:
    """(language, letters) pairs: for each language the documents with the least hash in each of ``slots`` slots.

    One aggregation of numbers (a row for each language and slot leaves a task), then a read of just those documents.
    """
    mark = F.xxhash64(F.col("doc_id"))
    able = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = able.groupBy("lang", F.pmod(mark, F.lit(slots)).alias("slot")).agg(F.min(F.struct(mark.alias("h"), "doc_id")).alias("m")).select("lang", F.col("m.doc_id").alias("doc_id"))
    ids = sorted({(r["lang"], r["doc_id"]) for r in chosen.collect()})
    langs = sorted({x for x, _ in ids})
    if not langs:
        return ()
    most = min(train_letters, MOST_STATES // (2 * len(langs)))
    # Of texts with the same doc_id the one with the least hash; of a long one a part from a place that the doc_id draws.
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - 4 * most, F.lit(0)) + 1) + 1
    some = able.filter(F.col("doc_id").isin([d for _, d in ids])).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = some.select("lang", "doc_id", F.substring("text", begin.cast("int"), F.lit(4 * most)).alias("text"))
    have: dict[str, list[str]] = {x: [] for x in langs}
    allowed = set(ids)
    for r in sorted(texts.toLocalIterator(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        if (r["lang"], r["doc_id"]) in allowed:
            have[r["lang"]].append(letters(r["text"]))
    return tuple((x, joined) for x in langs if (joined := fair_share(have[x], most)).strip())


def fair_share(texts: list[str], most: int) -> str:
    """The beginnings of all texts, ``most`` letters together: as much of each as of any other that is long enough."""
    left, share = most, {}
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), left // (len(texts) - k))
        left -= share[i]
    return "".join(x[: share[i]] for i, x in enumerate(texts))


def languages(docs: DataFrame, training: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def make():
        parser = parser_of(training)

        def work(part: pa.RecordBatch) -> list:
            texts = part.column("text").to_pylist()
            langs, score = parser.predict([x or "" for x in texts])
            return [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)]

        return work

    return map_texts(docs, "doc_id bigint, lang_pred string, score double", make)


def is_held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id's text has that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from documents that aren't held out."""
    training = training_texts(docs, ~is_held_out(4, 2))
    return languages(docs, training).select("doc_id", is_held_out(4, 2).alias("held_out"), "lang_pred", "score")
