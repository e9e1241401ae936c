"""Operator 6, packing: best-fit decreasing over a segment tree of remaining capacities.

A document's ids are cut into full windows first; what is left is packed, longest piece first, into the open window
with the least sufficient room, which a segment tree indexed by remaining capacity finds in O(log size). A window that
would end with more than ``slack`` ids of padding is cut into sequences whose lengths are powers of two, which need none.

Packing runs within runs of about ``RUN_IDS`` ids of one partition: no shuffle and bounded memory, and since windows of
a run are closed by then, padding stays under slack / size at any input size. sequence_id is the partition number in the
upper 32 bits and a counter below, so a task that runs again gives the same ids.

Null text counts as empty: the end id alone. Null or repeated doc_ids and further columns don't matter: each row is a
document of its own. Empty table: empty result.

Token ids come from a public tokenizer file. Where its normalizer and pre-tokenizer are those written down below, white
space ends a pre-token, so words are encoded once each and kept in a bounded memo; any other file's tokenizer gets whole
texts. Either way the ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, whole_texts

SIZE = 2048
END_ID = 1
RUN_IDS = 4_000_000
MEMO_WORDS = 800_000
SLACK = 48
#: More text at once than for other operators: a word that is new to several of its documents is looked up once.
SLICE_BYTES = 4 << 20


# The rules for which pre-tokens may be cut here, as a tokenizer file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_known(said: dict) -> bool:
    """Whether a tokenizer file has these rules, a plain BPE model, and no added token but such as ``<|...``."""
    model, added = said.get("model") or {}, said.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and bool(model.get("end_of_word_suffix"))
    return said.get("normalizer") == NORMALIZER and said.get("pre_tokenizer") == PRE_TOKENIZER and plain and all(x["content"].startswith("<|") for x in added)


class TokenIds:
    """Ids of texts as little-endian uint32 bytes, through a bounded memo of pre-tokens.

    A text of Latin letters, ASCII digits and punctuation is cut into pre-tokens here (normalisation is lower case alone
    for it); the tokenizer's model encodes each new one. Any other text is cut at white space, which always ends a
    pre-token, and each new word goes through the whole tokenizer. Either way ids are those of the whole text.
    """

    LETTERS = bytes([*b"abcdefghijklmnopqrstuvwxyz", *range(0xE0, 0xF7), *range(0xF8, 0x100)])
    CAPITALS = bytes([*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
    SAFE = LETTERS + CAPITALS + bytes([0xDF, 9, 10, 11, 12, 13, *range(32, 127)])
    LOWER = bytes.maketrans(CAPITALS, bytes(x + 32 for x in CAPITALS))
    CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
    WORD = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+")
    AT_ONCE = 400

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are Spark's to share out
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), memo, cuts_known(said)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if not self.known:
            return
        self.plain = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}))
        suffix, vocab = said["model"].get("end_of_word_suffix") or "", said["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, np.bool_)
        self.ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}  # of Latin-1 pre-tokens
        self.words: dict[str, bytes] = {}  # of words of other texts
        # How byte-level pre-tokens write bytes: printable Latin-1 as itself, all others from code point 256 on.
        odd = [i for i in range(256) if not (33 <= i < 127 or 161 <= i < 173 or i >= 174)]
        self.shown = {b: 256 + k for k, b in enumerate(odd) if b != 32}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, parts: list[bytes]) -> None:
        """New pre-tokens: those of letters some hundreds at a time, told apart by the marks of word ends."""
        letters, others = [], []
        for x in parts:
            (letters if self.WORD.fullmatch(x) else others).append(x)
        groups = [letters[i : i + self.AT_ONCE] for i in range(0, len(letters), self.AT_ONCE)]
        said = [b" ".join(g).decode("latin-1").encode("utf-8").decode("latin-1").translate(self.shown) for g in groups]
        for group, e in zip(groups, self.plain.encode_batch_fast(said, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(group):
                others += group
                continue
            data, at = ids.tobytes(), 0
            for w, to in zip(group, ends.tolist(), strict=True):
                self.memo[w] = data[at:to]
                at = to
        self.memo.update(zip(others, self._whole([x.decode("latin-1") for x in others]), strict=True))

    def _parts(self, text: str) -> list[bytes] | None:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if data.translate(None, self.SAFE) or b"<|" in data else self.CUT.findall(data.translate(self.LOWER))

    def _other(self, text: str) -> bytes:
        words = [w.decode("utf-8") for w in text.encode("utf-8").split()]
        new = list(set(words).difference(self.words))
        if len(self.words) + len(new) > self.most // 4:
            self.words.clear()
            new = list(set(words))
        self.words.update(zip(new, self._whole(new), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return self._whole(texts)
        each = [self._parts(x) for x in texts]
        parts = set().union(*(x for x in each if x))
        new = parts.difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = parts
        if new:
            self._encode(list(new))
        return [self._other(x) if p is None else b"".join(map(self.memo.__getitem__, p)) for x, p in zip(texts, each, strict=True)]


class Capacities:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least room of ``least`` or more, removed, and its room."""
        i, count = self.leaves + least, self.count
        while not count[i]:
            while i & 1:  # a right child: what lies to the right of its parent is next
                i >>= 1
                if not i:
                    return None
            i += 1
            if not i & (i - 1):
                return None  # past the last leaf of this level
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.windows[room].pop(), room


def best_fit(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Windows of indices of pieces (each under ``size`` or equal to it), by best-fit decreasing; ties by index."""
    tree, windows = Capacities(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if got := tree.take(n):
            window, room = got
            windows[window].append(i)
        else:
            window, room = len(windows), size
            windows.append([i])
        if room > n:
            tree.add(room - n, window)
    return windows


def arranged(doc_ids: list[int], size: int = SIZE, slack: int = SLACK) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces; doc_ids has each document's number of ids."""
    sequence, rest = 0, []
    for d, n in enumerate(doc_ids):
        for start in range(0, n - n % size, size):
            yield d, start, size, sequence, 0
            sequence += 1
        if n % size:
            rest.append((d, n - n % size, n % size))
    for window in best_fit(np.array([x[2] for x in rest], np.int64), size):
        fill = sum(rest[i][2] for i in window)
        limits = [fill]
        if size - fill > slack and fill & (fill - 1):
            limits = [1 << b for b in reversed(range(fill.bit_length())) if fill >> b & 1]
        at, k = 0, 0
        for i in window:
            d, start, n = rest[i]
            while n:
                m = min(n, limits[k] - at)
                yield d, start, m, sequence, at
                start, n, at = start + m, n - m, at + m
                if at == limits[k]:
                    sequence, at, k = sequence + 1, 0, k + 1


SCHEMA = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """A row for each piece: where it comes from, where it lies, a checksum of its ids and, with_ids, the ids."""
    out = T.StructType([*SCHEMA.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, words, last = to_arrow_schema(out), TokenIds(tokenizer), np.array([end_id], "<u4").tobytes()
        base, used = TaskContext.get().partitionId() << 32, 0
        names: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, held
            pieces = list(arranged([len(x) // 4 for x in ids], size, slack))
            for lo in range(0, len(pieces), 4096):
                some = pieces[lo : lo + 4096]
                parts = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in some]
                columns = [[names[p[0]] for p in some], [p[1] for p in some], [p[2] for p in some], [zlib.crc32(x) for x in parts], [len(ids[p[0]]) // 4 for p in some], [base + used + p[3] for p in some], [p[4] for p in some]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    ends = np.cumsum([0, *(p[2] for p in some)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))).cast(arrow[-1].type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            used += pieces[-1][3] + 1 if pieces else 0
            names.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                names += part.column("doc_id").to_pylist()
                got = [x + last for x in words.of(whole_texts(part.column("text")))]
                ids += got
                held += sum(map(len, got)) // 4
                if held >= RUN_IDS:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, out)
