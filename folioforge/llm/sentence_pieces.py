"""Operator 12, SentencePiece encoding and decoding of models of the merge type.

A merge-type model starts from single characters and again and again merges the neighbours whose union is the piece of
the best score, leftmost first. The result is the only sequence of pieces of which each two neighbours, merged anew from their
characters, come out as they are. So it is found without merging the text: at each position the longest piece that an
Aho-Corasick automaton has seen there is tried, then its shorter beginnings; one that gets along with the piece before is
taken; where none does, the position is marked as failed in a bit field and the piece before is taken back. What comes
before a position is settled by the text, so a failed position fails for good, and the work grows with the text alone.

No piece of such a model has a blank after another character, so merges never cross from a word to the next blank; a text is
encoded word by word, and words are kept in a bounded memo. A model with other pieces, other rules of normalisation, or
without pieces for single bytes, is an error when the operator is planned.

A narrow map without a shuffle; memory is bounded by a slice of texts (or one text), the memos, and the model. Null text
counts as empty: begin and end alone, which decode to ''. Null or repeated doc_ids and further columns don't matter: each row is
a document of its own. Empty table: empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

#: Words of up to so many characters are kept, as many of them in either generation; so are pairs of neighbours.
MEMO_LENGTH, MEMO_WORDS, MEMO_PAIRS = 40, 150_000, 300_000
# The mark that stands for a blank, and what unknown ids decode to.
BLANK, UNKNOWN = "▁", " ⁇ "


def fields(message: bytes):
    """number and value of each field of a protocol buffer message; integers, or bytes of the other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        length = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at : at + length]
        at += length


class Words(dict):
    """Bytes of the ids (little-endian uint32) of words, encoded when they are first asked for.

    A full memo becomes the older generation, from which words that are asked for again come back.
    """

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Pieces:
    """A model's pieces, with an encoder by backtracking and a decoder."""

    # Field numbers and kinds of the model format.
    NORMAL, UNK, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2

    def __init__(self, model: bytes):
        import struct

        import ahocorasick

        self.text, self.kind, score, rules, trainer = [], [], [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece[1].decode("utf-8"))
                score.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kind.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.score = {t: s for t, s, k in zip(self.text, score, self.kind, strict=True) if k == self.NORMAL}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == self.NORMAL}
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == self.BYTE}
        single = {t for t in self.id if len(t) == 1}
        odd = [what for what, wrong in (
            ("it isn't of the merge type", trainer.get(3) != self.MERGES), ("it normalises texts", bool(rules.get(2)) or bool(rules.get(6)) or rules.get(4, 1) != 0 or rules.get(3, 1) != 1 or rules.get(5, 1) != 1),
            ("it has pieces of other kinds", not set(self.kind) <= {self.NORMAL, self.UNK, self.CONTROL, self.BYTE}), ("bytes have no pieces", len(self.byte) != 256),
            ("blanks end its words", trainer.get(24, 0) != 0), ("a piece has a blank within", any(BLANK in t.lstrip(BLANK) for t in self.id)), ("a character has no piece", not {c for t in self.id for c in t} <= single),
        ) if wrong]
        if odd:
            raise ValueError(f"this model can't be encoded by backtracking: {', '.join(odd)}")
        self.controls = [i for i, k in enumerate(self.kind) if k == self.CONTROL]
        self.bos, self.eos = self.text.index("<s>"), self.text.index("</s>")
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(single)))}])")
        self.cut = re.compile(" *[^ ]+| +")
        self.bytes = [(t.replace(BLANK, " ") if k == self.NORMAL else UNKNOWN if k == self.UNK else "").encode() for t, k in zip(self.text, self.kind, strict=True)]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # Texts are read from the end, so that the pieces that end at a place of the turned text begin there in the text itself.
        self.seen = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.id.items():
            self.seen.add_word(t[::-1], i)
        self.seen.make_automaton()
        self.length = [len(t) for t in self.text]
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.words = Words(self.word)

    def merges(self, parts: list[str], border: int = -1) -> list[str] | None:
        """parts (characters) merged to the end; None as soon as a merge would cross the border between two parts."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            if at == border - 1:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at < border:
                border -= 1

    def together(self, a: int, b: int) -> bool:
        """Whether piece a before piece b stay as they are when their characters are merged; a below 0 is nothing."""
        key = a * len(self.text) + b
        known = self.pairs.get(key)
        if known is None:
            left, right = self.text[a] if a >= 0 else "", self.text[b]
            known = self.merges([*left, *right], len(left)) == ([left, right] if left else [right])
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def beginning(self, piece: int) -> int:
        """The longest piece that a piece begins with, itself left out; -1 if there's none."""
        found = self.shorter.get(piece)
        if found is None:
            t = self.text[piece]
            found = self.shorter[piece] = next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1)
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces."""
        longest = [-1] * len(text)
        last = len(text) - 1
        for end, piece in self.seen.iter(text[::-1]):  # of the pieces at one place the longest comes first
            if longest[last - end] < 0:
                longest[last - end] = piece
        length, pairs, size = self.length, self.pairs, len(self.text)
        failed = bytearray(len(text) + 1)
        out: list[int] = []
        at, piece, before = 0, longest[0], -1
        while True:
            while piece >= 0:
                if not failed[at + length[piece]]:
                    fits = pairs.get(before * size + piece)
                    if fits or fits is None and self.together(before, piece):
                        break
                piece = self.beginning(piece)
            if piece >= 0:
                out.append(piece)
                at += length[piece]
                if at > last:
                    return out
                before, piece = piece, longest[at]
            else:  # nothing goes on from here: the piece before is taken back and its shorter beginnings are tried
                failed[at] = 1
                piece = out.pop()
                at -= length[piece]
                before = out[-1] if out else -1

    def word(self, word: str) -> bytes:
        """The ids of a word with the blanks before it. Characters without a piece go byte by byte; nothing merges with them."""
        ids: list[int] = []
        for i, part in enumerate(self.unknown.split(word.replace(" ", BLANK))):
            if i % 2:
                ids += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
            elif part:
                ids += self.backtrack(part)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian uint32."""
        parts = self.cut.findall(" " + text.replace(BLANK, " ")) if text else []
        return b"".join([array("I", [self.bos]).tobytes(), *map(self.words.__getitem__, parts), array("I", [self.eos]).tobytes()])

    def decode(self, ids) -> str:
        """The text of ids. The blank before the first word goes; what isn't UTF-8 among single bytes is replaced byte by byte."""
        try:  # single bytes of a character must be neighbours: nothing may stand between them, not even a begin or end
            out = "" if any(i in ids[1:-1] for i in self.controls) else b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            out = ""
        out = out or "".join(self._decoded_runs(ids))
        first = next((i for i in ids if self.kind[i] != self.CONTROL), None)
        return out[1:] if first is not None and self.text[first].startswith(BLANK) and self.kind[first] == self.NORMAL else out

    def _decoded_runs(self, ids):
        run = bytearray()
        for i in [*ids, self.bos]:
            if self.kind[i] == self.BYTE:
                run += self.bytes[i]
                continue
            while run:
                n = next((n for n in range(1, 5) if _character(run[:n])), 0)
                yield run[:n].decode() if n else "�"
                del run[: n or 1]
            yield self.bytes[i].decode()


def _character(data: bytes) -> bool:
    try:
        return len(data.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    """A worker reads a model once."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids, an array with begin and end."""
    _pieces(model)

    def make():
        pieces = _pieces(model)
        return lambda part: [part.column(0), pa.array([array("I", pieces.encode(t)).tolist() for t in whole_texts(part.column(1))], pa.list_(pa.int32()))]

    return map_texts(docs, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>", make, (key, text), text)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of arrays of ids; null ids are no text, an id that the model doesn't have is an error."""
    pieces_of = _pieces
    _pieces(model)

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian uint32, one after the other) and decoded, the text that the ids stand for."""
    _pieces(model)

    def make():
        pieces = _pieces(model)

        def work(part: pa.RecordBatch) -> list:
            ids = [pieces.encode(t) for t in whole_texts(part.column(1))]
            return [part.column(0), [len(x) // 4 for x in ids], pa.array(ids, pa.binary()), pa.array([pieces.decode(array("I", x)) for x in ids], pa.string())]

        return work

    return map_texts(docs, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint, ids binary, decoded string", make, (key, text), text)
