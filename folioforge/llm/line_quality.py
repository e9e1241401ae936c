"""Operator 1, quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed; a document that
loses more than ``max_lost`` of its characters that way is rejected. Counts of the whole text (words, symbols,
repeated lines and word windows) are the base rules on top.

Null or empty text: zero counts, base_failed, not kept, cleaned text empty. Null doc_id, repeated rows and further
columns: each row is judged by itself and only ``doc_id`` and ``text`` are read. Empty table: empty result.
A narrow map: no shuffle, nothing gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, whole_texts

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Phrases of site furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "click here",
    "read more", "sign up", "sign in", "log in", "subscribe to", "share on", "follow us", "skip to content",
    "back to top", "add to cart", "page not found", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "weiterlesen", "jetzt anmelden", "zum inhalt springen", "nach oben",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos y condiciones", "aviso legal", "haga clic aquí", "haz clic aquí", "leer más", "iniciar sesión",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "lire la suite", "en savoir plus", "se connecter", "haut de page",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
_SEPARATOR = re.compile(r"(?:^|(?<=\s))(?:[|»«›‹•·→]|>{1,2}|/)(?=\s|$)")
_TERMINAL = re.compile(r"[.!?…:;。！？][\"'”’»)\]*]*\s*$")
#: Marks of decoration or shouting; an ellipsis is none.
_MARKS = "#*$%&<>|~^=_!?"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules. Shares are of a line's words, max_lost of a text's characters."""

    max_decorated: float = 0.3
    min_separators: int = 2
    max_separator_share: float = 0.15
    heading_words: int = 4
    boilerplate_words: int = 30
    max_lost: float = 0.4


def is_decorated(word: str) -> bool:
    """Whether a word ends in two or more marks, with or without one stop behind them. Seen from its end, so a long word takes no square."""
    bare = word[:-1] if word[-1:] in (".", ",", ";", ":") else word
    return len(bare) - len(bare.rstrip(_MARKS)) >= 2


def line_fault(line: str, rules: Rules = Rules()) -> str:
    """'punctuation', 'navigation' or 'boilerplate', or '' for a line that stays. Blank lines stay."""
    words = line.split()
    if not words:
        return ""
    n = len(words)
    if not line.isascii() or any(c in line for c in "|>/"):
        marks = len(_SEPARATOR.findall(line))
        if marks >= rules.min_separators and marks > rules.max_separator_share * n:
            return "navigation"
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return "boilerplate"
    decorated = sum(1 for w in words if not w[-1].isalnum() and is_decorated(w))
    if decorated > rules.max_decorated * n:
        return "punctuation"
    if not _TERMINAL.search(line):
        if n <= rules.heading_words:
            return "navigation"
        if not any(c in line for c in ".,;:!?"):
            return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map({}.setdefault, words, count()), np.uint64, len(words))
    h = ids[:n].copy()
    for i in range(1, WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # Equal hashes are candidates only; the windows themselves decide.
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    _, group, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    for p in at[sizes[group.ravel()] > 1]:
        marks[p] += 1
        marks[p + WINDOW] -= 1 if p + WINDOW <= len(words) else 0
    return int((np.cumsum(marks[:-1]) > 0).sum())


def judged(text: str, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost share, lines removed by rule, cleaned text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    copies, lost, kept_lines, faults = 0, 0, [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            copies += line in seen
            seen.add(line)
        if fault := line_fault(line, rules):
            lost += len(line)
            faults[fault] += 1
        else:
            kept_lines.append(line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    share = lost / max(1, len(text))
    return (n, chars, symbols, copies, repeats, failed, not failed and share <= rules.max_lost, share, *faults.values(), "\n".join(kept_lines))


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, lost_share double, n_punctuation bigint, n_navigation bigint, n_boilerplate bigint"
)


def line_quality(docs: DataFrame, rules: Rules = Rules(), cleaned: bool = True) -> DataFrame:
    """A row for each document: counts, verdict and, unless not ``cleaned``, the text without failing lines."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            rows = [judged(x, rules) for x in whole_texts(part.column("text"))]
            columns = list(zip(*rows, strict=True))
            return [part.column("doc_id"), *(pa.array(c) for c in (columns if cleaned else columns[:-1]))]

        return work

    return map_texts(docs, SCHEMA + ", cleaned string" * cleaned, make)
