"""Similarities. Jaccard and cosine are expressions; the sequence ratio has no expression and is an Arrow-batched UDF."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: From so many characters of the second text on, the standard library's matcher leaves frequent ones out.
JUNK = 200


def normalized(x: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", "", x or "").split()).lower()


def ratio(a: str | None, b: str | None) -> float:
    """The matched share of two normalised titles; order matters, as for the standard library's matcher."""
    a, b = normalized(a), normalized(b)
    if len(b) < JUNK and (a in b or b in a):  # the shorter one is the longest common block, and leaves nothing on one side
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() of every pair; equal pairs of a batch are compared once."""
    memo: dict[tuple, float] = {}
    return pd.Series([memo[p] if p in memo else memo.setdefault(p, ratio(*p)) for p in zip(a, b, strict=True)], dtype="float64")


def citation_score(wanted: str, title: str, year_hint: int, year: int, authors_hint: str, authors: str) -> float:
    """0.8 of the ratio, 0.15 for equality, up to 0.2 for a near year, 0.2 for an author found; at most 1, two places."""
    s = 0.8 * ratio(wanted, title) + (0.15 if normalized(wanted) == normalized(title) else 0.0)
    if year_hint and year:
        gap = abs(year_hint - year)
        s += 0.2 if gap <= 1 else 0.1 if gap <= 3 else 0.0
    if authors_hint and authors_hint.lower() in (authors or "").lower():
        s += 0.2
    return round(min(s, 1.0), 2)


@F.pandas_udf(DoubleType())
def citation_scores(wanted: pd.Series, title: pd.Series, year_hint: pd.Series, year: pd.Series, authors_hint: pd.Series, authors: pd.Series) -> pd.Series:
    rows = zip(wanted, title, year_hint.fillna(0).astype(int), year.fillna(0).astype(int), authors_hint.fillna(""), authors.fillna(""), strict=True)
    return pd.Series([citation_score(*r) for r in rows], dtype="float64")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
