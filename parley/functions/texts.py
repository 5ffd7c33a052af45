"""Text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters removed from a transcript before scoring.
TRANSCRIPT_MARKS = "; 　「」?？。…、"
SINGLE_KANA = "^[ぁ-んァ-ン]$"
WORD = "[a-zà-ÿ]+"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """One line, NFKC, lower case, no ASCII punctuation, every number written as 0."""
    flat = F.lower(nfkc(F.regexp_replace(text, "\n", "")))
    return F.regexp_replace(F.regexp_replace(flat, r"[!-/:-@\[-`{-~]", ""), r"\p{Nd}+\.*\p{Nd}*", "0")


def without_marks(text: Column, marks: str = TRANSCRIPT_MARKS) -> Column:
    return F.translate(text, marks, "")


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def kept_words(tokens: Column, stop: list[str]) -> Column:
    """Tokens that are neither stop words nor a single kana."""
    return F.filter(tokens, lambda w: ~w.isin(stop) & ~w.rlike(SINGLE_KANA))


def word_pairs(tokens: Column) -> Column:
    """All unordered pairs of the positions of one short list, each pair sorted inside."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("word1"), F.greatest(a, b).alias("word2"))
    return F.flatten(F.transform(tokens, lambda a, i: F.transform(
        F.slice(tokens, i + 2, F.size(tokens)), lambda b: pair(a, b))))


def numbers_of(name: Column) -> Column:
    """Integers inside a name, in order, as a sort key for natural order."""
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("long"))


def int_tuple(text: Column) -> Column:
    """``"(1, 2, 3)"`` as an array of integers."""
    return F.split(F.regexp_replace(text, "[() ]", ""), ",").cast("array<int>")


def float_list(text: Column) -> Column:
    """``"[1 2 3]"``, possibly over several lines, as an array of doubles."""
    return F.split(F.trim(F.regexp_replace(text, r"[\[\]\s]+", " ")), " ").cast("array<double>")
