"""Analyzers and string scalars as Column expressions; stemming and edit distance as pandas functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter2 import stem


def exact_tokens(x: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def whitespace_tokens(x: Column) -> Column:
    """Split on ASCII whitespace, case kept."""
    return F.filter(F.split(x, "[ \\t-\\r]+"), lambda t: t != "")


def ascii_tokens(x: Column) -> Column:
    """Exact tokens of ASCII letters and digits alone; the others disappear. What remains to do is stemming."""
    return F.filter(exact_tokens(x), lambda t: t.rlike("^[0-9a-z]+$"))


def ngram_tokens(x: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the lower-cased text, by start and then length; none of null.

    The text is read once: at every start the longest n-gram is taken, of which the others are prefixes. An expression
    named inside a lambda is computed anew for every element, so none does more there than look at these few characters.
    """
    longest = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"(?s)(?=(.{{{low},{high}}}))."), F.lit(1))
    return F.flatten(F.transform(longest, lambda g: F.transform(F.sequence(F.lit(low), F.length(g)), lambda n: F.substr(g, F.lit(1), n))))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def truncate_chars(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def truncate_boundary(x: Column, n: int) -> Column:
    """Up to n characters, cut before the last whitespace if something is cut at all."""
    cut = F.substring(x, 1, n)
    return F.when(F.length(x) <= n, x).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*)\s", 1), F.lit("")), cut))


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


class Stems(dict):
    """Stems of words, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, w: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        s = self[w] = stem(w)
        return s


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    memo = Stems()
    return words.map(memo.__getitem__, na_action="ignore")


def osa(a: str, b: str, most: int) -> int:
    """Edit distance in which swapping neighbours costs one; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def within_distance(column: Column, word: str, most: int) -> Column:
    """Whether values are within an edit distance of one word; meant for a vocabulary.

    A swap of neighbours is two plain edits, so the built-in distance leaves few values to Python.
    """

    @F.pandas_udf("boolean")
    def near(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and osa(v, word, most) <= most).astype(bool)

    return F.length(column).between(len(word) - most, len(word) + most) & (F.levenshtein(column, F.lit(word)) <= 2 * most) & near(column)
