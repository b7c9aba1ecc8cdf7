"""Column functions on text: keys, normal forms, tokens, overlaps. All built-in but for NFKC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility normal form. Spark has no such function, so texts that are not ASCII, on which alone it acts, cross to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_key(line: Column) -> Column:
    """A line without digits, stripped, in lower case."""
    return F.lower(stripped(F.regexp_replace(line, r"\d+", "")))


def normalise(text: Column, compat: bool = True) -> Column:
    """NFKC, no soft hyphens or zero-width signs, hyphenated words joined, blanks squeezed."""
    t = nfkc(text) if compat else text
    t = F.regexp_replace(t, r"[\u00ad\u200b\ufeff]", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return stripped(t)


def useful_chars(text: Column) -> Column:
    """Number of ASCII letters."""
    return F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))


def mostly_devanagari(text: Column) -> Column:
    """Whether more than half of the Latin and Devanagari letters are Devanagari; false without letters."""
    deva = F.regexp_count(text, F.lit("[ऀ-ॿ]"))
    letters = F.regexp_count(text, F.lit("[A-Za-zऀ-ॿ]"))
    return (letters > 0) & (F.lit(2) * deva > letters)


def stem(t: Column) -> Column:
    """One suffix off; words that begin with a digit or are shorter than five stay."""
    less = lambda n: t.substr(F.lit(1), F.length(t) - n)
    cut = F.when(t.endswith("ies"), F.concat(less(3), F.lit("y")))
    for suffix in params.SUFFIXES:
        cut = cut.when(t.endswith(suffix), less(len(suffix)))
    digit = (t >= "0") & (t < ":")  # the sign after 9
    return F.when(digit | (F.length(t) < 5), t).otherwise(cut.otherwise(t))


def tokens(text: Column, compat: bool = False) -> Column:
    """Stemmed tokens in order, repeats kept; null text has none.

    Lower case comes before NFKC (``compat``), which is the identity on ASCII and on precomposed Latin letters.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = nfkc(t) if compat else t
    words = F.split(F.regexp_replace(t, "[^a-z0-9ऀ-ॿ]+", " "), " ")
    return F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(params.STOP_WORDS)), stem)


def coverage(query: Column, text: Column) -> Column:
    """Share of distinct query tokens among the text's tokens (arrays); 0 without tokens."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def comparable(text: Column, compat: bool = False) -> Column:
    """Lower case, quotes removed, other signs one space each run."""
    t = F.lower(text)
    t = nfkc(t) if compat else t
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[“”\"'‘’]", ""), "[^a-z0-9]+", " "))


def supports(quotes: list[str | None], context: str) -> list[float | None]:
    """For quotes (null for null) and a context in comparable form: 1 for a blank or contained quote, else the share of its word trigrams that are contained.

    A contained trigram may begin and end inside a word, but its middle word is a whole one. So the context's words are looked
    up by their places, which are found once, and their neighbours decide.
    """
    words = context.split(" ")
    places: dict[str, list[int]] = {}
    for i in range(1, len(words) - 1):
        places.setdefault(words[i], []).append(i)
    known: dict[tuple, bool] = {}

    def holds(gram: tuple) -> bool:
        if gram not in known:
            left, middle, right = gram
            known[gram] = any(words[i - 1].endswith(left) and words[i + 1].startswith(right) for i in places.get(middle, ()))
        return known[gram]

    out = []
    for q in quotes:
        w = (q or "").split(" ")
        if q is None:
            out.append(None)
        elif q == "" or q in context:
            out.append(1.0)
        else:
            grams = list(zip(w, w[1:], w[2:]))
            out.append(sum(map(holds, grams)) / max(1, len(grams)))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _supports(quotes: pd.Series, context: pd.Series) -> pd.Series:
    return pd.Series([[] if q is None else supports(list(q), c) for q, c in zip(quotes, context)])


def quote_supports(quotes: Column, context: Column) -> Column:
    """``supports`` of an array of quotes; the context is brought to comparable form and indexed once for all of them."""
    return _supports(F.transform(quotes, lambda q: comparable(q)), comparable(F.coalesce(context, F.lit(""))))


def quote_support(quote: Column, context: Column) -> Column:
    """1 if the quote is blank or contained in the context, else the share of its word trigrams that are."""
    return F.get(quote_supports(F.array(quote), context), F.lit(0))


def mentions(text: Column) -> Column:
    """Sorted distinct article numbers that a text refers to."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(params.MENTION), F.lit(1)), F.upper)))


def title_case(text: Column) -> Column:
    """Every letter after another sign than a letter is a capital, other letters are small."""
    low = F.lower(text)
    letters = F.split(low, "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
