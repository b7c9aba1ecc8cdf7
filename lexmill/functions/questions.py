"""Column functions on questions: cleaning, article numbers, concepts, intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params
from .text import stripped

_TENS = "|".join(w for w, n in params.NUMBER_WORDS.items() if n >= 20)
_UNITS = "|".join(params.NUMBER_WORDS)
RANGE, SEPARATOR, NUMBER = r"(?i)^(\d{1,4})\s*(?:to|-)\s*(\d{1,4})$", r"(?i)\s*(?:,|and|&)\s*", r"(?i)^\d{1,4}[a-z]{0,3}$"
#: One article in words: the tens, a separator only before units, the units.
NUMBER_PHRASE = rf"(?i)\barticle\s+(?:({_TENS})(?:[-\s]({_UNITS}))?|({_UNITS}))\b"
# Lists and ranges of article numbers.
ARTICLE_LIST = r"(?i)\b(?:articles?|arts?\.?)\s*((?:\d{1,4}[a-z]{0,3})(?:\s*(?:,|and|&|to|-)\s*\d{1,4}[a-z]{0,3})*)"


def sanitise(question: Column) -> Column:
    """Control characters are spaces; white space is squeezed and stripped."""
    t = F.regexp_replace(question, r"[\x00-\x08\x0b-\x1f\x7f]", " ")
    return stripped(F.regexp_replace(t, r"(?U)\s+", " "))


def words_to_numbers(q: Column) -> Column:
    """Article numbers in words become digits: tens and units are added. All hits are replaced."""
    number = F.create_map(*[F.lit(x) for k, v in params.NUMBER_WORDS.items() for x in (k, v)])
    hits = F.regexp_extract_all(q, F.lit(NUMBER_PHRASE), F.lit(0))
    between = F.split(q, NUMBER_PHRASE, -1)

    def value(hit: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(hit), r"^article\s+", ""), r"[-\s]+"), lambda w: w != "")
        total = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.coalesce(F.element_at(number, w), F.lit(0)))
        return F.concat(F.lit("Article "), total.cast("string"))

    parts = F.zip_with(between, F.transform(hits, value), lambda b, n: F.concat(F.coalesce(b, F.lit("")), F.coalesce(n, F.lit(""))))
    return F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(q)


def extract_articles(q: Column) -> Column:
    """Distinct article numbers in order: lists, and ranges of a span up to 12 (else their first number)."""
    lists = F.regexp_extract_all(words_to_numbers(q), F.lit(ARTICLE_LIST), F.lit(1))

    def numbers(part: Column) -> Column:
        a, b = F.regexp_extract(part, RANGE, 1), F.regexp_extract(part, RANGE, 2)
        low, high = a.try_cast("int"), b.try_cast("int")
        span = F.when((high > low) & (high - low <= 12), F.transform(F.sequence(low, high), lambda i: i.cast("string"))).otherwise(F.array(a))
        one = F.when(part.rlike(NUMBER), F.array(F.upper(part))).otherwise(F.array().cast("array<string>"))
        return F.when(a != "", span).otherwise(one)

    return F.array_distinct(F.flatten(F.transform(lists, lambda s: F.flatten(F.transform(F.split(s, SEPARATOR), numbers)))))


def concept_hits(q: Column, concepts=params.CONCEPTS) -> Column:
    """Concepts whose pattern occurs, in order, as array of (articles, terms)."""
    rows = [F.when(q.rlike("(?i)" + pattern), F.struct(F.array(*map(F.lit, articles)).alias("articles"), F.lit(terms).alias("terms"))) for pattern, articles, terms in concepts]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def expand(q: Column, concepts=params.CONCEPTS) -> tuple[Column, Column]:
    """(question with the terms of its concepts, distinct hint articles in order)."""
    hits = concept_hits(q, concepts)
    terms = F.transform(hits, lambda h: h["terms"])
    return F.array_join(F.concat(F.array(q), terms), " "), F.array_distinct(F.flatten(F.transform(hits, lambda h: h["articles"])))


def intent(q: Column) -> Column:
    return F.when(q.rlike(params.INJECTION), "injection").when(q.rlike(params.GREETING), "greeting").when(q.rlike(params.OFFTOPIC), "offtopic").otherwise("question")


def is_pure_article(q: Column) -> Column:
    return q.rlike(params.PURE_ARTICLE)


def article_key(a: Column) -> Column:
    """Upper case without white space."""
    return F.regexp_replace(F.upper(a), r"(?U)\s+", "")


def follow_up(q: Column, history: Column, turns: int = 6) -> Column:
    """A question that leans on the one before it, with that one's articles or its first 150 characters.

    ``history``: array of (role, content) in order; roles other than user and assistant are left out before
    the last ``turns`` are taken.
    """
    kept = F.filter(history, lambda t: t["role"].isin("user", "assistant") & t["content"].isNotNull())
    kept = F.filter(F.slice(kept, F.greatest(F.lit(1), F.size(kept) - turns + 1), F.lit(turns)), lambda t: (t["role"] == "user") & (t["content"] != q))
    previous = F.try_element_at(kept, F.lit(-1))["content"]
    named = extract_articles(previous)
    added = F.when(F.size(named) > 0, F.concat(q, F.lit(" (Article "), F.array_join(named, ", Article "), F.lit(")"))).otherwise(F.concat(q, F.lit(" (context: "), F.substring(previous, 1, 150), F.lit(")")))
    leans = (F.size(extract_articles(q)) == 0) & q.rlike(params.FOLLOW_UP) & (F.length(q) < 120)
    return F.when(leans & previous.isNotNull(), added).otherwise(q)
