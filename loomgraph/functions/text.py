"""Text, score and vector expressions, all built-in and inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bands of the confidence label, lowest whole score of each
BANDS = (("exact", 95), ("high", 80), ("medium", 60), ("low", 35), ("weak", 1))


def lines(text: Column) -> Column:
    """Lines of a text without line ends; a final line end makes no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def words(text: Column) -> Column:
    """Words of letters, digits and underscores; empty ones dropped."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def estimated_tokens_of_bytes(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def keyword_score(text: Column, query: str) -> Column:
    """1.0 for the query itself, 0.7 if it is contained, 0.5 if any of its words is, else 0."""
    low, q = F.lower(F.coalesce(text, F.lit(""))), query.lower()
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in q.split()], F.lit(False))
    return F.when(low == q, 1.0).when(F.contains(low, F.lit(q)), 0.7).when(some, 0.5).otherwise(0.0)


def normal_score(score: Column) -> Column:
    """A confidence score within 0 to 100; not-a-number and the infinities count as 0."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def confidence_label(score: Column) -> Column:
    """The band of a score, whose fraction is cut off first."""
    whole = F.floor(normal_score(score))
    return reduce(lambda acc, b: acc.when(whole >= b[1], b[0]), BANDS[1:], F.when(whole >= BANDS[0][1], BANDS[0][0])).otherwise("unresolved")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for vectors of unequal length, without length or of norm 0."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm).otherwise(0.0)


def markup_free(text: Column) -> Column:
    """Text without the characters that markup gives a meaning."""
    return F.translate(text, "<>&\"'", "")


# Markdown


def wiki_links(text: Column) -> Column:
    """Array of ``target, alias``; a link does not span an opening of another and must be closed."""
    inner = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.transform(inner, lambda x: F.struct(F.trim(F.element_at(F.split(x, r"\|", 2), 1)).alias("target"), F.when(F.contains(x, F.lit("|")), F.trim(F.substring_index(x, "|", -1))).alias("alias")))


def hash_tags(text: Column) -> Column:
    """Words that start with ``#``, without the mark and trailing punctuation; duplicates are kept."""
    raw = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([^\s#]\S*)"), F.lit(1))
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_/-]+$", "")), lambda t: t != "")


def headings(text: Column) -> Column:
    """Array of ``level, text, line`` for lines of one to six ``#``; code blocks are not left out."""
    numbered = F.transform(lines(text), lambda x, k: F.struct(F.length(F.regexp_extract(x, r"^\s*(#{1,6})[^#]", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^\s*#{1,6}", "")).alias("text"), (k + 1).alias("line")))
    return F.filter(numbered, lambda h: (h["level"] > 0) & (h["text"] != ""))


def markdown_links(text: Column) -> Column:
    """Array of ``text, url`` for ``[text](url)``."""
    whole = F.regexp_extract_all(text, F.lit(r"(?<!\[)\[[^\[\]]*\]\([^()\s]+\)"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("text"), F.regexp_extract(x, r"\((.*)\)$", 1).alias("url")))
