"""Text expressions: cleaning of model answers, phrases, overlaps, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesage.functions.binding import let

# What is cut from answers, which words open a useless phrase, what a phrase is made of.
QUOTED_SPAN = r"""['"]([^'"]+)['"]"""
PHRASE_TOKEN = r"(?U)\b[A-Za-z0-9\-\.\,\(\)]+\b"
STOP_OPENINGS = ["what is", "how many", "list the", "where is", "of the"]
PHRASE_STRIP = " .,'\""
WORDS_PER_TOKEN_ESTIMATE = 1.3
WHITE_SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def strip_space(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _strip_fence(text: Column, tag: str) -> Column:
    def opened(t: Column) -> Column:
        return F.when(t.startswith("```"), F.regexp_replace(t, rf"(?i)^```(?:{tag})?\s*", "")).otherwise(t)

    def closed(t: Column) -> Column:
        return F.when(t.endswith("```"), F.substring(t, F.lit(1), F.length(t) - 3)).otherwise(t)

    return let(strip_space(text), lambda t: strip_space(let(opened(t), closed)))


def clean_sql(text: Column) -> Column:
    """SQL without a surrounding code fence; NULL becomes the empty string."""
    return _strip_fence(F.coalesce(text, F.lit("")), "sql")


def clean_json(text: Column) -> Column:
    """JSON text of a model answer: the whole answer, else its widest {...} part, else NULL."""
    body = _strip_fence(F.coalesce(text, F.lit("")), "json")
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.coalesce(
        F.when(is_json(body), body),
        F.when((braces != "") & is_json(braces), braces),
    )


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def split_words(text: Column) -> Column:
    """Words between white space, no empty ones."""
    return F.filter(F.split(strip_space(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text that stands between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def tokens_of_words(count: Column) -> Column:
    return F.floor(count * F.lit(WORDS_PER_TOKEN_ESTIMATE)).cast("int")


def token_estimate(text: Column) -> Column:
    return tokens_of_words(F.size(split_words(text)))


def overlap_words(text: Column) -> Column:
    return F.array_distinct(split_words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "_", " ")))


def words_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that also occur in ``b``, for arrays made by :func:`overlap_words`."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that also occur in ``b``; 0 when ``a`` has no words."""
    return let(overlap_words(a), lambda words: words_overlap(words, overlap_words(b)))


def _word_runs(words: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by one blank."""
    count = F.size(words) - (n - 1)
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def phrases(question: Column, evidence: Column) -> Column:
    """Distinct phrases worth looking up: quoted spans and runs of two to four words."""
    text = F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(evidence, F.lit("")))
    quoted = F.regexp_extract_all(text, F.lit(QUOTED_SPAN), F.lit(1))

    def wanted(run: Column) -> Column:
        opening = "|".join(STOP_OPENINGS)
        return (F.length(run) > 4) & ~run.rlike(f"(?i)^(?:{opening})")

    runs = let(
        F.regexp_extract_all(text, F.lit(PHRASE_TOKEN), F.lit(0)),
        lambda words: F.filter(F.concat(*[_word_runs(words, n) for n in (2, 3, 4)]), wanted),
    )
    stripped = F.transform(F.concat(quoted, runs), lambda p: F.btrim(p, F.lit(PHRASE_STRIP)))
    return F.array_distinct(F.filter(stripped, lambda p: F.length(p) >= 3))
