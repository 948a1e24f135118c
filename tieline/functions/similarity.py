"""Trigram similarity and token matching as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieline.functions.text import let


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each lower-cased word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def gram_similarity(a: Column, b: Column) -> Column:
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, shared / either).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    # The grams of both are named more than once, but made once.
    return F.coalesce(let(trigrams(a), lambda x: let(trigrams(b), lambda y: gram_similarity(x, y))), F.lit(0.0))


SIMILAR_ABOVE = 0.3


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def matches_all(document_tokens: Column, query_tokens: Column) -> Column:
    """Every query token occurs; a query without tokens matches nothing."""
    return (F.size(query_tokens) > 0) & (F.size(F.array_except(query_tokens, document_tokens)) == 0)


def token_rank(document_tokens: Column, query_tokens: Column) -> Column:
    """Share of the document's tokens that are query tokens, 0 unless all query tokens occur."""
    hits = F.size(F.filter(document_tokens, lambda t: F.array_contains(query_tokens, t)))
    score = hits / F.greatest(F.size(document_tokens), F.lit(1))
    return F.when(matches_all(document_tokens, query_tokens), score).otherwise(F.lit(0.0))


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive substring; the needle is literal text, not a pattern."""
    return F.contains(F.lower(c), F.lit(needle.lower()))
