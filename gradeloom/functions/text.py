"""Column functions over prose: tokens, windows, masking, normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet and the size of a comparison window.
TOKEN = r"[a-z0-9']+"
WINDOW_WORDS = 6

# Identifier patterns and their replacement tokens, applied in this order.
PII_PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "[PHONE]"),
    (r"\b\d{3}\.[A-Za-z]\d{8,9}\b", "[SISID]"),
    (r"\b[A-Za-z]\d{8,9}\b", "[USERID]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_windows(toks: Column, k: int = WINDOW_WORDS) -> Column:
    """Array of k-word windows, in order; empty when the text is shorter than k."""
    starts = F.when(F.size(toks) >= k, F.sequence(F.lit(1), F.size(toks) - (k - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(toks, i, k))


def squash(text: Column) -> Column:
    """Runs of whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def ordered_replace(text: Column, rules) -> Column:
    for pattern, token in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(token))
    return text


def mask_pii(text: Column) -> Column:
    """Addresses, phone numbers and id shapes to tokens; the order decides overlaps."""
    return ordered_replace(text, PII_PATTERNS)


def slug(text: Column) -> Column:
    """Lower-case words joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def word_count(text: Column) -> Column:
    body = squash(text)
    return F.when(body == "", 0).otherwise(F.size(F.split(body, " ")))


def norm_title(text: Column) -> Column:
    """A title as letters and digits alone, for matching: a few references read, markup and the rest dropped."""
    read = F.coalesce(text, F.lit(""))
    for name, plain in (("&amp;", "&"), ("&mdash;", "-"), ("&ndash;", "-"), ("&ldquo;", '"'), ("&rdquo;", '"')):
        read = F.replace(read, F.lit(name), F.lit(plain))
    return F.lower(F.regexp_replace(F.regexp_replace(read, r"<[^>]+>", ""), r"[^a-zA-Z0-9]", ""))


def clip(text: Column, size: int = 240) -> Column:
    """Squashed text of at most ``size`` characters, an ellipsis being the last where some is left out."""
    body = squash(text)
    return F.when(F.length(body) <= size, body).otherwise(F.concat(F.left(body, F.lit(size - 1)), F.lit("…")))
