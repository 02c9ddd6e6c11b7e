"""Column functions and literal helpers for text: sizes, hashes, search texts, query terms, term frequencies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that count as one token.
CHARS_PER_TOKEN = 3.5
#: Fixed values of a search text: identifiers kept, and their form.
MAX_IDENTIFIERS = 50
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
#: Fixed value: what separates terms of a query: all but ASCII letters, digits, underscore, blanks and Hangul.
NOT_A_TERM = "[^a-z0-9_\\sㄱ-힝]"
MIN_TERM = 2


def estimate_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Tokens of ``text`` by its length in code points, rounded up; 0 for null and empty texts."""
    if not chars_per_token > 0:
        raise ValueError("chars_per_token must be positive")
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(float(chars_per_token))).cast("bigint")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def search_text(kind: Column, name: Column, content: Column) -> Column:
    """Type, name and the first distinct identifiers of a chunk, in lower case; parts that are null are left out."""
    words = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(f"({IDENTIFIER})"), F.lit(1))
    words = F.array_join(F.slice(F.array_distinct(words), 1, MAX_IDENTIFIERS), " ")
    return F.lower(F.concat_ws(" ", kind, F.when(name != "", name), F.when(words != "", words)))


def query_terms(query: str | None) -> list[str]:
    """The terms of a literal query, repeated ones kept; none for what isn't a text."""
    if not isinstance(query, str):
        return []
    return [t for t in re.sub(NOT_A_TERM, " ", query.lower()).split() if len(t) >= MIN_TERM]


def term_column(query: Column) -> Column:
    """The same for a column of queries."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), NOT_A_TERM, " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) >= MIN_TERM)


def term_frequency(text: Column, term: str) -> Column:
    """How often ``term`` stands in ``text``, counted from the left without overlap; not bound to words."""
    if not term:
        return F.lit(0.0)
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(float(len(term)))


def embedding_text(name: Column, kind: Column, content: Column, limit: int = 2000) -> Column:
    """What a chunk is embedded by: name, type in brackets and content, cut to ``limit`` characters by definition."""
    return F.substring(F.concat_ws(" ", F.when(name != "", name), F.concat(F.lit("["), kind, F.lit("]")), content), 1, limit)


def byte_terms(query: Column) -> Column:
    """The other tokenizer: words of letters and digits of any script and underscores, of two bytes or more."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " +")
    return F.filter(words, lambda w: F.octet_length(w) >= 2)


def estimate_tokens_bytes(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Tokens by the length in UTF-8 bytes; 0 for null and empty texts."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(float(chars_per_token))).cast("bigint")


def quick_hash(text: Column) -> Column:
    """A fast 64-bit hash in hex, for comparisons within one run of the engine; null for a null text."""
    return F.when(text.isNotNull(), F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"))


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
