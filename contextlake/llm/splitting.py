"""Splitting oversized chunks at natural boundaries.

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its midpoint; halves that,
with the overlap they will get, still exceed the limit are cut again; last, each piece but the first gets up to two
lines of its predecessor in front, where these lines are short enough.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.session import spread

LIMIT_TOKENS = 500
CHARS_PER_TOKEN = 3.5
OVERLAP_LINES = 2
#: The share of the limit that the overlap may take; longer lines overlap singly or not at all.
OVERLAP_SHARE = 0.4
#: The part of a text around its midpoint, to each side, in which a boundary may stand.
NEAR = 0.25
#: The strength from which on a boundary is a line's.
LINE = 4

PIECE_SCHEMA = "chunk_id bigint, piece bigint, content string, start_line bigint, end_line bigint, token_count bigint"

#: Boundaries by rising strength: within a line after a blank, a comma or a statement; a line; a statement's line
#: end; a block end; a blank line. A cut goes behind the match.
_INNER = re.compile(r"[;{}]\s?|,\s?|[ \t]+")
_LINE = re.compile(r"\n")


def _boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions where ``text`` may be cut, ascending, and the strength of each."""
    strength: dict[int, int] = {}
    for match in _INNER.finditer(text):
        strength[match.end()] = {",": 2, " ": 1, "\t": 1}.get(match.group()[0], 3)
    size = len(text)
    for match in _LINE.finditer(text):
        at = match.end()
        before = text[max(0, at - 3) : at - 1].rstrip("\r")[-1:]
        after = text[at] if at < size else "\n"
        rank = LINE + (before in ";}:") + (after not in " \t")
        if before == "\n":
            rank = 7
        strength[at] = rank
    places = sorted(p for p in strength if 0 < p < size)
    return places, [strength[p] for p in places]


def split_text(text: str, limit_tokens: int = LIMIT_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_share: float = OVERLAP_SHARE) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) of each piece in characters; pieces [start, end) cover ``text`` once.

    An overlap is as many whole lines, ``overlap_lines`` at most, as take no more than ``overlap_share`` of the limit.
    """
    limit = int(limit_tokens * CHARS_PER_TOKEN)
    if len(text) <= limit:
        return [(0, 0, len(text))]
    places, strength = _boundaries(text)
    lines = [0] + [m.end() for m in _LINE.finditer(text)]
    most = int(limit * overlap_share)

    def overlap_start(start: int) -> int:
        at = bisect_left(lines, start)
        if at >= len(lines) or lines[at] != start:
            return start
        for n in range(min(overlap_lines, at), 0, -1):
            if start - lines[at - n] <= most:
                return lines[at - n]
        return start

    def nearest(sorted_places: list[int], start: int, end: int) -> int | None:
        low, high = bisect_right(sorted_places, start), bisect_left(sorted_places, end)
        at = bisect_left(sorted_places, (start + end) / 2, low, high)
        return min((sorted_places[i] for i in (at - 1, at) if low <= i < high), key=lambda p: abs(p - (start + end) / 2), default=None)

    def cut_place(start: int, end: int) -> int:
        """The strongest boundary near the midpoint; else the nearest line, else the nearest boundary, else there."""
        middle, reach = (start + end) / 2, (end - start) * NEAR
        near = range(bisect_left(places, middle - reach), bisect_right(places, middle + reach))
        best = max(near, key=lambda i: (strength[i], -abs(places[i] - middle), -places[i]), default=None)
        if best is not None and strength[best] >= LINE:
            return places[best]
        for place in (nearest(lines, start, end), places[best] if best is not None else None, nearest(places, start, end)):
            if place is not None:
                return place
        return (start + end) // 2

    pieces, stack = [], [(0, len(text))]
    while stack:
        start, end = stack.pop()
        if end - overlap_start(start) <= limit:
            pieces.append((overlap_start(start), start, end))
            continue
        at = cut_place(start, end)
        stack += [(at, end), (start, at)]
    return pieces


def _pieces(chunk_id: int, text: str, first_line: int | None, limit_tokens: int, overlap_lines: int, overlap_share: float) -> Iterator[tuple]:
    base = first_line if first_line and first_line > 0 else 1
    breaks = [m.start() for m in _LINE.finditer(text)]
    for number, (overlap, _, end) in enumerate(split_text(text, limit_tokens, overlap_lines, overlap_share)):
        content = text[overlap:end]
        yield (chunk_id, number, content, base + bisect_left(breaks, overlap), base + bisect_left(breaks, end - 1), -int(-len(content) // CHARS_PER_TOKEN))


def oversized(limit_tokens: int = LIMIT_TOKENS, content: str = "content"):
    """The condition under which a text exceeds the limit, whatever its stored count says."""
    return F.ceil(F.length(content) / F.lit(CHARS_PER_TOKEN)) > limit_tokens


def split_oversized(chunks: DataFrame, limit_tokens: int = LIMIT_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_share: float = OVERLAP_SHARE) -> DataFrame:
    """Pieces (``PIECE_SCHEMA``) of the chunks over the limit; chunks within it give no row.

    ``chunks`` needs chunk_id, content and start_line; other columns are dropped. Null and empty contents are within
    any limit. A start_line that is null or under 1 counts as 1. Lines end at ``\\n``; ``\\r`` stays in the content.
    A text without any boundary is cut at its midpoints. Repeated rows give repeated pieces. The filter runs on the
    JVM side, so only oversized texts reach Python; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk_id", pa.int64()), ("piece", pa.int64()), ("content", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("token_count", pa.int64())])
        for batch in batches:
            rows = [p for a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True) for p in _pieces(a, b, c, limit_tokens, overlap_lines, overlap_share)]
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    big = chunks.filter(oversized(limit_tokens)).select(F.col("chunk_id").cast("bigint"), "content", F.col("start_line").cast("bigint"))
    return big.mapInArrow(run, PIECE_SCHEMA)


def chunk_pieces(chunks: DataFrame, limit_tokens: int = LIMIT_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_share: float = OVERLAP_SHARE) -> DataFrame:
    """Every chunk as pieces within the limit, each piece once; a chunk within the limit is its own only piece.

    Null contents come out as a null piece of 0 tokens with the stored line; rows that repeat a chunk's content give
    the pieces once.
    """
    whole = chunks.filter(~F.coalesce(oversized(limit_tokens), F.lit(False)))
    first = F.when(F.col("start_line") > 0, F.col("start_line")).otherwise(1).cast("bigint")
    text = F.coalesce("content", F.lit(""))
    breaks = F.length(text) - F.length(F.replace(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("\n"), F.lit(""))) - F.when(F.length(text) > 0, 1).otherwise(0)
    small = whole.select(F.col("chunk_id").cast("bigint"), F.lit(0).cast("bigint").alias("piece"), "content", first.alias("start_line"), (first + breaks).cast("bigint").alias("end_line"), F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint").alias("token_count"))
    return small.unionByName(split_oversized(chunks, limit_tokens, overlap_lines, overlap_share)).distinct()


def split_ids(pieces: DataFrame) -> DataFrame:
    """The ids of chunks that were cut, once each."""
    return pieces.filter(F.col("piece") > 0).select("chunk_id").distinct()
