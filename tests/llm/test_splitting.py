"""Splitting against its own rules."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contextlake.llm import splitting


@settings(max_examples=200, deadline=None)
@given(st.text("ab ;{}\n\r\t,é😀", max_size=900), st.integers(3, 60), st.integers(0, 3))
def test_covers(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in pieces) == text
    assert all(math.ceil((e - o) / 3.5) <= limit and o <= s for o, s, e in pieces)


def test_lines_and_overlap():
    text = "\n".join(f"line number {i} of the text;" for i in range(200))
    pieces = splitting.split_text(text)
    assert len(pieces) > 3 and all(text[s - 1] == "\n" for _, s, _ in pieces[1:])
    assert all(text[o:s].count("\n") == 2 for o, s, _ in pieces[1:])
    assert len(splitting.split_text("x" * 5000)) == 4


def test_long_lines_overlap_by_their_share():
    text = "\n".join("x" * 399 for _ in range(20))
    assert all(text[o:s].count("\n") == 1 for o, s, _ in splitting.split_text(text)[1:])
    pieces = splitting.split_text(text, overlap_share=0.5)
    assert all(text[o:s].count("\n") == 2 for o, s, _ in pieces[1:]) and all(e - o <= 1750 for o, _, e in pieces)
    assert all(o == s for o, s, _ in splitting.split_text(text, overlap_share=0.1))


def test_table(spark):
    long = "\n".join(["abc def ghi;"] * 300)
    rows = [(1, long, 5, 1), (1, long, 5, 1), (2, "a\r\nb", 0, 1), (3, None, None, 1), (4, "", 2, 1), (None, long, 1, 1), (5, "y" * 1750, 1, 1), (6, "y" * 1751, 1, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, start_line int, piece int")
    assert {r.chunk_id for r in splitting.split_ids(splitting.split_oversized(chunks)).collect()} == {1, 6, None}
    got = splitting.chunk_pieces(chunks).orderBy("chunk_id", "piece").collect()
    one = [r for r in got if r.chunk_id == 1]
    assert one[0].start_line == 5 and one[-1].end_line == 304 and [r.piece for r in one] == list(range(len(one)))
    assert [(r.start_line, r.end_line, r.token_count) for r in got if r.chunk_id in (2, 3, 4)] == [(1, 2, 2), (1, 1, 0), (2, 2, 0)]
    assert splitting.chunk_pieces(chunks.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\n", "a\n"])
def test_short(text):
    assert splitting.split_text(text) == [(0, 0, len(text))]


def test_lines_before_the_inside_of_lines():
    text = "a;\nb;\n" + "x" * 6000 + "\nc;\nd;"
    pieces = [text[s:e] for _, s, e in splitting.split_text(text)]
    assert pieces[0] == "a;\nb;\n" and pieces[-1] == "c;\nd;" and len(pieces) == 6
