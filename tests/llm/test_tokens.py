"""Encoding and packing."""

from hypothesis import given, settings
from hypothesis import strategies as st

from contextlake.llm import packing, tokens


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'slrevdm \n\t.,01éあ가。{`_漢字😀  ")), max_size=200), st.integers(1, 20))
def test_tree_equals_direct(text, leaf):
    enc = tokens.encoding()
    ids = tokens.encode_tree(enc, text, leaf)[1]
    assert ids == enc.encode_ordinary(text) and tokens.decode_tree(enc, ids, 3) == text


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "<|endoftext|>"), (5, "word " * 9000), (5, "word " * 9000), (None, "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(docs).collect()}
    enc = tokens.encoding()
    assert got[1] == got[2] == [] and got[3] == enc.encode_ordinary("  ") and len(got[4]) > 1 and got[5] == enc.encode_ordinary("word " * 9000)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_packing_is_valid_and_tight(sizes):
    bins = packing.best_two_fit(sizes, 50)
    held: dict[int, int] = {}
    for size, number in zip(sizes, bins, strict=True):
        held[number] = held.get(number, 0) + size
    assert all(v <= 50 for v in held.values())
    full = sorted(v for v in held.values() if v)
    assert len(full) < 2 or full[0] + full[1] > 50


def test_two_replace_one():
    assert packing.best_two_fit([6, 3, 3, 2], 8).count(0) == 2
    assert len(set(packing.best_two_fit([5, 4, 3, 3, 3], 9))) == 2


def test_pack(spark):
    rows = [(1, 9000), (2, 4096), (3, None), (4, 0), (5, 100), (5, 100), (None, 7)]
    got = packing.pack(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens long, bin_id string")).collect()
    one = sorted((r.piece, r.start_token, r.n_tokens) for r in got if r.doc_id == 1)
    assert one == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 808)] and sum(r.n_tokens for r in got) == 9000 + 4096 + 207
    held: dict[int, int] = {}
    for r in got:
        held[r.bin_id] = held.get(r.bin_id, 0) + r.n_tokens
    assert len(held) == 4 and max(held.values()) <= 4096 and len(got) == 9
    frame = spark.createDataFrame(got)
    assert [r.doc_id for r in packing.split_items(frame).collect()] == [1]
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty).count() == 0
