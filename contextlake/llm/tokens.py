"""Encoding of a whole corpus with a public tokenizer (byte-level BPE rank files).

Method: monoid tree reduction. A text is halved until a part is at most ``LEAF`` characters; leaves are encoded
on their own and neighbours are joined by re-encoding a window around the cut. The window grows to both sides
until it ends at *certain boundaries*: positions between a letter or digit and a following blank or punctuation
mark, or between a mark and a following blank. No alternative of the split pattern matches across such a position,
whatever stands before or after, so the tokens outside the window can't change. The join is associative, so
parts may be encoded anywhere and in any grouping; decoding concatenates the bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Characters of a part that is encoded in one go.
LEAF = 8192
#: Characters to each side of a cut that are looked at first; doubled until a certain boundary is found.
WINDOW = 64
#: Fixed value: the public split pattern of the byte-level BPE vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CERTAIN = re.compile(
    "(?<=[A-Za-z0-9À-ÖØ-öø-ɏぁ-ゖァ-ヺ一-鿿가-힣])(?=[ \\n\\t.,;:!?()\\[\\]{}`\"。、])"
    "|(?<=[.,;:!?()\\[\\]{}`\"。、])(?=[ \\n\\t])"
)


@lru_cache(maxsize=4)
def encoding(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tokenizer of ``folder/name.tiktoken``; loaded once in each Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _last_certain(text: str) -> int:
    """The last certain boundary inside ``text``, or 0."""
    width = WINDOW
    while True:
        start = max(0, len(text) - width)
        last = 0
        for match in _CERTAIN.finditer(text, start + 1 if start else 1):
            last = match.start()
        if last and last < len(text):
            return last
        if not start:
            return 0
        width *= 2


def _first_certain(text: str) -> int:
    """The first certain boundary inside ``text``, or its length."""
    match = _CERTAIN.search(text, 1)
    return match.start() if match and match.start() < len(text) else len(text)


def _tokens_of_bytes(enc, ids: list[int], n_bytes: int, from_end: bool) -> int:
    """How many tokens at one end of ``ids`` make up ``n_bytes`` bytes."""
    count = 0
    for token in reversed(ids) if from_end else ids:
        if n_bytes <= 0:
            break
        n_bytes -= len(enc.decode_single_token_bytes(token))
        count += 1
    if n_bytes:
        raise AssertionError("a token crosses a certain boundary")
    return count


def join_encoded(enc, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The encoding of the concatenation of two encoded texts."""
    (a, a_ids), (b, b_ids) = left, right
    if not a or not b:
        return (a + b, a_ids or b_ids)
    start, end = _last_certain(a), _first_certain(b)
    drop = _tokens_of_bytes(enc, a_ids, len(a[start:].encode()), True) if start else len(a_ids)
    skip = _tokens_of_bytes(enc, b_ids, len(b[:end].encode()), False) if end < len(b) else len(b_ids)
    return a + b, a_ids[: len(a_ids) - drop] + enc.encode_ordinary(a[start:] + b[:end]) + b_ids[skip:]


def encode_tree(enc, text: str, leaf: int = LEAF) -> tuple[str, list[int]]:
    """``text`` with its token ids, by recursive halving."""
    if len(text) <= leaf:
        return text, enc.encode_ordinary(text) if text else []
    middle = len(text) // 2
    return join_encoded(enc, encode_tree(enc, text[:middle], leaf), encode_tree(enc, text[middle:], leaf))


def _bytes_of(enc, ids: list[int], leaf: int) -> bytes:
    """The bytes of ``ids``: those of leaves, concatenated in pairs up the tree."""
    if len(ids) <= leaf:
        return b"".join(enc.decode_single_token_bytes(t) for t in ids)
    middle = len(ids) // 2
    return _bytes_of(enc, ids[:middle], leaf) + _bytes_of(enc, ids[middle:], leaf)


def decode_tree(enc, ids: list[int], leaf: int = LEAF) -> str:
    """The text of ``ids``; bytes are put together before they are decoded, so characters may span tokens and leaves."""
    return _bytes_of(enc, ids, leaf).decode()


def _encode(text: str | None, name: str, folder: str) -> list[int]:
    return encode_tree(encoding(name, folder), text)[1] if text else []


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row (``id_col``, ``ids`` array<bigint>) for each row of ``df``.

    Null and empty texts give an empty list; blank texts are encoded as they are; strings that look like special
    tokens are ordinary text. Repeated rows give repeated results, an empty table an empty one; other columns are
    not read. Only the id and the text reach Python, in Arrow batches; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_encode(t, name, folder) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, f"`{id_col}` {kind}, ids array<bigint>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row (``id_col``, ``n_tokens`` bigint) for each row of ``df``; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(_encode(t, name, folder)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
