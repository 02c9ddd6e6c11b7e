"""The engine's model over dirty tables: each file and each chunk once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_files(files: DataFrame) -> DataFrame:
    """One row for each file_id: the row of its latest indexing run; repeated rows count once, null ids not at all."""
    row = F.struct(F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("hash", F.lit("")).alias("h"))
    columns = [c for c in ("path", "hash", "language", "size_bytes", "chunk_count", "indexed_at", "modified_at") if c in files.columns]
    return files.filter("file_id is not null").groupBy("file_id").agg(*[F.max_by(c, row).alias(c) for c in columns])


def current_chunks(chunks: DataFrame, *columns: str | Column) -> DataFrame:
    """One row for each chunk_id with the given columns or expressions, the least value where repeated rows differ.

    Expressions are computed where the rows are read, so of a text only what is made of it is shuffled.
    """
    made = chunks.filter("chunk_id is not null").select("chunk_id", *columns)
    return made.groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in made.columns[1:]])
