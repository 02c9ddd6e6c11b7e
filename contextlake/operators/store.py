"""Relational operators over the stored tables: changes, cascades, counts, access history and query history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def incremental_diff(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (path, file_id, action) for a scan (path, hash) against the stored files (path, hash, file_id).

    action is skipped for an equal hash, updated for another one (the id stays), inserted for a new path, removed
    for a path that the scan lacks. Null hashes are equal to each other.
    """
    both = scan.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("scanned")).join(stored.select("path", "file_id", "hash"), "path", "full")
    action = F.when(F.col("scanned").isNull(), "removed").when(F.col("file_id").isNull(), "inserted").when(F.col("new_hash").eqNullSafe(F.col("hash")), "skipped").otherwise("updated")
    return both.select("path", "file_id", action.alias("action"))


def stale(stored: DataFrame, existing: DataFrame) -> DataFrame:
    """The stored files whose path no longer exists; ``existing`` lists paths, ignored ones included."""
    return stored.join(existing.select("path"), "path", "left_anti")


def delete_cascade(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """The rows of a child table whose file isn't among ``gone`` (file_id); rows without a file stay."""
    return rows.join(gone.select(F.col("file_id").alias(key)).distinct(), key, "left_anti").select(*rows.columns)


def set_null_cascade(deps: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after files are deleted: those from them go, those to them lose their target."""
    ids = gone.select("file_id").distinct()
    kept = delete_cascade(deps, ids, "source_file_id")
    flagged = kept.join(ids.select(F.col("file_id").alias("target_file_id"), F.lit(True).alias("gone")), "target_file_id", "left")
    return flagged.withColumn("target_file_id", F.when(F.col("gone").isNull(), F.col("target_file_id"))).select(*deps.columns)


def replace_edges(deps: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges with all of ``sources`` (file_id) replaced by ``fresh`` (the columns of ``deps`` and position for the order); of
    equal keys the last."""
    last = Window.partitionBy("source_file_id", "target_path").orderBy(F.col("position").desc())
    new = fresh.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    return delete_cascade(deps, sources, "source_file_id").unionByName(new.select(*deps.columns))


def count_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The files with their chunk_count counted anew, 0 where there is no chunk."""
    counts = chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return files.drop("chunk_count").join(counts, "file_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def files_by_language(files: DataFrame) -> DataFrame:
    """Files of each language, most first; null is a language of its own."""
    return files.groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.col("n_files").desc(), F.col("language").asc_nulls_first())


def store_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, their tokens (0 if there are none) and the last indexing time."""
    f = files.agg(F.count("*").alias("n_files"), F.max("indexed_at").alias("last_indexed"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"))
    return f.crossJoin(F.broadcast(c))


def known_accesses(log: DataFrame, files: DataFrame) -> DataFrame:
    """Each access once, of files that are known, with their path."""
    once = log.filter("access_id is not null").groupBy("access_id").agg(F.min("file_id").alias("file_id"), F.min("query").alias("query"), F.min("accessed_at").alias("accessed_at"))
    return once.join(files.select("file_id", "path"), "file_id")


def recent_files(accesses: DataFrame, limit: int = 10) -> DataFrame:
    """The files accessed last; times are whole seconds, so ties go to the smaller id."""
    last = accesses.groupBy("file_id", "path").agg(F.max("accessed_at").alias("last_access"))
    return last.orderBy(F.col("last_access").desc_nulls_last(), "file_id").limit(max(0, limit))


def most_accessed(accesses: DataFrame, limit: int = 5) -> DataFrame:
    """The files accessed most often; ties go to the smaller id."""
    counts = accesses.groupBy("file_id", "path").agg(F.count("*").alias("access_count"))
    return counts.orderBy(F.col("access_count").desc(), "file_id").limit(max(0, limit))


def retained(log: DataFrame, now: Column | str, max_age_days: int = 30) -> DataFrame:
    """The accesses that aren't older than ``max_age_days`` before ``now``; those without a time go."""
    limit = F.lit(now) if isinstance(now, str) else now
    return log.filter(F.col("accessed_at") >= limit - F.make_dt_interval(F.lit(max_age_days)))


def recent_unique_queries(history: DataFrame, limit: int = 10, query: str = "query", seq: str = "seq") -> DataFrame:
    """The last queries, newest first, each once whatever its case and outer blanks, in its newest spelling.

    Null and blank queries don't count. Grouping is a combined maximum, so one query may hold any share of the rows.
    """
    plain = F.lower(F.regexp_replace(F.col(query), r"^\s+|\s+$", ""))
    kept = history.select(F.col(seq).alias("seq"), F.col(query).alias("query"), plain.alias("plain")).filter("plain <> ''")
    return kept.groupBy("plain").agg(F.max("seq").alias("seq"), F.max_by("query", "seq").alias("query")).select("seq", "query").orderBy(F.col("seq").desc()).limit(max(0, limit))


def capped_history(history: DataFrame, cap: int = 100, seq: str = "seq") -> DataFrame:
    """The newest ``cap`` entries."""
    return history.orderBy(F.col(seq).desc()).limit(max(0, cap))
