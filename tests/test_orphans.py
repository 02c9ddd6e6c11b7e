"""Faulty references, paths and skewed joins."""

import datetime

from pyspark.sql import functions as F

from contextlake.functions.paths import dirname, extension, normal_path
from contextlake.operators import orphans

D = datetime.datetime


def test_faults(spark):
    files = spark.createDataFrame(
        [(1, "src/a/x.ts", D(2024, 1, 5)), (1, "src/a/x.ts", D(2023, 1, 5)), (2, "src/lib/util.ts", D(2024, 3, 1)), (3, ".\\src\\a\\d\\index.ts", D(2023, 1, 1)), (4, None, None), (None, "z", None)],
        "file_id long, path string, indexed_at timestamp_ntz",
    )
    deps = spark.createDataFrame(
        [(1, "../lib/util", None), (1, "../lib/util", None), (1, "./d", None), (1, "./no", None), (1, "react", None), (1, "m", 7), (1, "n", 8), (9, "./d", 2), (None, "q", 2), (1, None, None), (1, "ok", 2), (4, "./d", None)],
        "source_file_id long, target_path string, target_file_id long",
    ).withColumn("extra", F.lit(1))
    gone = spark.createDataFrame([(7, "p"), (7, "p"), (None, "q")], "file_id long, path string")
    got = {(r.source_file_id, r.target_path): (r.kind, str(r.period)) for r in orphans.faulty_references(deps, files, gone).collect()}
    assert got == {
        (1, "../lib/util"): ("target_late", "2024-01-01"),
        (1, "./no"): ("path_missing", "2024-01-01"),
        (1, "m"): ("target_removed", "2024-01-01"),
        (1, "n"): ("target_missing", "2024-01-01"),
        (9, "./d"): ("source_missing", "None"),
        (None, "q"): ("source_missing", "None"),
        (4, "./d"): ("path_missing", "None"),
    }
    report = orphans.fault_report(orphans.faulty_references(deps, files, gone))
    assert sum(r.n for r in report.collect()) == len(got) and {r.parent_table for r in report.collect()} == {"files", "files.path"}


def test_empty(spark):
    files = spark.createDataFrame([], "file_id long, path string, indexed_at timestamp_ntz")
    deps = spark.createDataFrame([], "source_file_id long, target_path string, target_file_id long")
    assert orphans.faulty_references(deps, files, files.select("file_id", "path")).count() == 0


def test_resolution_order(spark):
    files = spark.createDataFrame([(1, "src/a/u.ts"), (2, "src/a/u.js"), (3, "src/lib/util/index.js"), (4, "src/lib/util.ts"), (5, "src/a/d/index.ts")], "file_id long, path string").withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    bases = spark.createDataFrame([("src/a/u",), ("src/lib/util",), ("src/a/d",), ("src/a/u.js",), ("no",), (None,)], "base string")
    assert {r.base: r.found_id for r in orphans.resolve_relative(bases, files).collect()} == {"src/a/u": 2, "src/lib/util": 4, "src/a/d": 5, "src/a/u.js": 2}


def test_hot_key_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, f"p{i}") for i in range(300)] + [(None, "n")], "k long, p string")
    keys = spark.createDataFrame([(1, "one"), (3, "three")], "k long, v string")
    got = orphans.salted_left_join(rows, keys, "k", ["p"], [1])
    assert orphans.hot_keys(rows, "k", 0.1) == [1]
    assert got.count() == 301 and got.filter("v = 'one'").count() == 200 and got.filter("v = 'three'").count() == 1


def test_null_and_hot_keys_are_spread(spark):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(kept, ("false", "-1", "16"), strict=True):
            spark.conf.set(c, v)
        rows = spark.range(12_000).select(F.when(F.col("id") % 10 == 0, F.lit(5)).when(F.col("id") % 100 == 1, F.col("id")).alias("k"), "id")
        keys = spark.range(2_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        joined = orphans.salted_left_join(rows, keys, "k", ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 3 * 12_000 / 16
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "../a": "../a", "a/../../b": "../b", ".\\x\\y": "x/y", "": "", "a//b/": "a/b", "../../a/..": "../.."}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in frame.select("p", normal_path(F.col("p")).alias("n")).collect()} == cases
    row = spark.createDataFrame([("a/b/C.TS", "x")], "p string, q string").select(dirname(F.col("p")), dirname(F.col("q")), extension(F.col("p")), extension(F.col("q"))).first()
    assert tuple(row) == ("a/b", ".", "ts", "x")
