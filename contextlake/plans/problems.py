"""The queries of the general data-processing problems 2 and 4, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.operators import forest, orphans
from contextlake.session import cut
from contextlake.sources.tables import table


def _chains(spark: SparkSession, folder: str) -> DataFrame:
    return forest.chains(forest.module_links(table(spark, folder, "dependencies"), table(spark, folder, "files")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every file in a module tree, -1 on and below cycles."""
    return _chains(spark, folder).select(F.col("node").alias("file_id"), F.col("root").alias("root_file_id"), F.col("depth").alias("tree_depth"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path of file ids from the root to every file of a module tree."""
    return forest.paths(cut(_chains(spark, folder))).select(F.col("node").alias("file_id"), F.array_join("path", "/").alias("path"))


def p2_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The descendants of every file as an interval of places in its tree's walk."""
    return _chains(spark, folder).select(F.col("node").alias("file_id"), F.col("root").alias("root_file_id"), "size", "first", "last")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a module tree with every file beneath it."""
    found = forest.descendants(cut(_chains(spark, folder)))
    return found.select(F.col("node").alias("file_id"), F.col("descendant").alias("descendant_id"), "distance")


def _faults(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.faulty_references(table(spark, folder, "dependencies"), table(spark, folder, "files"), table(spark, folder, "removed_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References at fault, with the kind of fault."""
    return _faults(spark, folder).select("source_file_id", "target_path", "kind")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of each parent table, kind and month of the source file."""
    return orphans.fault_report(_faults(spark, folder)).withColumn("period", F.date_format("period", "yyyy-MM"))


_TREE = """
WITH RECURSIVE e AS (
    SELECT min(source_file_id) AS s, target_file_id AS t FROM dependencies
    WHERE dep_type = 'mod' AND source_file_id IN (SELECT file_id FROM files) AND target_file_id IN (SELECT file_id FROM files) GROUP BY target_file_id
), n AS (SELECT s AS node FROM e UNION SELECT t FROM e),
r AS (
    SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, CAST(node AS VARCHAR) AS path, [node] AS up FROM n WHERE node NOT IN (SELECT t FROM e)
    UNION ALL SELECT e.t, r.root, r.depth + 1, r.path || '/' || e.t, list_append(r.up, e.t) FROM r JOIN e ON e.s = r.node
)
"""

_WALK = """, sz AS (SELECT a AS node, count(*) AS size FROM (SELECT unnest(up) AS a FROM r) GROUP BY 1),
k AS (SELECT s, t, size, row_number() OVER (PARTITION BY s ORDER BY size DESC, t) AS hn FROM e JOIN sz ON node = t),
o AS (
    SELECT t AS node, CASE WHEN hn = 1 THEN 1 ELSE 1 + max(CASE WHEN hn = 1 THEN size END) OVER (PARTITION BY s)
        + coalesce(sum(CASE WHEN hn > 1 THEN size END) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS step FROM k
), w AS (SELECT u.node, CAST(coalesce(sum(step), 0) AS BIGINT) AS first FROM (SELECT node, unnest(up) AS a FROM r) u LEFT JOIN o ON o.node = u.a GROUP BY 1)
"""

_NORMAL = "list_reduce(string_split({}, '/'), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' AND a <> '' AND a <> '..' AND NOT ends_with(a, '/..') THEN regexp_replace(a, '/?[^/]+$', '') WHEN a = '' THEN x ELSE a || '/' || x END, '')"

_FAULTS = f"""
WITH l AS (
    SELECT file_id, {_NORMAL.format("replace(arg_max(path, coalesce(indexed_at, TIMESTAMP '0001-01-01')), chr(92), '/')")} AS path, max(indexed_at) AS indexed_at FROM files WHERE file_id IS NOT NULL GROUP BY file_id
), r AS (SELECT source_file_id, target_path, min(target_file_id) AS target_file_id FROM dependencies GROUP BY 1, 2),
k AS (
    SELECT r.*, s.path AS source_path, s.indexed_at AS source_at, s.file_id IS NOT NULL AS source_there, t.file_id IS NOT NULL AS target_there,
        r.target_file_id IN (SELECT file_id FROM removed_files WHERE file_id IS NOT NULL) AS target_gone
    FROM r LEFT JOIN l s ON s.file_id = r.source_file_id LEFT JOIN l t ON t.file_id = r.target_file_id
), b AS (
    SELECT *, CASE WHEN target_file_id IS NULL AND source_there AND (target_path LIKE './%' OR target_path LIKE '../%')
        THEN {_NORMAL.format("CASE WHEN source_path LIKE '%/%' THEN regexp_replace(source_path, '/[^/]*$', '') ELSE '.' END || '/' || target_path")} END AS base FROM k
), x AS (SELECT unnest({list(orphans.IMPORT_ENDINGS)}) AS ending, unnest(range({len(orphans.IMPORT_ENDINGS)})) AS rank),
p AS (SELECT path, arg_min(indexed_at, file_id) AS found_at FROM l GROUP BY path),
f AS (SELECT base, first(found_at ORDER BY rank) AS found_at FROM (SELECT DISTINCT base FROM b WHERE base IS NOT NULL) CROSS JOIN x JOIN p ON p.path = base || ending GROUP BY base),
g AS (
    SELECT b.source_file_id, b.target_path, b.source_at, CASE
        WHEN NOT source_there THEN 'source_missing'
        WHEN target_file_id IS NOT NULL AND NOT target_there THEN CASE WHEN target_gone THEN 'target_removed' ELSE 'target_missing' END
        WHEN b.base IS NOT NULL AND f.base IS NULL THEN 'path_missing'
        WHEN b.base IS NOT NULL AND f.found_at > source_at THEN 'target_late' END AS kind
    FROM b LEFT JOIN f ON f.base = b.base
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p2_found, p2_paths, p2_intervals, p2_descendants, p4_found, p4_report)}


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return {
        "p2_found": _TREE + "SELECT node AS file_id, root AS root_file_id, depth AS tree_depth FROM r UNION ALL SELECT node, -1, -1 FROM n WHERE node NOT IN (SELECT node FROM r)",
        "p2_paths": _TREE + "SELECT node AS file_id, path FROM r UNION ALL SELECT node, NULL FROM n WHERE node NOT IN (SELECT node FROM r)",
        "p2_intervals": _TREE + _WALK + "SELECT r.node AS file_id, root AS root_file_id, size, first, first + size - 1 AS last FROM r JOIN sz ON sz.node = r.node JOIN w ON w.node = r.node UNION ALL SELECT node, -1, -1, -1, -1 FROM n WHERE node NOT IN (SELECT node FROM r)",
        "p2_descendants": _TREE + "SELECT file_id, node AS descendant_id, len(up) - pos AS distance FROM (SELECT node, up, unnest(up) AS file_id, unnest(range(1, len(up) + 1)) AS pos FROM r) WHERE file_id <> node",
        "p4_found": _FAULTS + "SELECT source_file_id, target_path, kind FROM g WHERE kind IS NOT NULL",
        "p4_report": _FAULTS + "SELECT CASE WHEN kind IN ('path_missing', 'target_late') THEN 'files.path' ELSE 'files' END AS parent_table, kind, strftime(source_at, '%Y-%m') AS period, count(*) AS n FROM g WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
    }
