"""Changes, cascades, histories, graph walks, snapshots and assembly."""

import datetime

import pytest
from pyspark.sql import functions as F

from contextlake.operators import assembly, graph, store
from contextlake.operators.components import connected_components
from contextlake.operators.history import SearchHistory
from contextlake.operators.numbering import numbered
from contextlake.operators.snapshots import SnapshotStore, expired
from contextlake.storage import Folder
from contextlake.streaming.access import read_access_stream, windowed_access


def test_diff(spark):
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "path string, hash string")
    stored = spark.createDataFrame([("a", "1", 1), ("b", "0", 2), ("d", "4", 4), ("n", None, 5)], "path string, hash string, file_id long")
    assert {(r.path, r.action, r.file_id) for r in store.incremental_diff(scan, stored).collect()} == {("a", "skipped", 1), ("b", "updated", 2), ("c", "inserted", None), ("d", "removed", 4), ("n", "skipped", 5)}


def test_cascades(spark):
    deps = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", None), (None, "d", 2)], "source_file_id long, target_path string, target_file_id long")
    gone = spark.createDataFrame([(2,), (2,), (None,)], "file_id long")
    assert {tuple(r) for r in store.set_null_cascade(deps, gone).collect()} == {(1, "a", None), (3, "c", None), (None, "d", None)}
    fresh = spark.createDataFrame([(1, "a", 7, 0), (1, "a", 8, 1)], "source_file_id long, target_path string, target_file_id long, position int")
    assert {tuple(r) for r in store.replace_edges(deps.limit(2), fresh, fresh.select(F.col("source_file_id").alias("file_id"))).collect()} == {(1, "a", 8), (2, "b", 1)}


def test_unique_queries(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "b"), (3, "a"), (4, "c"), (5, None), (6, " \t"), (7, " B ")], "seq long, query string")
    assert [r.query for r in store.recent_unique_queries(rows).collect()] == [" B ", "c", "a"]
    history = SearchHistory(cap=3)
    for query in ("A", "b", "a", "c", " ", None):
        history.record(query, 1)
    assert history.recent() == ["c", "a", "b"] and len(history.items) == 3


def test_history_state(spark, tmp_path):
    folder, history = Folder(spark, f"file://{tmp_path}/s"), SearchHistory(2)
    for query in ("a", " ", "b", "A", None):
        history.record(query, 1)
    assert history.recent() == ["A", "b"] and [i["query"] for i in history.items] == ["b", "A"]
    history.save(folder, hot_files=["x"], n_files=3)
    again = SearchHistory(5)
    assert again.load(folder)["hot_files"] == ["x"] and again.recent() == ["A", "b"] and again.frame(spark).count() == 2
    for broken in ("{broken", "[]", '{"version": 9}', '{"version": 1, "saved_at": "x", "history": 3}'):
        folder.write_text("state.json", broken)
        assert SearchHistory().load(folder) is None
    folder.write_text("state.json", '{"version": 1, "saved_at": "x", "history": [{"query": 1}, {"query": "q", "timestamp": "2024-01-01", "result_count": 2}]}')
    assert again.load(folder) and again.recent() == ["q"] and SearchHistory().load(folder, "none.json") is None


def test_walk(spark):
    deps = spark.createDataFrame([(1, "2", 2), (1, "3", 3), (1, "n", None), (2, "4", 4), (3, "1", 1), (4, "5", 5)], "source_file_id long, target_path string, target_file_id long")
    roots = spark.createDataFrame([(1,)], "file_id long")
    got = {(r.source_file_id, r.target_file_id, r.depth) for r in graph.transitive_dependencies(deps, roots, 2).collect()}
    assert got == {(1, 2, 1), (1, 3, 1), (1, None, 1), (2, 4, 2), (3, 1, 2)}
    assert graph.transitive_dependencies(deps, roots, 0).count() == 0
    assert graph.transitive_dependencies(deps, roots, 9).count() == 6


def test_imports(spark):
    code = "import a from './a'; const b = require('../lib/b'); const c = await import('./c'); import 'react';"
    rows = spark.createDataFrame([(1, "js", code), (2, "xx", code), (3, "py", None), (4, "rs", "use crate::a::b;\nmod x;"), (5, "py", "from a.b import c\nimport os, sys")], "file_id long, language string, content string")
    got = {(r.file_id, r.position, r.target_path, r.dep_type) for r in graph.extract_imports(rows).collect()}
    assert {g for g in got if g[0] == 1} == {(1, 0, "./a", "import"), (1, 1, "react", "external"), (1, 2, "../lib/b", "import"), (1, 3, "./c", "import")}
    assert {g[2:] for g in got if g[0] in (4, 5)} == {("crate::a::b", "use"), ("x", "mod"), ("a.b", "import"), ("os", "import")} and not {g for g in got if g[0] in (2, 3)}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 1) for i in range(1, 6)} | {(8, 8), (9, 8)}
    assert connected_components(edges.limit(0)).count() == 0


def test_fills(spark):
    items = spark.createDataFrame([(1, 60), (2, 50), (3, 30), (4, None)], "rank long, tokens long")
    assert {r.rank for r in assembly.greedy_fill(items, 100).collect()} == {1, 3, 4}
    assert [r.rank for r in assembly.prefix_fill(items, 100, ["rank"]).collect()] == [1]
    assert assembly.greedy_fill(items.limit(0), 100).count() == 0
    assert assembly.layer_budgets(40_000) == {"fixed": 4000, "short_term": 12_000, "associative": 16_000, "spare": 8000}
    assert assembly.spare_budget(1000, 600) == 0 and assembly.spare_budget(40_000, 0) == 8000
    assert assembly.arrange({"short_term": "d", "fixed": "a", "spare": "", "associative": "b"}) == "a\n---\nb\n---\nd"


def test_tree(spark):
    paths = ["src/a.js", "src/lib/b.js", "README.md", "_hidden.js", "src/_x.js", "a/b/c/d/e.js"]
    assert assembly.render_tree(paths) == "src/\n├── lib/\n│   └── b.js\n└── a.js\nREADME.md"
    assert assembly.render_tree([]) == "(no indexed files)"
    rows = assembly.tree_entries(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {(r.entry, r.depth, r.is_dir) for r in rows} == {("src", 1, True), ("src/a.js", 2, False), ("src/lib", 2, True), ("src/lib/b.js", 3, False), ("README.md", 1, False)}


def test_snapshots(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d" / "x-1"))
    spark.range(2).write.parquet(str(tmp_path / "d" / "x-2"))
    snapshots = SnapshotStore(Folder(spark, f"file://{tmp_path}/d"))
    start = datetime.datetime(2024, 1, 1)
    made = [snapshots.create({"x": ["x-1"] if h < 2 else ["x-1", "x-2"]}, 1, 2, now=start + datetime.timedelta(hours=h // 2)) for h in range(12)]
    assert len({e["id"] for e in made}) == 12 and 0 < made[0]["size_bytes"] < made[2]["size_bytes"]
    frame = snapshots.frame(spark)
    assert {r.id for r in expired(frame, start + datetime.timedelta(days=1)).collect()} == {e["id"] for e in made[:2]}
    assert snapshots.gc(now=start + datetime.timedelta(days=1)) == 2 and len(snapshots.entries()) == 10
    assert snapshots.export_to(Folder(spark, str(tmp_path / "out"))).endswith(made[-1]["id"]) and snapshots.export_to(None) is None
    assert spark.read.parquet(f"{tmp_path}/out/{made[-1]['id']}/x").count() == 5
    assert snapshots.gc(max_count=0, live=["x-2"]) == 10 and snapshots.entries() == []
    assert not (tmp_path / "d" / "x-1").exists() and (tmp_path / "d" / "x-2").exists()
    with pytest.raises(ValueError):
        snapshots.find()


def test_numbers(spark):
    frame = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "a long, b string").repartition(5)
    got = sorted((r.a, r.place) for r in numbered(frame, "a", start=10, name="place").collect())
    assert got == [(i, i + 11) for i in range(100)]
    assert numbered(frame.limit(0), "a").count() == 0


def test_many_items_are_filled_in_blocks(spark):
    items = spark.range(1, 100_001).select(F.col("id").alias("rank"), (F.col("id") % 7 * 10).alias("tokens"))
    used, kept = 0, set()
    for rank in range(1, 100_001):
        if used + rank % 7 * 10 <= 500:
            used += rank % 7 * 10
            kept.add(rank)
    assert {r.rank for r in assembly.greedy_fill(items, 500).collect()} == kept
    hits = spark.createDataFrame([(5, "p", 1, 10, 2.0), (4, "q", 1, 10, 1.0)], "chunk_id long, path string, start_line int, tokens long, score double")
    extra = spark.range(1000, 101_000).select(F.col("id").alias("chunk_id"), F.lit("p").alias("path"), (F.col("id") - 999).cast("int").alias("start_line"), F.lit(40).cast("bigint").alias("tokens"))
    ranked = assembly.related_items(hits, extra)
    assert ranked.count() == 100_001 and ranked.filter("rank <= 2").count() == 2
    assert [(r.rank, r.chunk_id) for r in assembly.greedy_fill(ranked, 100).orderBy("rank").collect()] == [(1, 5), (2, 4), (3, 1001), (4, 1002)]


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10)
    rows = [(1, 7, "q", t), (1, 7, "q", t), (2, 7, None, t + datetime.timedelta(minutes=5)), (3, 8, "x", t + datetime.timedelta(hours=2)), (None, 8, "x", t)]
    frame = spark.createDataFrame(rows, "access_id long, file_id long, query string, accessed_at timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "log"))
    query = windowed_access(read_access_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.file_id, r.n) for r in spark.table("windows").collect()} == {(7, 2), (8, 1)} == {(r.file_id, r.n) for r in windowed_access(frame).collect()}
