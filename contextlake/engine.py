"""The engine: stored tables in a folder, and the eight actions on them."""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextlake.config import DEFAULTS, deep_merge
from contextlake.embedding import Embedder, embed_new, make_embedder
from contextlake.functions.globs import glob_regex, matches_filter, read_ignore_file
from contextlake.functions.text import content_hash, embedding_text, query_terms, search_text
from contextlake.operators import assembly, graph, search, store
from contextlake.operators.chunking import chunk_files, tokens_of
from contextlake.operators.history import SearchHistory
from contextlake.operators.numbering import numbered
from contextlake.operators.snapshots import SnapshotStore, search_snapshot
from contextlake.schema import SCHEMA_VERSION, TABLES
from contextlake.session import cut, ship_package
from contextlake.sources.project_tree import ProjectTree, missing
from contextlake.storage import Folder

__all__ = ["Engine", "embedding_text"]

MANIFEST = "manifest.json"


class Engine:
    """Tables are folders in ``data_dir`` that never change once written; a manifest names those of each table and is
    swapped as a whole, so a reader sees all of a write or nothing of it. ``data_dir`` may be a path or URI of any file
    system that Spark can reach; ``project_dir`` is a folder that the driver and the executors see."""

    def __init__(self, spark: SparkSession, config: dict[str, Any] | None = None, embedder: Embedder | None = None):
        self.spark, self.config = spark, deep_merge(DEFAULTS, config or {})
        self.embedder = embedder or make_embedder(self.config["embedding"])
        ship_package(spark)
        spark.dataSource.register(ProjectTree)
        self.folder = Folder(spark, self.config["data_dir"])
        self.snapshots = SnapshotStore(self.folder)
        self.history = SearchHistory(self.config["history"]["max_entries"], self.config["history"]["enabled"])
        self._warm: dict[str | None, tuple[str, DataFrame]] = {}
        self._migrate()

    # Tables

    @property
    def manifest(self) -> dict[str, Any]:
        """The folders of each table and the engine's notes; empty before the first write."""
        return json.loads(self.folder.read_text(MANIFEST) or "{}")

    def _migrate(self) -> None:
        """Bring an older folder to the current schema: tables that it lacks are made empty; columns that its tables lack
        read as null. A folder of a newer schema is refused."""
        old = self.manifest
        if (version := old.get("schema_version", 0)) > SCHEMA_VERSION:
            raise ValueError(f"{self.folder.root} has schema version {version}, this engine knows {SCHEMA_VERSION}")
        lacking = {n: self.spark.createDataFrame([], schema) for n, schema in TABLES.items() if n not in old.get("tables", {})}
        if lacking or version < SCHEMA_VERSION:
            created = {} if old else {"created_at": datetime.datetime.now().isoformat()}
            self._write(lacking, **created)

    def table(self, name: str) -> DataFrame:
        """A stored table."""
        return self.spark.read.schema(TABLES[name]).parquet(*map(self.folder.path, self.manifest["tables"][name]))

    def _save(self, name: str, frame: DataFrame) -> str:
        """Write a folder of a table; its name."""
        folder = f"{name}-{uuid.uuid4().hex[:12]}"
        frame.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", ")]).write.parquet(self.folder.path(folder))
        return folder

    def _write(self, tables: dict[str, DataFrame], **notes: Any) -> None:
        """Replace the given tables; the others keep their folders."""
        self._swap({name: [self._save(name, frame)] for name, frame in tables.items()}, **notes)

    def _append(self, name: str, frame: DataFrame) -> None:
        """Add a folder to a table; the next ``index`` writes all of them as one."""
        self._swap({name: [*self.manifest["tables"][name], self._save(name, frame)]})

    def _swap(self, tables: dict[str, list[str]], **notes: Any) -> None:
        """Make the given folders current, then remove those that nothing names any more."""
        old = self.manifest
        new = old | {"version": uuid.uuid4().hex[:12], "schema_version": SCHEMA_VERSION, "tables": old.get("tables", {}) | tables} | notes
        self.folder.write_text(MANIFEST, json.dumps(new))
        live = {f for folders in new["tables"].values() for f in folders} | self.snapshots.held()
        for gone in {f for folders in old.get("tables", {}).values() for f in folders} - live:
            self.folder.delete(gone)

    def warm(self, language: str | None = None) -> int:
        """Keep what searches, or those in one language, read of the current version in memory; the number of chunks."""
        frame = self.table("chunks").select("chunk_id", "file_id", "name", "search_text")
        if language is not None:
            frame = frame.join(self.table("files").filter(F.col("language") == language).select("file_id"), "file_id", "left_semi")
        self._let_go(language)
        self._warm[language] = (self.manifest["version"], frame.persist())
        return frame.count()

    def invalidate(self) -> None:
        """Let go of all that ``warm`` keeps."""
        for language in list(self._warm):
            self._let_go(language)

    def _let_go(self, language: str | None) -> None:
        if kept := self._warm.pop(language, None):
            kept[1].unpersist()

    def _searched(self, language: str | None = None) -> DataFrame:
        """The chunks for a search: the kept ones, unless they are of an older version."""
        for key in dict.fromkeys((language, None)):
            if key in self._warm:
                version, frame = self._warm[key]
                if version == self.manifest["version"]:
                    return frame
                self._let_go(key)
        return self.table("chunks")

    # Actions

    def start(self) -> dict[str, Any] | None:
        """What an engine does first: the saved state is loaded and, if the settings say so, the project is indexed and
        its new chunks are embedded."""
        self.history.load(self.folder)
        if not self.config["indexing"]["auto_index"]:
            return None
        return self.index() | {"embedding": self.embed()}

    def scan(self, sub_path: str = "") -> DataFrame:
        """The files of the project that its rules keep."""
        indexing, ignore = self.config["indexing"], self.config["ignore"]
        patterns = list(ignore["patterns"])
        for name, wanted in ((".gitignore", ignore["use_gitignore"]), (".contextignore", ignore["use_contextignore"])):
            if wanted:
                patterns += read_ignore_file(Path(self.config["project_dir"]) / name)
        options = {
            "path": self.config["project_dir"],
            "subPath": sub_path,
            "extensions": ",".join([*indexing["languages"], *indexing["also_text"]]),
            "maxFileSize": indexing["max_file_size"],
            "maxFiles": indexing["max_files"],
            "ignoreRegex": "\n".join(map(glob_regex, patterns)),
        }
        return self.spark.read.format("projtree").options(**options).load()

    def index(self, path: str = "", force: bool = False) -> dict[str, Any]:
        """Bring the tables up to date with the project; ``force`` makes a snapshot and starts anew."""
        began = time.time()
        if force and self.config["backup"]["before_reindex"] and not self.table("files").isEmpty():
            self.backup("before reindex", "auto")
        stored = self.table("files").filter(F.lit(not force))
        scan = self.scan(path.strip("/")).withColumn("hash", content_hash(F.col("content")))
        diff = cut(store.incremental_diff(scan, stored).filter("action <> 'removed'"))
        gone = cut(missing(stored.join(diff.select("path"), "path", "left_anti").select("path", "file_id"), self.config["project_dir"]), n=F.count("*"))
        counts = {r.action: r["count"] for r in diff.groupBy("action").count().collect()}
        last = stored.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
        new = numbered(diff.filter("action = 'inserted'").select("path"), "path", start=last, name="file_id")
        changed = diff.filter("action = 'updated'").select("path", "file_id").unionByName(new)
        now = F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp")
        fresh = cut(scan.join(changed, "path"))
        dropped = fresh.select("file_id").unionByName(gone.select("file_id"))

        # Chunks are cut once, numbered by file and line, and read back for all that counts or embeds them.
        old_chunks = store.delete_cascade(self.table("chunks").filter(F.lit(not force)), dropped)
        base = old_chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
        made = numbered(chunk_files(fresh, chars_per_token=self.config["indexing"]["token_multiplier"]), "file_id", "start_line", "end_line", start=base, name="chunk_id")
        made = made.withColumn("search_text", search_text(F.col("chunk_type"), F.col("name"), F.col("content"))).withColumn("created_at", now)
        chunks = old_chunks.unionByName(made)
        kept = store.delete_cascade(stored, dropped)
        files = kept.unionByName(fresh.select("file_id", "path", "hash", "language", "size_bytes", F.lit(0).alias("chunk_count"), now.alias("indexed_at"), "modified_at"))
        files = cut(store.count_chunks(files, chunks))
        imports = graph.extract_imports(fresh.select("file_id", "language", "content")).withColumn("source_file_id", F.col("file_id"))
        old_edges = store.set_null_cascade(self.table("dependencies").filter(F.lit(not force)), gone)
        every = store.replace_edges(old_edges.drop("target_file_id"), imports, dropped)
        edges = graph.resolve_imports(every.join(files.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("from_path")), "source_file_id"), files)
        log = store.delete_cascade(self.table("access_log").filter(F.lit(not force)), gone)
        vectors = self.table("vec_chunks").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        self._write({"files": files, "chunks": chunks, "dependencies": edges, "access_log": log, "vec_chunks": vectors}, last_indexed_at=datetime.datetime.now().isoformat(), project_dir=self.config["project_dir"])
        return {"indexed": counts.get("inserted", 0) + counts.get("updated", 0), "skipped": counts.get("skipped", 0), "removed": gone.observed["n"], "seconds": time.time() - began}

    def embed(self) -> dict[str, int]:
        """Embed the chunks that have no vector: how many were, were left as they are, or gave no vector."""
        if not self.embedder or not self.embedder.available():
            return {"embedded": 0, "skipped": self.table("chunks").count(), "errors": 0}
        good = F.size("embedding") > 0
        made = cut(embed_new(self.table("chunks"), self.table("vec_chunks"), self.embedder), embedded=F.count_if(good), errors=F.count_if(~good))
        if made.observed["embedded"]:
            self._append("vec_chunks", made.filter(good))
        return {"embedded": made.observed["embedded"], "skipped": self.table("chunks").count() - made.observed["embedded"] - made.observed["errors"], "errors": made.observed["errors"]}

    def clean_access_log(self, max_age_days: int | None = None) -> int:
        """Drop old accesses; their number."""
        days = self.config["access_log"]["max_age_days"] if max_age_days is None else max_age_days
        log = self.table("access_log")
        kept = cut(store.retained(log, F.current_timestamp(), days), n=F.count("*"))
        removed = log.count() - kept.observed["n"]
        if removed:
            self._write({"access_log": kept})
        return removed

    def save_state(self) -> bool:
        """Save the history, the hot files and the counts; False if that fails."""
        hot = store.most_accessed(store.known_accesses(self.table("access_log"), self.table("files")), self.config["history"]["max_hot_files"])
        stats = store.store_stats(self.table("files"), self.table("chunks")).first()
        try:
            self.history.save(self.folder, hot_files=[r.path for r in hot.collect()], project_dir=self.config["project_dir"], n_files=stats.n_files, n_chunks=stats.n_chunks, total_tokens=stats.total_tokens)
        except Exception:  # noqa: BLE001
            return False
        return True

    def load_state(self) -> dict[str, Any] | None:
        """Load what ``save_state`` saved; None if there is nothing that can be read."""
        return self.history.load(self.folder)

    def search(self, query: str, top_k: int | None = None, language: str | None = None, backup_id: str | None = None) -> dict[str, DataFrame]:
        """The best chunks of the current tables and, if asked for, those of a snapshot."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("search needs a query")
        hits = self._ranked(query, self.config["search"]["top_k"] if top_k is None else top_k, language)
        result = {"results": hits.join(self.table("chunks").select("chunk_id", "start_line", "end_line", "token_count", "content"), "chunk_id").orderBy(F.col("score").desc(), "chunk_id")}
        self.history.record(query, result["results"].count())
        if backup_id:
            folders = self.snapshots.find(backup_id)["tables"]["chunks"]
            old = self.spark.read.schema(TABLES["chunks"]).parquet(*map(self.folder.path, folders))
            result["backup"] = search_snapshot(old, backup_id, query, keep=("file_id", "name", "start_line", "end_line", "content"))
        return result

    def _ranked(self, query: str, k: int, language: str | None = None) -> DataFrame:
        settings = self.config["search"]
        return search.search(self._searched(language), self.table("files"), query, k, language, k1=settings["k1"], b=settings["b"])

    def hybrid_search(self, query: str, top_k: int | None = None, alpha: float = 0.5) -> DataFrame:
        """BM25 and nearest vectors blended; BM25 alone where there are no vectors or the query has none."""
        k = self.config["search"]["top_k"] if top_k is None else top_k
        ranked = self._ranked(query, 2 * k)
        vector = self.embedder.embed_batch([query])[0] if self.embedder and self.embedder.available() and query.strip() else []
        if not vector or self.table("vec_chunks").isEmpty():
            return search.top(ranked.select("chunk_id", "score", F.col("score").alias("bm25_score"), F.lit(0.0).alias("semantic_score")), k)
        return search.hybrid_merge(ranked, search.nearest(self.table("vec_chunks"), vector, 2 * k), alpha, k, self.table("chunks"))

    def status(self) -> dict[str, Any]:
        """Counts, languages, vectors, size, and the last snapshots."""
        files, chunks = self.table("files"), self.table("chunks")
        stats = store.store_stats(files, chunks).first().asDict()
        size = sum(self.folder.size(f) for folders in self.manifest["tables"].values() for f in folders)
        languages = [tuple(r) for r in store.files_by_language(files).collect()]
        return stats | {"languages": languages, "embedded": self.table("vec_chunks").count(), "size_bytes": size, "size_mb": round(size / 1048576, 2), "schema_version": self.manifest["schema_version"], "backups": self.snapshots.entries()[-3:]}

    def files(self, language: str | None = None, pattern: str | None = None) -> DataFrame:
        """Path, language and chunk count of the files, by path."""
        found = self.table("files")
        if language is not None:
            found = found.filter(F.col("language") == language)
        if pattern:
            found = found.filter(matches_filter(F.col("path"), pattern))
        return found.select("path", "language", "chunk_count").orderBy("path")

    def backup(self, label: str | None = None, trigger: str = "manual") -> dict[str, Any]:
        """Make a snapshot, then remove expired ones."""
        entry = self.snapshots.create(self.manifest["tables"], self.table("files").count(), self.table("chunks").count(), label, trigger)
        self.gc()
        return entry

    def restore(self, backup_id: str | None = None) -> str:
        """Make the tables of a snapshot, the last one without an id, the current ones."""
        entry = self.snapshots.find(backup_id)
        self._swap(entry["tables"])
        return entry["id"]

    def export(self, folder: str | None) -> str | None:
        """Write the last snapshot to another folder; its path, None without a folder or a snapshot."""
        return self.snapshots.export_to(Folder(self.spark, folder) if folder else None)

    def gc(self, max_age_days: int | None = None, max_count: int | None = None) -> int:
        """Remove expired snapshots; their number."""
        backup = self.config["backup"]
        live = {f for folders in self.manifest["tables"].values() for f in folders}
        return self.snapshots.gc(backup["max_age_days"] if max_age_days is None else max_age_days, backup["max_backups"] if max_count is None else max_count, live=live)

    def assemble(self, query: str, active_file: str | None = None, budget: int | None = None, layers: list[str] | None = None) -> dict[str, Any]:
        """The best context for a query within a token budget, in four layers."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("assemble needs a query")
        budget = self.config["assembly"]["budget"] if budget is None else max(0, budget)
        limits = assembly.layer_budgets(budget, self.config["assembly"]["layers"])
        wanted = layers or list(limits)
        files, chunks = self.table("files").persist(), self.table("chunks")
        placed = chunks.join(files.select("file_id", "path"), "file_id").withColumn("tokens", F.col("token_count"))
        active = files.filter(F.col("path") == active_file).select("file_id", "path").first() if active_file else None
        out: dict[str, tuple[str, int, list[dict]]] = {}
        used = 0
        if "fixed" in wanted:
            text = self._tree_text(files, limits["fixed"])
            out["fixed"] = (text, 0, [])
        if "short_term" in wanted:
            out["short_term"] = self._current(placed, active, limits["short_term"])
        if "associative" in wanted:
            out["associative"] = self._related(query, placed, active, limits["associative"])
        used = sum(tokens for _, tokens, _ in out.values())
        if "spare" in wanted and (left := assembly.spare_budget(budget, used, self.config["assembly"]["layers"]["spare"])):
            top = store.most_accessed(store.known_accesses(self.table("access_log"), files)).select("file_id", "access_count")
            cheap = assembly.cheapest_chunks(placed.join(F.broadcast(top.select("file_id")), "file_id", "left_semi")).join(F.broadcast(top), "file_id")
            ranked = cheap.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("access_count").desc(), "file_id")))
            out["spare"] = self._section(assembly.greedy_fill(cut(ranked), left).orderBy("rank"))
        self._log(query, active, out)
        files.unpersist()
        used = sum(tokens for _, tokens, _ in out.values())
        self.history.record(query, sum(len(items) for *_, items in out.values()))
        context = assembly.arrange({name: text for name, (text, *_) in out.items()})
        return {"context": context, "metadata": {"query": query, "budget": budget, "tokens_used": used, "tokens_remaining": budget - used, "layers": {n: {"tokens": t, "item_count": len(i)} for n, (_, t, i) in out.items()}}}

    def run(self, action: str, **options: Any) -> Any:
        """An action by name."""
        actions = ("search", "index", "status", "files", "backup", "restore", "gc", "assemble")
        if action not in actions:
            raise ValueError(f"unknown action {action!r}; there are {', '.join(actions)}")
        return getattr(self, action)(**options)

    # Layers

    def _tree_text(self, files: DataFrame, limit: int) -> str:
        paths = [r.path for r in files.filter(F.size(F.split("path", "/")) - 1 <= assembly.TREE_DEPTH).select("path").limit(self.config["indexing"]["max_files"]).collect()]
        for depth in (assembly.TREE_DEPTH, assembly.TREE_DEPTH - 1):
            text = assembly.render_tree(paths, depth)
            if len(text) / 3.5 <= limit:
                return text
        return text[: int(limit * 3.5)]

    @staticmethod
    def _section(items: DataFrame) -> tuple[str, int, list[dict]]:
        rows = [r.asDict() for r in items.select("path", "start_line", "end_line", "tokens", "content", "file_id").collect()]
        text = "\n\n".join(f"## {r['path']}:{r['start_line']}-{r['end_line']}\n{r['content']}" for r in rows)
        return text, sum(r["tokens"] or 0 for r in rows), rows

    def _current(self, placed: DataFrame, active: Any, limit: int) -> tuple[str, int, list[dict]]:
        text, tokens, rows = "", 0, []
        if active:
            text, tokens, rows = self._active(placed, active, limit * assembly.ACTIVE_SHARE)
        if limit - tokens > assembly.LEAST_SPARE:
            recent = store.recent_files(store.known_accesses(self.table("access_log"), self.table("files")), 5)
            if active:
                recent = recent.filter(F.col("file_id") != active.file_id)
            first = assembly.first_chunks(placed.join(F.broadcast(recent.select("file_id")), "file_id", "left_semi")).join(F.broadcast(recent.select("file_id", "last_access")), "file_id").withColumn("age", -F.unix_timestamp("last_access"))
            more = self._section(assembly.prefix_fill(first, limit - tokens, ["age", "file_id"]).orderBy("age", "file_id"))
            text, tokens, rows = "\n\n".join(filter(None, (text, more[0]))), tokens + more[1], rows + more[2]
        return text, tokens, rows

    def _active(self, placed: DataFrame, active: Any, limit: float) -> tuple[str, int, list[dict]]:
        """The active file as it stands in the project, whole if it is within the limit, else its first chunks that are;
        nothing if it can't be read."""
        place = Path(self.config["project_dir"]) / active.path
        try:
            # A file of more bytes than the limit has code points can't be within it, and isn't read.
            whole = place.read_bytes().decode("utf-8", "replace") if os.stat(place).st_size <= 4 * 3.5 * limit else None
        except OSError:
            return "", 0, []
        if whole is not None and (tokens := tokens_of(whole)) <= limit:
            lines = whole.count("\n") + 1
            return f"## {active.path}:1-{lines}\n{whole}", tokens, [{"path": active.path, "start_line": 1, "end_line": lines, "tokens": tokens, "content": whole, "file_id": active.file_id}]
        own = placed.filter(F.col("file_id") == active.file_id)
        return self._section(assembly.prefix_fill_files(own, int(limit), "tokens").orderBy("start_line", "chunk_id"))

    def _related(self, query: str, placed: DataFrame, active: Any, limit: int) -> tuple[str, int, list[dict]]:
        hits = self.hybrid_search(query, 20) if query_terms(query) else self.hybrid_search(query, 0)
        hits = hits.select("chunk_id", "score").join(placed, "chunk_id").select("chunk_id", "path", "start_line", "tokens", "score")
        extra = placed.filter(F.lit(False))
        if active:
            roots = self.spark.createDataFrame([(active.file_id,)], "file_id long")
            walked = graph.transitive_dependencies(self.table("dependencies"), roots, self.config["assembly"]["dependency_depth"])
            extra = graph.dependency_chunks(walked, placed)
        ranked = assembly.related_items(hits, extra.select("chunk_id", "path", "start_line", "tokens"))
        kept = assembly.greedy_fill(ranked, limit)
        return self._section(placed.join(F.broadcast(kept.select("chunk_id", "rank")), "chunk_id").orderBy("rank"))

    def _log(self, query: str, active: Any, out: dict[str, tuple[str, int, list[dict]]]) -> None:
        ids = ([active.file_id] if active else []) + list(dict.fromkeys(r["file_id"] for r in out.get("associative", ("", 0, []))[2]))
        if not ids:
            return
        log = self.table("access_log")
        base = log.agg(F.coalesce(F.max("access_id"), F.lit(0))).first()[0]
        now = datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0)
        new = self.spark.createDataFrame([(base + n, i, query, now) for n, i in enumerate(ids, 1)], TABLES["access_log"])
        self._append("access_log", new)
