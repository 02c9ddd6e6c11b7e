"""The eight actions on a small project."""

import http.server
import json
import threading

import pytest

from contextlake.config import deep_merge, load_config
from contextlake.embedding import HashingEmbedder, embed_new, make_embedder
from contextlake.engine import Engine
from contextlake.sources.project_tree import ProjectTree, missing


def _project(root):
    (root / "src" / "lib").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "auth.js").write_text("import { http } from './lib/http';\n\nexport async function login(user) {\n  if (!user) {\n    throw new Error('x');\n  }\n  return http(user);\n}\n")
    (root / "src" / "lib" / "http.js").write_text("export function http(user) {\n  const token = user.token;\n  return fetch(token);\n}\n")
    (root / "src" / "_util.py").write_text("def helper():\n    a = 1\n    return a\n")
    (root / "src" / "empty.js").write_text("")
    (root / "node_modules" / "x.js").write_text("var x = 1;\n")
    (root / "notes.md").write_text("# Notes\n\nlogin notes\n")


@pytest.fixture
def engine(spark, tmp_path):
    _project(tmp_path / "p")
    return Engine(spark, {"project_dir": str(tmp_path / "p"), "data_dir": str(tmp_path / "d")}, HashingEmbedder())


def test_actions(engine, tmp_path):
    first = engine.run("index")
    assert (first["indexed"], first["skipped"], first["removed"]) == (4, 0, 0)
    assert [r.path for r in engine.files().collect()] == ["notes.md", "src/_util.py", "src/auth.js", "src/lib/http.js"]
    again = engine.index()
    assert (again["indexed"], again["skipped"]) == (0, 4)
    edge = engine.table("dependencies").first()
    assert edge.target_path == "./lib/http" and edge.target_file_id is not None
    assert engine.search("login")["results"].first().path == "src/auth.js"
    assert engine.warm() == 4 and engine.search("login")["results"].first().path == "src/auth.js"
    assert engine.warm("py") == 1 and engine.search("helper", language="py")["results"].first().path == "src/_util.py"
    assert engine.embed() == {"embedded": 4, "skipped": 0, "errors": 0} and engine.embed() == {"embedded": 0, "skipped": 4, "errors": 0}
    assert {"chunk_id", "score", "bm25_score", "semantic_score"} == set(engine.hybrid_search("login user").columns)
    status = engine.status()
    assert status["n_files"] == 4 and status["embedded"] == 4 and ("js", 2) in status["languages"]
    assert engine.files(language="js", pattern="*http*").count() == 1
    backup = engine.backup("one")
    (tmp_path / "p" / "src" / "auth.js").write_text("export function logout(user) {\n  const gone = user;\n  return gone;\n}\n")
    (tmp_path / "p" / "notes.md").unlink()
    changed = engine.index()
    assert (changed["indexed"], changed["skipped"], changed["removed"]) == (1, 2, 1)
    assert engine.search("login")["results"].count() == 0
    assert engine.search("login", backup_id=backup["id"])["backup"].count() > 0
    assert engine.restore() == backup["id"] and engine.search("login")["results"].count() > 0
    result = engine.assemble("login user", active_file="src/auth.js", budget=4000)
    assert "src/auth.js" in result["context"] and 0 < result["metadata"]["tokens_used"] <= 4000
    assert engine.table("access_log").count() > 0 and engine.assemble("login", budget=0)["metadata"]["tokens_used"] == 0
    assert "login notes" in engine.assemble("login", active_file="notes.md", budget=4000)["context"]
    assert engine.save_state() and engine.load_state()["hot_files"][0] in ("src/auth.js", "notes.md") and engine.load_state()["n_files"] == 4
    assert engine.export(str(tmp_path / "out")) == f"{tmp_path}/out/{backup['id']}" and engine.spark.read.parquet(f"{tmp_path}/out/{backup['id']}/files").count() == 4
    assert engine.export(None) is None and engine.clean_access_log() == 0 and engine.clean_access_log(-1) > 0 and engine.table("access_log").count() == 0
    assert engine.gc(max_count=0) == 1
    with pytest.raises(ValueError):
        engine.run("nope")
    with pytest.raises(ValueError):
        engine.search(" ")
    with pytest.raises(ValueError):
        engine.restore("none")


def test_source_options(spark, tmp_path):
    _project(tmp_path)
    spark.dataSource.register(ProjectTree)
    read = lambda **o: {r.path for r in spark.read.format("projtree").options(path=str(tmp_path), **o).load().select("path").collect()}
    assert read(extensions="js,py") == {"src/auth.js", "src/lib/http.js", "src/_util.py", "node_modules/x.js"}
    assert read(extensions="js", skipDirs="node_modules,lib") == {"src/auth.js"} and read(ignoreText="lib/\nmodules") == {"src/auth.js", "src/_util.py", "notes.md"}
    assert read(maxFiles="1") == {"node_modules/x.js"} and read(subPath="src/lib") == {"src/lib/http.js"} and read(maxFileSize="40") == {"src/_util.py", "node_modules/x.js", "notes.md"}
    stored = spark.createDataFrame([("notes.md", 1), ("gone.md", 2), (None, 3)], "path string, file_id long")
    assert [r.file_id for r in missing(stored, str(tmp_path)).collect()] == [2]


def test_uri_migration_and_settings(spark, tmp_path):
    _project(tmp_path / "p")
    settings = {"project_dir": str(tmp_path / "p"), "data_dir": f"file://{tmp_path}/d", "embedding": {"enabled": True}, "indexing": {"token_multiplier": 1.0}, "search": {"k1": 0.0}}
    engine = Engine(spark, settings)
    done = engine.start()
    assert done["indexed"] == 4 and done["embedding"]["embedded"] == 4
    row = engine.table("chunks").filter("name = 'login'").first()
    assert row.token_count == len(row.content)
    assert engine.search("user", top_k=9)["results"].select("chunk_id").count() == 2
    assert sorted(r.chunk_id for r in engine.table("chunks").collect()) == [1, 2, 3, 4]
    manifest = engine.manifest
    engine.folder.write_text("manifest.json", json.dumps(manifest | {"schema_version": 1, "tables": {k: v for k, v in manifest["tables"].items() if k not in ("access_log", "vec_chunks")}}))
    older = Engine(spark, settings | {"embedding": {"enabled": False}, "indexing": {"auto_index": False}})
    assert older.status()["schema_version"] == 3 and older.table("vec_chunks").count() == 0 and older.table("files").count() == 4
    assert older.start() is None and older.embed() == {"embedded": 0, "skipped": 4, "errors": 0}
    older.folder.write_text("manifest.json", json.dumps(manifest | {"schema_version": 99}))
    with pytest.raises(ValueError):
        Engine(spark, settings)


def test_failing_texts_are_counted_alone(spark):
    class Failing:
        model = "failing"

        def available(self):
            return True

        def embed_batch(self, texts):
            if any("bad" in t for t in texts):
                raise OSError("bad")
            return [[1.0] for _ in texts]

    chunks = spark.createDataFrame([(1, "a", "m", "good"), (2, "b", "m", "bad"), (3, "c", "m", None), (3, "c", "m", None)], "chunk_id long, name string, chunk_type string, content string")
    made = embed_new(chunks, spark.createDataFrame([], "chunk_id long"), Failing()).collect()
    assert {r.chunk_id: len(r.embedding) for r in made} == {1: 1, 2: 0, 3: 1}


def test_http_embedder():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = self.path == "/api/embed"
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": [[float(len(body["input"])), 1.0]]} if good else {}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    there = make_embedder({"enabled": True, "provider": "http", "model": "m", "endpoint": f"http://127.0.0.1:{server.server_port}/"})
    assert there.available() and there.dimensions == 2
    assert there.embed_batch(["x" * 3000, " ", ""]) == [[2000.0, 1.0], [], []]
    server.shutdown()
    server.server_close()
    there.reset()
    assert not there.available() and make_embedder({"enabled": False}) is None


def test_config(tmp_path):
    assert deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / "c.json").write_text('{"search": {"top_k": 3}, "data_dir": "x"}')
    config = load_config(tmp_path / "c.json", {"CONTEXTLAKE_BUDGET": "9", "CONTEXTLAKE_EMBEDDING": "true"})
    assert config["search"] == {"k1": 1.2, "b": 0.75, "top_k": 3} and config["assembly"]["budget"] == 9 and config["embedding"]["enabled"] is True and config["data_dir"] == str(tmp_path / "x")
