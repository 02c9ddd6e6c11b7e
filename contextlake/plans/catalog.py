"""The queries of the engine's own operators, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextlake import embedding
from contextlake.functions import globs
from contextlake.functions.paths import normal_path
from contextlake.functions import text as T
from contextlake.operators import assembly, chunking, graph, search, snapshots, store
from contextlake.operators.orphans import IMPORT_ENDINGS
from contextlake.plans.problems import _NORMAL
from contextlake.session import cut
from contextlake.sources.model import current_chunks, current_files
from contextlake.sources.tables import table
from contextlake.streaming.access import windowed_access

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The literal queries and parameters of the catalogue.
WORDS = "token queue plan"
TERMS = ["token", "queue", "plan"]
IGNORE = ["node_modules/**", "packages/*/vendor/**", "*.min.js", "*.lock.json", "packages/*/dist/", "/docs", "packages/**/fixtures/*"]
PATTERN = "*queue*.ts"
SNAPSHOT_TIME = "2024-10-01 00:00:00"
ALPHA = 0.5

_CF = "cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(indexed_at, TIMESTAMP '0001-01-01') DESC, coalesce(hash, '') DESC) AS rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1)"
_CC = "cc AS (SELECT chunk_id, min(file_id) AS file_id, min(chunk_type) AS chunk_type, min(name) AS name, min(start_line) AS start_line, min(end_line) AS end_line, min(token_count) AS token_count, min(search_text) AS search_text, min(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
_LOG = "al AS (SELECT a.*, cf.path FROM (SELECT access_id, min(file_id) AS file_id, min(query) AS query, min(accessed_at) AS accessed_at FROM access_log WHERE access_id IS NOT NULL GROUP BY access_id) a JOIN cf USING (file_id))"
_DEPS = "dp AS (SELECT source_file_id, target_path, max(target_file_id) AS target_file_id, max(dep_type) AS dep_type FROM dependencies GROUP BY 1, 2)"
_ACTIVE = "act AS (SELECT source_file_id AS file_id FROM dp WHERE target_file_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return current_files(table(spark, folder, "files"))


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_chunks(table(spark, folder, "chunks"), *columns)


def _accesses(spark: SparkSession, folder: str) -> DataFrame:
    return store.known_accesses(table(spark, folder, "access_log"), _files(spark, folder))


def _deps(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(table(spark, folder, "dependencies"))


def _active(spark: SparkSession, folder: str) -> DataFrame:
    """The file with the most resolved imports, as the one that is being worked on."""
    counts = _deps(spark, folder).filter("target_file_id is not null").groupBy("source_file_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "source_file_id").limit(1).select(F.col("source_file_id").alias("file_id"))


# Files and texts


@query("SELECT doc_id, sha256(text)[1:16] AS hash, CAST(ceil(length(coalesce(text, '')) / 3.5) AS BIGINT) AS tokens, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def file_hash_tokens(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.estimate_tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query(_with(_CF) + "SELECT file_id, path, lower(regexp_extract(path, '[^.]*$')) AS extension FROM cf WHERE language = 'ts' ORDER BY path, file_id")
def files_by_language(spark, folder):
    files = _files(spark, folder).filter(F.col("language") == "ts")
    return files.select("file_id", "path", F.lower(F.substring_index("path", ".", -1)).alias("extension")).orderBy("path", "file_id")


@query(_with(_CF) + "SELECT language, count(*) AS n_files FROM cf GROUP BY language")
def language_stats(spark, folder):
    return store.files_by_language(_files(spark, folder))


@query(_with(_CF, _CC) + "SELECT (SELECT count(*) FROM cf) AS n_files, (SELECT max(indexed_at) FROM cf) AS last_indexed, (SELECT count(*) FROM cc) AS n_chunks, (SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) FROM cc) AS total_tokens")
def store_stats(spark, folder):
    return store.store_stats(_files(spark, folder), _chunks(spark, folder, "token_count"))


@query(_with(_CF) + "SELECT file_id, path, language, chunk_count FROM cf WHERE regexp_matches(path, '.*queue.*.ts', 'i')")
def files_pattern_filter(spark, folder):
    files = _files(spark, folder)
    return files.filter(globs.matches_filter(F.col("path"), PATTERN)).select("file_id", "path", "language", "chunk_count").orderBy("path", "file_id")


@query(_with(_CF) + f"SELECT file_id, path, coalesce(regexp_matches(replace(path, chr(92), '/'), '{'|'.join(map(globs.glob_regex, IGNORE))}', 'i'), false) AS ignored FROM cf")
def ignore_filter(spark, folder):
    return _files(spark, folder).select("file_id", "path", globs.ignored(F.col("path"), IGNORE).alias("ignored"))


@query(_with(_CF) + "SELECT file_id, path, size_bytes FROM cf WHERE size_bytes > 0 AND size_bytes <= 1048576 ORDER BY path, file_id LIMIT 50000")
def size_filter_cap(spark, folder):
    files = _files(spark, folder).filter((F.col("size_bytes") > 0) & (F.col("size_bytes") <= 1 << 20))
    return files.select("file_id", "path", "size_bytes").orderBy("path", "file_id").limit(50_000)


_SKIPPED = ", ".join(f"'{d}'" for d in globs.SKIPPED_DIRS)


@query(_with(_CF, "p AS (SELECT file_id, replace(path, chr(92), '/') AS path, size_bytes FROM cf)") + f"SELECT file_id, path FROM p WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('ts', 'py', 'md') AND size_bytes > 0 AND size_bytes <= 4000 AND NOT contains(path, 'vendor') AND NOT contains(path, 'Map') AND NOT list_has_any(string_split(path, '/')[:-2], [{_SKIPPED}])")
def quick_scan_filter(spark, folder):
    files = _files(spark, folder)
    kept = files.filter(globs.quick_scan_keeps(F.col("path"), F.col("size_bytes"), ["ts", "py", "md"], ["vendor", "Map"], 4000))
    return kept.select("file_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))


@query(_with(_CF, _CC) + "SELECT chunk_id, file_id, path, language, start_line, name FROM cc JOIN cf USING (file_id)")
def chunk_file_join(spark, folder):
    chunks = _chunks(spark, folder, "file_id", "start_line", "name")
    return chunks.join(_files(spark, folder).select("file_id", "path", "language"), "file_id").select("chunk_id", "file_id", "path", "language", "start_line", "name")


@query(_with(_CF, _CC) + "SELECT file_id, path, count(chunk_id) AS stored_chunks FROM cf LEFT JOIN cc USING (file_id) GROUP BY 1, 2")
def chunk_counts(spark, folder):
    counted = store.count_chunks(_files(spark, folder), _chunks(spark, folder, "file_id"))
    return counted.select("file_id", "path", F.col("chunk_count").cast("bigint").alias("stored_chunks"))


@query(
    _with(
        _CC,
        "w AS (SELECT chunk_id, chunk_type, name, regexp_extract_all(coalesce(content, ''), '[A-Za-z_][A-Za-z0-9_]{2,}') AS ws FROM cc)",
        "u AS (SELECT chunk_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w)",
        "f AS (SELECT chunk_id, word, min(pos) AS pos FROM u GROUP BY 1, 2)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS rn FROM f)",
        "j AS (SELECT chunk_id, string_agg(word, ' ' ORDER BY pos) AS words FROM r WHERE rn <= 50 GROUP BY 1)",
    )
    + "SELECT w.chunk_id, lower(concat_ws(' ', chunk_type, nullif(name, ''), j.words)) AS built FROM w LEFT JOIN j USING (chunk_id)"
)
def search_text_build(spark, folder):
    return _chunks(spark, folder, T.search_text(F.col("chunk_type"), F.col("name"), F.col("content")).alias("built"))


@query(_with("a AS (SELECT access_id, min(query) AS query FROM access_log WHERE access_id IS NOT NULL GROUP BY 1)") + r"SELECT access_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(query, '')), '[^a-z0-9_\s\x{3131}-\x{D79D}]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2), ' ') AS terms FROM a")
def query_tokenize(spark, folder):
    log = table(spark, folder, "access_log").filter("access_id is not null").groupBy("access_id").agg(F.min("query").alias("query"))
    return log.select("access_id", F.array_join(T.term_column(F.col("query")), " ").alias("terms"))


@query(_with("a AS (SELECT access_id, min(query) AS query FROM access_log WHERE access_id IS NOT NULL GROUP BY 1)") + r"SELECT access_id, array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(query, '')), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: strlen(w) >= 2), ' ') AS terms FROM a")
def query_tokenize_bytes(spark, folder):
    log = table(spark, folder, "access_log").filter("access_id is not null").groupBy("access_id").agg(F.min("query").alias("query"))
    return log.select("access_id", F.array_join(T.byte_terms(F.col("query")), " ").alias("terms"))


@query("SELECT doc_id, CAST(ceil(strlen(coalesce(text, '')) / 3.5) AS BIGINT) AS tokens, strftime(make_timestamp(CAST(floor(epoch(created_at)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS made FROM documents")
def byte_tokens_and_times(spark, folder):
    docs = table(spark, folder, "documents")
    seconds = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000)
    return docs.select("doc_id", T.estimate_tokens_bytes(F.col("text")).alias("tokens"), T.iso_time(seconds).alias("made"))


@query(_with(_CF, _CC, _LOG) + "SELECT chunk_id, file_id, start_line, name FROM cc WHERE file_id IN (SELECT file_id FROM al GROUP BY 1 ORDER BY count(*) DESC, file_id LIMIT 5)")
def chunks_of_files(spark, folder):
    wanted = store.most_accessed(_accesses(spark, folder)).select("file_id")
    return _chunks(spark, folder, "file_id", "start_line", "name").join(F.broadcast(wanted), "file_id", "left_semi").select("chunk_id", "file_id", "start_line", "name")


@query("SELECT doc_id, " + ", ".join(f"(length(d) - length(replace(d, '{t}', ''))) / {len(t)}.0e0 AS tf_{t}" for t in ("file", "index", "er")) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS d FROM documents)")
def term_frequency(spark, folder):
    text = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", *[T.term_frequency(text, t).alias(f"tf_{t}") for t in ("file", "index", "er")])


@query(_with(_CC) + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (contains(lower(coalesce(search_text, '')), '{t}')) AS df, count(*) AS n FROM cc" for t in TERMS))
def document_frequency(spark, folder):
    return search.document_frequency(_chunks(spark, folder, "search_text"), TERMS)


# Search


def bm25_sql(corpus: str, terms: list[str], ident: str, k: int, bonuses: bool = False) -> str:
    """SQL of a BM25 ranking over ``corpus``, a query with the id, search_text, and path and name for bonuses."""
    distinct = list(dict.fromkeys(terms))
    tfs = ", ".join(f"CAST(length(d) - length(replace(d, '{t}', '')) AS DOUBLE) / {len(t)} AS tf_{i}" for i, t in enumerate(distinct))
    dfs = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1e0 ELSE 0e0 END) AS df_{i}" for i in range(len(distinct)))
    score = " + ".join(
        f"{terms.count(t)} * CASE WHEN tf_{i} > 0 THEN ln((n - df_{i} + 0.5e0) / (df_{i} + 0.5e0) + 1e0) * tf_{i} * 2.2e0 / (tf_{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl / nullif(avgdl, 0))) ELSE 0e0 END"
        for i, t in enumerate(distinct)
    )
    bonus = "".join(f" * CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {x} ELSE 1e0 END" for t in terms for c, x in (("path", "1.3e0"), ("name", "1.5e0"))) if bonuses else ""
    return f"""(WITH b AS (SELECT *, lower(coalesce(search_text, '')) AS d FROM ({corpus})),
        t AS (SELECT *, CAST(length(d) AS DOUBLE) AS dl, {tfs} FROM b),
        s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {dfs} FROM t),
        r AS (SELECT t.*, ({score}) AS raw FROM t CROSS JOIN s)
        SELECT {ident}, round(raw{bonus}, 6) AS score{', path, name, file_id' if bonuses else ''} FROM r WHERE raw > 0 ORDER BY score DESC, {ident} LIMIT {k})"""


_CORPUS = "SELECT chunk_id, cc.file_id, cc.name, search_text, path FROM cc JOIN cf USING (file_id)"
_FOUND = "SELECT chunk_id, file_id, path, name, score FROM "


def _search(spark: SparkSession, folder: str, words: str, k: int = 10, language: str | None = None) -> DataFrame:
    return search.search(table(spark, folder, "chunks"), _files(spark, folder), words, k, language)


@query("SELECT doc_id, score FROM " + bm25_sql("SELECT doc_id, text AS search_text FROM documents", ["index", "filter", "warning"], "doc_id", 10))
def bm25_topk(spark, folder):
    corpus = table(spark, folder, "documents").select("doc_id", F.col("text").alias("search_text"))
    # Texts are read once: statistics and scores both need their counts only.
    terms = ["index", "filter", "warning"]
    counted = cut(search.term_counts(corpus, terms).drop("search_text"))
    return search.top(search.score_counts(counted, terms).select("doc_id", F.round("score", 6).alias("score")), 10, "doc_id")


@query(_with(_CF, _CC) + _FOUND + bm25_sql(_CORPUS, TERMS, "chunk_id", 10, True))
def bm25_with_bonuses(spark, folder):
    return _search(spark, folder, WORDS)


@query(_with(_CF, _CC) + _FOUND + bm25_sql(_CORPUS + " WHERE language = 'rs'", TERMS, "chunk_id", 10, True))
def bm25_language_filtered(spark, folder):
    return _search(spark, folder, WORDS, language="rs")


@query(_with(_CF, _CC) + _FOUND + bm25_sql(_CORPUS + " WHERE language = 'xx'", TERMS, "chunk_id", 10, True))
def bm25_unknown_language(spark, folder):
    return _search(spark, folder, WORDS, language="xx")


@query(_with(_CF, _CC) + _FOUND + bm25_sql(_CORPUS, ["token", "queue", "token"], "chunk_id", 10, True))
def bm25_duplicate_terms(spark, folder):
    return _search(spark, folder, "token queue token")


@query(_with(_CF, _CC, "top AS (SELECT c.chunk_id, path, c.name, b.score FROM " + bm25_sql(_CORPUS, TERMS, "chunk_id", 30) + " b JOIN (" + _CORPUS + ") c USING (chunk_id))") + "SELECT chunk_id, path, name, round(score" + "".join(f" * CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {x} ELSE 1e0 END" for t in TERMS for c, x in (("path", "1.3e0"), ("name", "1.5e0"))) + ", 4) AS score FROM top ORDER BY score DESC, chunk_id LIMIT 10")
def bm25_prefetch(spark, folder):
    """Bonuses for the thirty best without them only."""
    hits = search.search(table(spark, folder, "chunks"), _files(spark, folder), WORDS, 10, prefetch_factor=3)
    return hits.select("chunk_id", "path", "name", F.round("score", 4).alias("score"))


@query(_with(_CC) + "SELECT chunk_id, name, token_count FROM cc WHERE lower(search_text) LIKE '%token%' AND lower(search_text) LIKE '%pl_n%' ORDER BY token_count NULLS FIRST, chunk_id LIMIT 10")
def like_and_search(spark, folder):
    return search.like_all(table(spark, folder, "chunks"), "Token pl_n", keep=("name",)).select("chunk_id", "name", "token_count")


_VEC = "vc AS (SELECT chunk_id, min(embedding) AS embedding FROM vec_chunks WHERE chunk_id IS NOT NULL GROUP BY 1)"
_PROBE = [round(((i * 37) % 101) / 50.5 - 1, 3) for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{v}e0" for v in _PROBE) + "]"
_DISTANCE = f"round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - {_PROBE_SQL}[i]) * (CAST(embedding[i] AS DOUBLE) - {_PROBE_SQL}[i])))), 6)"
_NEAR = "(SELECT chunk_id, distance FROM (SELECT chunk_id, " + _DISTANCE + " AS distance FROM vc WHERE len(embedding) = 64) WHERE distance IS NOT NULL AND NOT isnan(distance) ORDER BY distance, chunk_id LIMIT {})"


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(embedding::DOUBLE[], q.e), 6) AS distance FROM embeddings CROSS JOIN q ORDER BY distance, vec_id LIMIT 20")
def knn_l2(spark, folder):
    vectors = table(spark, folder, "embeddings")
    probe = vectors.filter("vec_id = 0").select("embedding").first()[0]
    return search.nearest(vectors, probe, 20, "vec_id")


@query(_with(_VEC) + "SELECT chunk_id, distance FROM " + _NEAR.format(20))
def knn_chunks(spark, folder):
    return search.nearest(table(spark, folder, "vec_chunks"), _PROBE, 20, repeated=True)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS similarity FROM embeddings CROSS JOIN q ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    probe = vectors.filter("vec_id = 0").select("embedding").first()[0]
    return search.most_similar(vectors, probe, 20, "vec_id")


@query(
    _with(_CF, _CC, _VEC, "r AS (SELECT chunk_id, score FROM " + bm25_sql(_CORPUS, TERMS, "chunk_id", 20, True) + ")", "d AS (SELECT * FROM " + _NEAR.format(20) + ")")
    + """, m AS (SELECT coalesce(r.chunk_id, d.chunk_id) AS chunk_id, coalesce(score, 0) AS bm25, coalesce(score / (SELECT max(score) FROM r), 0) AS lex, coalesce(1 - distance / (SELECT greatest(max(distance), 1e0) FROM d), 0) AS sem
        FROM r FULL JOIN d ON r.chunk_id = d.chunk_id)
    SELECT chunk_id, round(0.5e0 * lex + 0.5e0 * sem, 6) AS score, round(bm25, 6) AS bm25_score, round(sem, 6) AS semantic_score FROM m WHERE chunk_id IN (SELECT chunk_id FROM cc) ORDER BY score DESC, chunk_id LIMIT 10"""
)
def hybrid_merge(spark, folder):
    return search.hybrid_merge(_search(spark, folder, WORDS, 20), search.nearest(table(spark, folder, "vec_chunks"), _PROBE, 20, repeated=True), ALPHA, 10, table(spark, folder, "chunks").select("chunk_id"))


@query(_with(_CF, _CC) + "SELECT chunk_id, score, score AS bm25_score, 0e0 AS semantic_score FROM " + bm25_sql(_CORPUS, TERMS, "chunk_id", 20, True) + " ORDER BY score DESC, chunk_id LIMIT 10")
def hybrid_no_vectors(spark, folder):
    ranked = _search(spark, folder, WORDS, 20)
    return search.top(ranked.select("chunk_id", "score", F.col("score").alias("bm25_score"), F.lit(0.0).alias("semantic_score")), 10)


@query(_with(_CC) + "SELECT chunk_id, substr(concat_ws(' ', nullif(name, ''), '[' || chunk_type || ']', content), 1, 2000) AS embedding_text FROM cc")
def embedding_text(spark, folder):
    return _chunks(spark, folder, T.embedding_text(F.col("name"), F.col("chunk_type"), F.col("content")).alias("embedding_text"))


@query(_with(_CC) + "SELECT chunk_id FROM cc WHERE chunk_id NOT IN (SELECT chunk_id FROM vec_chunks WHERE chunk_id IS NOT NULL)")
def unembedded_chunks_anti(spark, folder):
    return embedding.unembedded(_chunks(spark, folder, "file_id"), table(spark, folder, "vec_chunks")).select("chunk_id")


@query()
def embed_new_chunks(spark, folder):
    made = embedding.embed_new(table(spark, folder, "chunks"), table(spark, folder, "vec_chunks"), embedding.HashingEmbedder())
    return made.filter(F.size("embedding") > 0).select("chunk_id", F.size("embedding").alias("dimensions"), "model")


# Import graph

_IMPORTS = _with(
    _CF,
    _CC,
    "src AS (SELECT chunk_id, content, CASE WHEN lower(language) IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') THEN 'js' WHEN lower(language) IN ('py', 'rs', 'go', 'java') THEN lower(language) END AS family FROM cc JOIN cf USING (file_id) WHERE content IS NOT NULL)",
    "ex AS (SELECT chunk_id, family, CASE family "
    + " ".join("WHEN '{}' THEN {}".format(f, " || ".join("regexp_extract_all(content, '{}', 1)".format(p.replace("'", "''")) for p in patterns)) for f, patterns in graph.IMPORT_PATTERNS.items())
    + " END AS found FROM src)",
    "un AS (SELECT chunk_id, family, unnest(found) AS target_path, unnest(range(len(found))) AS pos FROM ex)",
    "im AS (SELECT chunk_id, target_path, min(pos) AS pos, min(family) AS family FROM un WHERE target_path <> '' GROUP BY 1, 2)",
    "typed AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS position, target_path, CASE WHEN family IN ('py', 'go', 'java') THEN 'import' WHEN family = 'rs' THEN CASE WHEN starts_with(target_path, 'crate::') THEN 'use' ELSE 'mod' END WHEN starts_with(target_path, './') OR starts_with(target_path, '../') THEN 'import' ELSE 'external' END AS dep_type FROM im)",
)


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    return graph.extract_chunk_imports(table(spark, folder, "chunks"), _files(spark, folder))


@query(_IMPORTS + "SELECT chunk_id, position, target_path, dep_type FROM typed")
def extract_code_deps(spark, folder):
    return _imports(spark, folder)


@query(_IMPORTS + "SELECT dep_type, count(*) AS n, count(DISTINCT target_path) AS n_targets FROM typed GROUP BY 1")
def dep_type_classify(spark, folder):
    return _imports(spark, folder).groupBy("dep_type").agg(F.count("*").alias("n"), F.countDistinct("target_path").alias("n_targets"))


_ENDINGS = "en AS (SELECT unnest([" + ", ".join(f"'{e}'" for e in IMPORT_ENDINGS) + f"]) AS ending, unnest(range({len(IMPORT_ENDINGS)})) AS rank)"


@query(
    _with(
        _CF,
        _DEPS,
        _ENDINGS,
        "nf AS (SELECT file_id, " + _NORMAL.format("replace(path, chr(92), '/')") + " AS path FROM cf)",
        "bs AS (SELECT source_file_id, target_path, CASE WHEN starts_with(target_path, './') OR starts_with(target_path, '../') THEN " + _NORMAL.format("CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END || '/' || target_path") + " END AS base FROM dp JOIN nf ON nf.file_id = source_file_id)",
        "ps AS (SELECT path, min(file_id) AS file_id FROM nf GROUP BY 1)",
        "hit AS (SELECT base, arg_min(file_id, rank) AS file_id FROM (SELECT DISTINCT base FROM bs WHERE base IS NOT NULL) CROSS JOIN en JOIN ps ON ps.path = base || ending GROUP BY 1)",
    )
    + "SELECT source_file_id, bs.target_path, hit.file_id AS target_file_id FROM bs LEFT JOIN hit USING (base)"
)
def resolve_imports(spark, folder):
    files = _files(spark, folder).withColumn("path", normal_path(F.col("path")))
    imports = _deps(spark, folder).select("source_file_id", "target_path").join(files.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("from_path")), "source_file_id")
    return graph.resolve_imports(imports, files).select("source_file_id", "target_path", "target_file_id")


@query(_with(_CF, _DEPS) + "SELECT source_file_id, target_path, target_file_id, cf.path AS resolved_path, dep_type FROM dp LEFT JOIN cf ON cf.file_id = target_file_id")
def direct_deps(spark, folder):
    return graph.direct_dependencies(_deps(spark, folder), _files(spark, folder))


@query(_with(_CF, _DEPS) + "SELECT target_file_id, source_file_id, cf.path AS source_path, target_path, dep_type FROM dp JOIN cf ON cf.file_id = source_file_id WHERE target_file_id IS NOT NULL")
def reverse_deps(spark, folder):
    return graph.reverse_dependencies(_deps(spark, folder), _files(spark, folder))


_WALK = _with(
    _CF,
    _CC,
    _LOG,
    _DEPS,
    _ACTIVE,
    "rc AS (SELECT file_id, CAST(0 AS BIGINT) AS depth FROM act UNION ALL SELECT target_file_id, depth + 1 FROM rc JOIN (SELECT DISTINCT source_file_id, target_file_id FROM dependencies WHERE target_file_id IS NOT NULL) ON source_file_id = rc.file_id WHERE depth < 1)",
    "nd AS (SELECT file_id, min(depth) AS depth FROM rc GROUP BY 1)",
    "wk AS (SELECT source_file_id, target_path, target_file_id, depth + 1 AS depth FROM dp JOIN nd ON nd.file_id = source_file_id)",
    recursive=True,
)


def _walk(spark: SparkSession, folder: str) -> DataFrame:
    return graph.transitive_dependencies(_deps(spark, folder), _active(spark, folder), 2)


@query(_WALK + "SELECT * FROM wk")
def transitive_deps(spark, folder):
    return _walk(spark, folder)


@query(_WALK + "SELECT chunk_id, file_id, name FROM cc WHERE file_id IN (SELECT target_file_id FROM wk)")
def dep_chunks(spark, folder):
    return graph.dependency_chunks(_walk(spark, folder), _chunks(spark, folder, "file_id", "name")).select("chunk_id", "file_id", "name")


# Accesses and history


@query(_with(_CF, _LOG) + "SELECT file_id, path, max(accessed_at) AS last_access FROM al GROUP BY 1, 2 ORDER BY last_access DESC NULLS LAST, file_id LIMIT 10")
def recent_files(spark, folder):
    return store.recent_files(_accesses(spark, folder))


@query(_with(_CF, _LOG) + "SELECT file_id, path, count(*) AS access_count FROM al GROUP BY 1, 2 ORDER BY access_count DESC, file_id LIMIT 5")
def most_accessed(spark, folder):
    return store.most_accessed(_accesses(spark, folder))


@query(_with(_CF, _LOG) + "SELECT access_id, file_id, accessed_at FROM al WHERE accessed_at >= (SELECT max(accessed_at) FROM al) - INTERVAL 30 DAY")
def access_retention(spark, folder):
    log = _accesses(spark, folder)
    now = log.agg(F.max("accessed_at").alias("now"))
    return store.retained(log.crossJoin(F.broadcast(now)), F.col("now")).select("access_id", "file_id", "accessed_at")


@query("SELECT seq, arg_max(query, seq) AS query FROM (SELECT max(access_id) OVER (PARTITION BY lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g'))) AS seq, access_id, query FROM (SELECT access_id, min(query) AS query FROM access_log WHERE access_id IS NOT NULL GROUP BY 1) WHERE regexp_replace(query, '^\\s+|\\s+$', '', 'g') <> '') WHERE seq = access_id GROUP BY seq ORDER BY seq DESC LIMIT 10")
def recent_unique_queries(spark, folder):
    log = table(spark, folder, "access_log").filter("access_id is not null").groupBy("access_id").agg(F.min("query").alias("query"))
    return store.recent_unique_queries(log, seq="access_id")


@query("SELECT access_id, min(query) AS query FROM access_log WHERE access_id IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 100")
def history_cap(spark, folder):
    log = table(spark, folder, "access_log").filter("access_id is not null").groupBy("access_id").agg(F.min("query").alias("query"))
    return store.capped_history(log, seq="access_id")


@query("SELECT date_trunc('hour', accessed_at) AS window_start, file_id, count(*) AS n FROM (SELECT access_id, min(file_id) AS file_id, min(accessed_at) AS accessed_at FROM access_log WHERE access_id IS NOT NULL AND accessed_at IS NOT NULL GROUP BY 1) GROUP BY 1, 2")
def access_windows(spark, folder):
    log = table(spark, folder, "access_log")
    once = log.filter("access_id is not null and accessed_at is not null").groupBy("access_id").agg(F.min("file_id").alias("file_id"), F.min("accessed_at").alias("accessed_at"))
    return windowed_access(once)


# Changes and snapshots

_THEN = f"TIMESTAMP '{SNAPSHOT_TIME}'"


@query(
    _with(
        "old AS (SELECT path, arg_min(hash, coalesce(indexed_at, TIMESTAMP '0001-01-01')) AS hash, min(file_id) AS file_id FROM files WHERE coalesce(indexed_at, TIMESTAMP '0001-01-01') < " + _THEN + " GROUP BY path)",
        "gone AS (SELECT path, NULL AS hash, min(file_id) AS file_id FROM removed_files WHERE path NOT IN (SELECT path FROM old WHERE path IS NOT NULL) GROUP BY path)",
        "st AS (SELECT * FROM old UNION ALL SELECT * FROM gone)",
        "nw AS (SELECT path, arg_max(hash, coalesce(indexed_at, TIMESTAMP '0001-01-01')) AS hash FROM files GROUP BY path)",
    )
    + "SELECT coalesce(nw.path, st.path) AS path, st.file_id, CASE WHEN nw.path IS NULL THEN 'removed' WHEN st.file_id IS NULL THEN 'inserted' WHEN nw.hash IS NOT DISTINCT FROM st.hash THEN 'skipped' ELSE 'updated' END AS action FROM nw FULL JOIN st ON nw.path = st.path"
)
def incremental_diff(spark, folder):
    files = table(spark, folder, "files").withColumn("at", F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    old = files.filter(F.col("at") < F.lit(SNAPSHOT_TIME).cast("timestamp_ntz")).groupBy("path").agg(F.min_by("hash", "at").alias("hash"), F.min("file_id").alias("file_id"))
    gone = table(spark, folder, "removed_files").groupBy("path").agg(F.lit(None).cast("string").alias("hash"), F.min("file_id").alias("file_id")).join(old, "path", "left_anti")
    return store.incremental_diff(files.groupBy("path").agg(F.max_by("hash", "at").alias("hash")), old.unionByName(gone))


@query("SELECT DISTINCT file_id, path FROM removed_files WHERE path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)")
def stale_cleanup(spark, folder):
    return store.stale(table(spark, folder, "removed_files").select("file_id", "path"), table(spark, folder, "files")).select("file_id", "path").distinct()


_GONE = "SELECT file_id FROM removed_files WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM files WHERE file_id IS NOT NULL)"


def _gone(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "removed_files").join(table(spark, folder, "files").select("file_id"), "file_id", "left_anti")


@query(f"SELECT access_id, file_id, query, accessed_at FROM access_log WHERE file_id IS NULL OR file_id NOT IN ({_GONE})")
def cascade_delete(spark, folder):
    return store.delete_cascade(table(spark, folder, "access_log"), _gone(spark, folder))


@query(f"SELECT source_file_id, target_path, CASE WHEN target_file_id IN ({_GONE}) THEN NULL ELSE target_file_id END AS target_file_id, dep_type FROM dependencies WHERE source_file_id IS NULL OR source_file_id NOT IN ({_GONE})")
def cascade_set_null(spark, folder):
    return store.set_null_cascade(table(spark, folder, "dependencies"), _gone(spark, folder))


_CATALOGUE = "cat AS (SELECT strftime(indexed_at, '%Y-%m') AS id, 'monthly' AS label, 'auto' AS trigger, date_trunc('month', min(indexed_at)) AS created_at, count(*) AS file_count, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunk_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM cf WHERE indexed_at IS NOT NULL GROUP BY 1)"


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).filter("indexed_at is not null").withColumn("id", F.date_format("indexed_at", "yyyy-MM"))
    totals = [F.count("*").alias("file_count"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("chunk_count", "chunk_count"), ("size_bytes", "size_bytes"))]]
    made = files.groupBy("id").agg(F.to_timestamp_ntz(F.concat("id", F.lit("-01 00:00:00"))).alias("created_at"), *totals)
    return made.withColumn("label", F.lit("monthly")).withColumn("trigger", F.lit("auto"))


@query(_with(_CF, _CATALOGUE) + "SELECT id, label, trigger, created_at, file_count, chunk_count, round(size_bytes / 1048576e0, 2) AS size_mb FROM cat")
def snapshot_list(spark, folder):
    return snapshots.snapshot_list(_catalogue(spark, folder))


@query(_with(_CF, _CATALOGUE, "ag AS (SELECT *, created_at < TIMESTAMP '2024-03-01' AS old FROM cat)", "rk AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY created_at DESC, id DESC) AS rn FROM ag)") + "SELECT id, created_at, file_count FROM rk WHERE old OR rn > 10")
def snapshot_gc(spark, folder):
    now = datetime.datetime(2024, 3, 31)
    return snapshots.expired(_catalogue(spark, folder), now, 30, 10).select("id", "created_at", "file_count")


@query(
    f"SELECT chunk_id, name, token_count, 'then' AS backup_id FROM (SELECT chunk_id, min(name) AS name, min(token_count) AS token_count, min(search_text) AS search_text FROM chunks WHERE chunk_id IS NOT NULL AND created_at < {_THEN} GROUP BY 1) WHERE lower(search_text) LIKE '%record%' AND lower(search_text) LIKE '%map%' ORDER BY token_count NULLS FIRST, chunk_id LIMIT 10"
)
def snapshot_search(spark, folder):
    then = table(spark, folder, "chunks").filter(F.col("created_at") < F.lit(SNAPSHOT_TIME).cast("timestamp_ntz"))
    found = snapshots.search_snapshot(then, "then", " record map ", keep=("name",))
    return found.select("chunk_id", "name", "token_count", "backup_id")


# Assembly


@query(
    _with(
        _CF,
        "p AS (SELECT string_split(path, '/') AS parts FROM cf WHERE path IS NOT NULL)",
        "s AS (SELECT parts FROM p WHERE len(parts) - 1 <= 3 AND len(list_filter(parts, lambda x: starts_with(x, '_'))) = 0)",
        "e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM s)",
    )
    + "SELECT array_to_string(parts[1:n], '/') AS entry, parts[n] AS name, n AS depth, bool_or(n < len(parts)) AS is_dir FROM e GROUP BY 1, 2, 3"
)
def tree_entries(spark, folder):
    return assembly.tree_entries(_files(spark, folder).filter("path is not null"))


_SIZED = "greatest(coalesce(token_count, 0), 0)"


@query(_with(_CC, f"w AS (SELECT chunk_id, file_id, sum({_SIZED}) OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM cc WHERE file_id IS NOT NULL)") + "SELECT chunk_id, file_id, CAST(used AS BIGINT) AS used FROM w WHERE used <= 8400")
def active_file_prefix(spark, folder):
    chunks = _chunks(spark, folder, "file_id", "start_line", "token_count")
    limit = int(assembly.layer_budgets()["short_term"] * assembly.ACTIVE_SHARE)
    return assembly.prefix_fill_files(chunks, limit).select("chunk_id", "file_id", "used")


_FIRST = "fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, chunk_id) AS rn FROM cc) WHERE rn = 1)"
_RECENT = "rf AS (SELECT file_id, max(accessed_at) AS last_access FROM al GROUP BY 1 ORDER BY last_access DESC NULLS LAST, file_id LIMIT 5)"
_L2 = (_CF, _CC, _LOG, _FIRST, _RECENT, f"l2 AS (SELECT chunk_id, file_id, {_SIZED} AS tokens, sum({_SIZED}) OVER (ORDER BY last_access DESC, file_id ROWS UNBOUNDED PRECEDING) AS used FROM fc JOIN rf USING (file_id))")


def _recent_layer(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder, "file_id", "start_line", "token_count")
    recent = store.recent_files(_accesses(spark, folder), 5)
    own = chunks.join(F.broadcast(recent.select("file_id")), "file_id", "left_semi")
    first = assembly.first_chunks(own).join(F.broadcast(recent.select("file_id", "last_access")), "file_id")
    items = first.withColumn("age", -F.unix_timestamp(F.col("last_access").cast("timestamp"))).withColumn("tokens", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)))
    return assembly.prefix_fill(items, 600, ["age", "file_id"])


@query(_with(*_L2) + "SELECT chunk_id, file_id, CAST(tokens AS BIGINT) AS tokens, CAST(used AS BIGINT) AS used FROM l2 WHERE used <= 600")
def layer2_recent_break(spark, folder):
    return _recent_layer(spark, folder).select("chunk_id", "file_id", "tokens", "used")


def _greedy_sql(items: str, budget: int) -> str:
    return f"gr AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS kept UNION ALL SELECT i.rank, CASE WHEN g.used + i.tokens <= {budget} THEN g.used + i.tokens ELSE g.used END, g.used + i.tokens <= {budget} FROM gr g JOIN {items} i ON i.rank = g.rank + 1)"


_PLACED = "pc AS (SELECT chunk_id, path, start_line, CAST(greatest(coalesce(token_count, 0), 0) AS BIGINT) AS tokens, cc.file_id FROM cc JOIN cf USING (file_id))"
_L3 = (
    "hits AS (SELECT chunk_id, pc.path, start_line, tokens, h.score FROM " + bm25_sql(_CORPUS, TERMS, "chunk_id", 20, True) + " h JOIN pc USING (chunk_id))",
    "dc AS (SELECT path, start_line, arg_min(chunk_id, chunk_id) AS chunk_id, arg_min(tokens, chunk_id) AS tokens FROM pc WHERE file_id IN (SELECT target_file_id FROM wk) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = pc.path AND h.start_line = pc.start_line) GROUP BY 1, 2)",
    "mix AS (SELECT chunk_id, path, start_line, tokens, score, 0 AS part FROM hits UNION ALL SELECT chunk_id, path, start_line, tokens, (SELECT coalesce(min(score) * 0.8e0, 1e0) FROM hits), 1 FROM dc)",
    "l3 AS (SELECT chunk_id, path, tokens, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, part, chunk_id) AS rank FROM mix)",
)


def _related(spark: SparkSession, folder: str, budget: int) -> DataFrame:
    placed = _chunks(spark, folder, "file_id", "start_line", "token_count").join(_files(spark, folder).select("file_id", "path"), "file_id")
    placed = placed.withColumn("tokens", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).cast("bigint"))
    hits = _search(spark, folder, WORDS, 20).select("chunk_id", "score").join(placed, "chunk_id").select("chunk_id", "path", "start_line", "tokens", "score")
    extra = graph.dependency_chunks(_walk(spark, folder), placed).select("chunk_id", "path", "start_line", "tokens")
    return assembly.greedy_fill(assembly.related_items(hits, extra), budget)


@query(_WALK.rstrip() + ", " + ", ".join((_PLACED, *_L3, _greedy_sql("l3", 4000))) + " SELECT l3.rank, chunk_id, path, tokens, score FROM l3 JOIN gr ON gr.rank = l3.rank WHERE gr.kept")
def layer3_greedy(spark, folder):
    return _related(spark, folder, 4000).select("rank", "chunk_id", "path", "tokens", F.round("score", 6).alias("score"))


_L4 = (
    "ma AS (SELECT file_id, count(*) AS access_count FROM al GROUP BY 1 ORDER BY access_count DESC, file_id LIMIT 5)",
    f"ch AS (SELECT * FROM (SELECT chunk_id, file_id, CAST({_SIZED} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY file_id ORDER BY token_count NULLS FIRST, start_line NULLS FIRST, chunk_id) AS rn FROM cc) WHERE rn = 1)",
    "l4 AS (SELECT chunk_id, file_id, tokens, access_count, row_number() OVER (ORDER BY access_count DESC, file_id) AS rank FROM ch JOIN ma USING (file_id))",
)


def _spare(spark: SparkSession, folder: str, budget: int) -> DataFrame:
    top = store.most_accessed(_accesses(spark, folder)).select("file_id", "access_count")
    chunks = _chunks(spark, folder, "file_id", "start_line", "token_count").join(F.broadcast(top.select("file_id")), "file_id", "left_semi")
    cheap = assembly.cheapest_chunks(chunks).join(F.broadcast(top), "file_id").withColumn("tokens", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).cast("bigint"))
    ranked = cheap.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("access_count").desc(), "file_id")))
    return assembly.greedy_fill(cut(ranked), budget)


@query(_with(_CF, _CC, _LOG, *_L4, _greedy_sql("l4", 60), recursive=True) + "SELECT CAST(l4.rank AS INTEGER) AS rank, chunk_id, file_id, tokens, access_count FROM l4 JOIN gr ON gr.rank = l4.rank WHERE gr.kept")
def layer4_cheapest(spark, folder):
    return _spare(spark, folder, 60).select("rank", "chunk_id", "file_id", "tokens", "access_count")


def _layers(spark: SparkSession, folder: str) -> DataFrame:
    parts = {"associative": _related(spark, folder, 4000), "spare": _spare(spark, folder, 60), "short_term": _recent_layer(spark, folder)}
    frames = [df.select(F.lit(name).alias("layer"), "chunk_id", F.col("tokens").cast("bigint").alias("tokens")) for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_ALL_LAYERS = (
    _WALK.rstrip()
    + ", "
    + ", ".join((_PLACED, *_L3, _FIRST, _RECENT, _L2[-1], *_L4, _greedy_sql("l3", 4000), _greedy_sql("l4", 60).replace("gr AS", "g4 AS").replace("FROM gr g", "FROM g4 g")))
    + ", ly AS (SELECT 'associative' AS layer, chunk_id, tokens FROM l3 JOIN gr ON gr.rank = l3.rank WHERE gr.kept UNION ALL SELECT 'spare', chunk_id, tokens FROM l4 JOIN g4 ON g4.rank = l4.rank WHERE g4.kept UNION ALL SELECT 'short_term', chunk_id, tokens FROM l2 WHERE used <= 600) "
)


@query(_ALL_LAYERS + "SELECT layer, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) AS item_count FROM ly GROUP BY 1")
def layer_budget_summary(spark, folder):
    return assembly.layer_summary(_layers(spark, folder))


@query(_ALL_LAYERS + "SELECT string_agg(part, chr(10) || '---' || chr(10) ORDER BY place) AS context FROM (SELECT layer, CASE layer WHEN 'associative' THEN 2 WHEN 'spare' THEN 3 ELSE 4 END AS place, layer || ': ' || string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_id) AS part FROM ly GROUP BY 1)")
def arrange_sections(spark, folder):
    parts = _layers(spark, folder).groupBy("layer").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    order = F.create_map(*[x for i, name in enumerate(assembly.SECTIONS) for x in (F.lit(name), F.lit(i))])
    lines = parts.select(order[F.col("layer")].alias("at"), F.concat("layer", F.lit(": "), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("part"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n---\n").alias("context"))


# The chunker


def _chunker_sql() -> str:
    """SQL of the chunker over all contents: lines with running counts, the blocks that open on them, the walk from block to
    block, the members of large containers, and what is left between."""
    quoted = lambda p: p.replace("'", "''")
    families = " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in chunking.FAMILY.items())
    opened = " UNION ALL ".join(
        f"SELECT chunk_id, pos, {i} AS ord, '{kind}' AS kind, regexp_extract(line, '^(?:{quoted(p)})', 1) AS name FROM cm WHERE family = '{f}' AND regexp_matches(line, '^(?:{quoted(p)})')"
        for f, rules in chunking.BLOCKS.items()
        for i, (kind, p) in enumerate(rules)
    )
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    walk = "{w} AS (SELECT chunk_id, pos, stop, kind, name{more} FROM {t} WHERE heads UNION ALL SELECT n.chunk_id, n.pos, n.stop, n.kind, n.name{nmore} FROM {w} JOIN {t} p ON p.chunk_id = {w}.chunk_id AND p.pos = {w}.pos{on} JOIN {t} n ON n.chunk_id = p.chunk_id AND n.pos = p.nxt{non})"
    rest = f"length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM"
    kept = f"n > {chunking.REST_CHARS} AND ceil(n / 3.5) > {chunking.REST_TOKENS}"
    return _with(
        _CF,
        f"src AS (SELECT DISTINCT chunk_id, content, CASE lower(language) {families} END AS family FROM chunks JOIN cf USING (file_id) WHERE chunk_id IS NOT NULL AND length(content) > 0)",
        "ln AS (SELECT chunk_id, family, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS pos FROM src WHERE family IS NOT NULL)",
        "ct AS (SELECT *, length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', '')) AS d, CAST(contains(line, '{') AS INT) AS h, length(line) - length(regexp_replace(line, '^\\s+', '')) AS ind, regexp_matches(line, '\\S') AS filled FROM ln)",
        "cm AS (SELECT *, sum(d) OVER w AS c, sum(h) OVER w AS o, sum(length(line) + 1) OVER w AS z, max(pos) OVER (PARTITION BY chunk_id) AS last FROM ct WINDOW w AS (PARTITION BY chunk_id ORDER BY pos))",
        f"op AS ({opened})",
        "st AS (SELECT DISTINCT cm.* FROM cm JOIN op USING (chunk_id, pos))",
        """en AS (SELECT s.chunk_id, s.pos, coalesce(min(CASE WHEN s.family = 'py' THEN e.pos - 1 ELSE e.pos END), s.last) AS stop
            FROM st s LEFT JOIN cm e ON e.chunk_id = s.chunk_id AND CASE WHEN s.family = 'py' THEN e.pos > s.pos AND e.filled AND e.ind <= s.ind ELSE e.pos >= s.pos AND e.o - s.o + s.h > 0 AND e.c - s.c + s.d <= 0 END
            GROUP BY s.chunk_id, s.pos, s.last)""",
        f"bl AS (SELECT chunk_id, pos, stop, arg_min(kind, ord) AS kind, arg_min(name, ord) AS name FROM op JOIN en USING (chunk_id, pos) WHERE stop - pos + 1 >= {chunking.BLOCK_LINES} GROUP BY 1, 2, 3)",
        "bn AS (SELECT b.chunk_id, b.pos, b.stop, b.kind, b.name, min(x.pos) AS nxt, b.pos = min(b.pos) OVER (PARTITION BY b.chunk_id) AS heads FROM bl b LEFT JOIN bl x ON x.chunk_id = b.chunk_id AND x.pos > b.stop GROUP BY 1, 2, 3, 4, 5)",
        walk.format(w="tw", t="bn", more="", nmore="", on="", non=""),
        "tb AS (SELECT tw.*, e.z - s.z + length(s.line) AS n FROM tw JOIN cm s USING (chunk_id, pos) JOIN cm e ON e.chunk_id = tw.chunk_id AND e.pos = tw.stop)",
        f"big AS (SELECT * FROM tb WHERE kind IN ({listed(chunking.CONTAINERS)}) AND ceil(n / 3.5) > {chunking.CONTAINER_TOKENS})",
        f"""mb AS (SELECT g.chunk_id, g.pos AS own, o.pos, least(g.stop, en.stop) AS stop, arg_min(o.kind, ord) AS kind, arg_min(o.name, ord) AS name FROM big g JOIN op o ON o.chunk_id = g.chunk_id AND o.pos > g.pos AND o.pos <= g.stop AND o.kind IN ({listed(chunking.MEMBERS)})
            JOIN en ON en.chunk_id = o.chunk_id AND en.pos = o.pos WHERE least(g.stop, en.stop) - o.pos + 1 >= {chunking.BLOCK_LINES} GROUP BY 1, 2, 3, 4)""",
        "mn AS (SELECT b.chunk_id, b.own, b.pos, b.stop, b.kind, b.name, min(x.pos) AS nxt, b.pos = min(b.pos) OVER (PARTITION BY b.chunk_id, b.own) AS heads FROM mb b LEFT JOIN mb x ON x.chunk_id = b.chunk_id AND x.own = b.own AND x.pos > b.stop GROUP BY 1, 2, 3, 4, 5, 6)",
        walk.format(w="mw", t="mn", more=", own", nmore=", n.own", on=" AND p.own = mw.own", non=" AND n.own = p.own"),
        "ms AS (SELECT mw.*, e.z - s.z + length(s.line) AS n FROM mw JOIN cm s USING (chunk_id, pos) JOIN cm e ON e.chunk_id = mw.chunk_id AND e.pos = mw.stop)",
        "sp AS (SELECT * FROM big WHERE EXISTS (SELECT 1 FROM ms WHERE ms.chunk_id = big.chunk_id AND ms.own = big.pos))",
        f"cr AS (SELECT *, {rest} (SELECT sp.chunk_id, sp.kind, sp.name, sp.pos, sp.stop, string_agg(line, chr(10) ORDER BY cm.pos) AS text FROM sp JOIN cm ON cm.chunk_id = sp.chunk_id AND cm.pos BETWEEN sp.pos AND sp.stop WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.chunk_id = cm.chunk_id AND cm.pos BETWEEN ms.pos AND ms.stop) GROUP BY 1, 2, 3, 4, 5))",
        "fl AS (SELECT chunk_id, pos, line, pos - row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS grp FROM cm WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.chunk_id = cm.chunk_id AND cm.pos BETWEEN tw.pos AND tw.stop))",
        f"fr AS (SELECT *, {rest} (SELECT chunk_id, min(pos) AS pos, max(pos) AS stop, string_agg(line, chr(10) ORDER BY pos) AS text FROM fl GROUP BY chunk_id, grp))",
        f"""al AS (SELECT chunk_id, kind, name, pos, stop, n FROM tb WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.chunk_id = tb.chunk_id AND sp.pos = tb.pos)
            UNION ALL SELECT chunk_id, kind, name, pos, stop, n FROM ms UNION ALL SELECT chunk_id, kind, name, pos, stop, n FROM cr WHERE {kept} UNION ALL SELECT chunk_id, 'module', NULL, pos, stop, n FROM fr WHERE {kept})""",
        "wh AS (SELECT * FROM al UNION ALL SELECT chunk_id, 'module', NULL, 0, length(content) - length(replace(content, chr(10), '')), length(content) FROM src WHERE chunk_id NOT IN (SELECT chunk_id FROM al))",
        recursive=True,
    ) + "SELECT DISTINCT chunk_id, kind AS chunk_type, name, CAST(pos + 1 AS INT) AS start_line, CAST(stop + 1 AS INT) AS end_line, CAST(ceil(n / 3.5) AS BIGINT) AS token_count FROM wh"


@query(_chunker_sql())
def chunk_code(spark, folder):
    """Every stored content cut into chunks again, by its file's language; only contents travel to their file, once."""
    chunks = table(spark, folder, "chunks").filter("chunk_id is not null").select("chunk_id", "file_id", "content").join(_files(spark, folder).select("file_id", "language"), "file_id")
    made = chunking.chunk_files(chunks, "chunk_id")
    return made.select(F.col("file_id").alias("chunk_id"), "chunk_type", "name", "start_line", "end_line", "token_count").distinct()


def queries() -> dict[str, Query]:
    """The queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of those that have it."""
    return dict(_SQL)
