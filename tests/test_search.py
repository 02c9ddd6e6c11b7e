"""Ranking, filters, nearest vectors and the blend."""

import pytest
from pyspark.sql import functions as F

from contextlake.operators import search


def _corpus(spark):
    chunks = spark.createDataFrame([(1, 1, "go", "function login user"), (2, 2, None, "module config"), (3, 9, "login", "login login")], "chunk_id long, file_id long, name string, search_text string")
    files = spark.createDataFrame([(1, "src/x.js", "js"), (2, "src/y.js", "js")], "file_id long, path string, language string")
    return chunks, files


def _scores(spark, name, path):
    chunks, files = _corpus(spark)
    chunks = chunks.withColumn("name", F.when(F.col("chunk_id") == 1, name).otherwise(F.col("name")))
    files = files.withColumn("path", F.when(F.col("file_id") == 1, path).otherwise(F.col("path")))
    return [r.score for r in search.search(chunks, files, "login").collect()]


@pytest.mark.parametrize(("name", "path", "score"), [("go", "src/x.js", 0.643767), ("login", "src/x.js", 0.965651), ("login", "src/auth/login.js", 1.255346)])
def test_bm25_goldens(spark, name, path, score):
    assert _scores(spark, name, path) == [pytest.approx(score, abs=1e-6)]


@pytest.mark.parametrize("query", ["", "   ", None, "é", "'; DROP TABLE chunks; --", "% OR 1=1", "\\", "x" * 10_000, "\" OR \"\"=\""])
def test_odd_queries(spark, query):
    assert search.search(*_corpus(spark), query).count() == 0


@pytest.mark.parametrize(("k", "n"), [(-1, 0), (0, 0), (1, 1), (99_999, 1)])
def test_top_k(spark, k, n):
    assert search.search(*_corpus(spark), "login", k).count() == n


def test_language_and_empty(spark):
    chunks, files = _corpus(spark)
    assert search.search(chunks, files, "login", language="xx").count() == 0
    assert search.search(chunks.limit(0), files, "login").count() == 0
    wide = chunks.withColumn("score", F.lit(7)).withColumn("path", F.lit("login"))
    assert search.search(wide, files, "login").count() == 1


def test_repeated_terms_and_nulls(spark):
    chunks = spark.createDataFrame([(1, None), (2, "aa bb"), (3, "cc")], "chunk_id long, search_text string")
    one, two = (search.bm25_scores(chunks, t).first().score for t in (["aa"], ["aa", "aa"]))
    assert two == pytest.approx(2 * one)
    assert search.bm25_scores(chunks, []).count() == 0


def test_like(spark):
    chunks = spark.createDataFrame([(1, 5, "axb two"), (2, None, "a_b two"), (3, 1, None), (4, 1, "a_b")], "chunk_id long, token_count long, search_text string")
    assert [r.chunk_id for r in search.like_all(chunks, "A_B two").collect()] == [2, 1]
    assert search.like_all(chunks, "  ").count() == 0


def test_hybrid(spark):
    ranked = spark.createDataFrame([(1, 4.0), (2, 2.0)], "chunk_id long, score double")
    near = spark.createDataFrame([(2, 0.5), (3, 1.5)], "chunk_id long, distance double")
    got = [(r.chunk_id, r.score) for r in search.hybrid_merge(ranked, near).collect()]
    assert got == [(2, pytest.approx(0.583333)), (1, 0.5), (3, 0.0)]
    assert search.hybrid_merge(ranked, near, known=ranked.filter("chunk_id = 1")).count() == 1
    assert search.hybrid_merge(ranked.limit(0), near.limit(0)).count() == 0


def test_nearest_leaves_out_other_lengths(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in search.nearest(vectors, [1.0, 0.0]).collect()] == [1, 5]
    assert [r.chunk_id for r in search.most_similar(vectors, [1.0, 0.0]).collect()] == [1, 5]
