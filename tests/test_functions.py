"""Text, glob and vector functions."""

import math

import pytest
from pyspark.sql import functions as F

from contextlake.functions import globs, vectors
from contextlake.functions import text as T


def test_terms(spark):
    query = "Fix LOGIN-timeout é 한국 a b2!"
    assert T.query_terms(query) == ["fix", "login", "timeout", "한국", "b2"]
    assert spark.range(1).select(T.term_column(F.lit(query))).first()[0] == T.query_terms(query)
    assert T.query_terms(None) == [] and T.query_terms("  ") == []


def test_texts(spark):
    row = spark.range(1).select(
        T.term_frequency(F.lit("aaaa"), "aa"), T.estimate_tokens(F.lit("x" * 8)), T.estimate_tokens(F.lit(None).cast("string")), T.search_text(F.lit("function"), F.lit("add"), F.lit("function add(a, b) {\n  return a + b;\n}")), T.strip(F.lit("\t a b \n")), T.estimate_tokens(F.lit("a😀"))
    ).first()
    assert tuple(row) == (2.0, 3, 0, "function add function add return", "a b", 1)
    with pytest.raises(ValueError):
        T.estimate_tokens(F.lit("x"), 0)


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("node_modules/**", "node_modules/a.js", True), ("node_modules/**", "pkg/node_modules/a.js", False), ("*.min.js", "a/b/X.MIN.JS", True), ("package-lock.json", "sub/package-lock.json", False), ("docs/", "docs/a.md", True), ("docs/", "docs", False), ("docs/", "docs/", True), ("/dist", "dist", True), ("src/**/gen.ts", "src/gen.ts", True), ("src/**/gen.ts", "src/a/b/gen.ts", True), ("a?.js", "ab.js", True), ("a?.js", "a/.js", False)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.range(1).select(globs.ignored(F.lit(path), [pattern])).first()[0] is hit


def test_filter_and_file(spark, tmp_path):
    assert spark.range(1).select(globs.matches_filter(F.lit("src/abts.py"), "*.ts")).first()[0]
    (tmp_path / ".gitignore").write_text("# c\n\n  out/ \n!keep.js\n")
    assert globs.read_ignore_file(tmp_path / ".gitignore") == ["out/"] and globs.read_ignore_file(tmp_path / "none") == []


def test_vectors(spark):
    frame = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([],)], "e array<float>")
    probe = vectors.literal_vector([3.0, 4.0])
    got = frame.select(vectors.l2_distance(F.col("e"), probe), vectors.cosine_similarity(F.col("e"), probe)).collect()
    assert [tuple(r) for r in got] == [(math.sqrt(20), 0.6), (5.0, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]
