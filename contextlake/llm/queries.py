"""The queries of the training-data problems 1, 3, 5, 6, 7, 8 and 9, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.llm import authored, languages, near_duplicates, neighbours, packing, splitting, tokens
from contextlake.sources.tables import table

#: The shingles and the similarity that TESTDATA.md states for problem 6.
P6_WORDS, P6_SIMILARITY = 3, 0.6


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk as pieces within the limit."""
    return splitting.chunk_pieces(table(spark, folder, "chunks"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be split."""
    return splitting.split_ids(splitting.split_oversized(table(spark, folder, "chunks")))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest chunks of the chunks whose id is divisible by 50, searched among all."""
    near = neighbours.nearest_neighbours(table(spark, folder, "vec_chunks"))
    return near.filter(F.col("chunk_id") % 50 == 0).withColumn("distance", F.round("distance", 6))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the ten nearest of the other."""
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(table(spark, folder, "vec_chunks")))


def p5_origins(spark: SparkSession, folder: str) -> DataFrame:
    """The origin of every file."""
    return authored.file_origins(table(spark, folder, "files"), table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody in the project wrote."""
    return authored.foreign_files(p5_origins(spark, folder))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class and group of every chunk with at least five words, at a similarity of 0.8."""
    return near_duplicates.near_duplicate_groups(table(spark, folder, "chunks")).withColumnRenamed("id", "chunk_id")


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """Class, copies and number of links of every chunk with at least five words, at a similarity of 0.8."""
    return near_duplicates.near_duplicate_links(table(spark, folder, "chunks")).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of near-duplicate chunks."""
    pairs = near_duplicates.near_duplicate_pairs(table(spark, folder, "chunks"), words=P6_WORDS, threshold=P6_SIMILARITY)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece of one."""
    documents = table(spark, folder, "documents")
    # The table's own count comes from the footers of its files.
    return packing.pack(tokens.token_counts(documents), n_items=documents.count())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be split to fit a container."""
    return packing.split_items(p8_bins(spark, folder))


def p9_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch of every document in one language, with a confidence."""
    return languages.language_stretches(table(spark, folder, "documents"), table(spark, folder, "lang_codes"))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The languages that each document holds, with share and confidence."""
    return languages.held_languages(p9_stretches(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose languages aren't exactly the one that their label names."""
    return languages.wrong_labels(table(spark, folder, "documents"), table(spark, folder, "lang_codes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_neighbours, p5_found, p5_origins, p6_found, p6_groups, p6_links, p7_ids, p8_found, p8_bins, p9_found, p9_languages, p9_stretches)}


def _links_sql(words: int, similarity: float) -> str:
    """SQL that ends in l: pairs p < q of chunk_ids that are alike, and whether their sets are equal."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
        w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM chunks WHERE content IS NOT NULL),
        s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - {words - 2}), lambda i: {run})) AS g FROM w WHERE len(w) >= {words}),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
        d AS (SELECT g, count(*) AS df FROM s GROUP BY 1),
        o AS (SELECT s.chunk_id, g, n, row_number() OVER (PARTITION BY s.chunk_id ORDER BY df, g) AS pos FROM s JOIN d USING (g) JOIN n USING (chunk_id)),
        f AS (SELECT * FROM o WHERE pos <= n - ceil({similarity} * n) + 1),
        c AS (SELECT DISTINCT a.chunk_id AS p, b.chunk_id AS q FROM f a JOIN f b ON a.g = b.g AND a.chunk_id < b.chunk_id AND least(a.n, b.n) >= {similarity} * greatest(a.n, b.n)),
        m AS (SELECT p, q, count(*) AS m FROM c JOIN s x ON x.chunk_id = p JOIN s y ON y.chunk_id = q AND y.g = x.g GROUP BY 1, 2),
        l AS (SELECT p, q, m = a.n AND m = b.n AS same FROM m JOIN n a ON a.chunk_id = p JOIN n b ON b.chunk_id = q WHERE m >= {similarity} * (a.n + b.n - m))"""


#: Both ways, and the smallest chunk_id with an equal set of each.
_CLASSES_SQL = """
        y AS (SELECT p, q, same FROM l UNION ALL SELECT q, p, same FROM l),
        k AS (SELECT chunk_id, least(chunk_id, coalesce(min(q) FILTER (WHERE same), chunk_id)) AS class_id, count(*) FILTER (WHERE same) AS n_copies FROM n LEFT JOIN y ON p = chunk_id GROUP BY 1)"""
_NEAREST_SQL = """
        v AS (
            SELECT chunk_id, min(embedding)::DOUBLE[64] AS e FROM vec_chunks
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY chunk_id
        ), r AS (
            SELECT a.chunk_id AS p, b.chunk_id AS q, array_distance(a.e, b.e) AS far, row_number() OVER (PARTITION BY a.chunk_id ORDER BY array_distance(a.e, b.e), b.chunk_id) AS n
            FROM v a JOIN v b ON a.chunk_id <> b.chunk_id
        )"""


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express on whole tables."""
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM chunks WHERE ceil(length(content) / 3.5) > 500",
        "p3_found": f"WITH {_NEAREST_SQL} SELECT DISTINCT least(p, q) AS chunk_id_a, greatest(p, q) AS chunk_id_b FROM r WHERE n <= 10",
        "p3_neighbours": f"WITH {_NEAREST_SQL} SELECT p AS chunk_id, q AS neighbour_id, round(far, 6) AS distance FROM r WHERE n <= 10 AND p % 50 = 0",
        "p6_found": f"WITH {_links_sql(P6_WORDS, P6_SIMILARITY)} SELECT p AS chunk_id_a, q AS chunk_id_b FROM l",
        "p6_groups": f"""
            WITH RECURSIVE {_links_sql(5, 0.8)}, {_CLASSES_SQL},
            t AS (SELECT chunk_id AS id, chunk_id AS g FROM n UNION SELECT y.q, t.g FROM t JOIN y ON y.p = t.id)
            SELECT k.chunk_id, k.class_id, min(t.g) AS group_id FROM k JOIN t ON t.id = k.chunk_id GROUP BY 1, 2
        """,
        "p6_links": f"""
            WITH {_links_sql(5, 0.8)}, {_CLASSES_SQL}
            SELECT k.chunk_id, k.class_id, k.n_copies, count(DISTINCT o.class_id) AS n_links
            FROM k LEFT JOIN y ON y.p = k.chunk_id AND NOT y.same LEFT JOIN k o ON o.chunk_id = y.q GROUP BY 1, 2, 3
        """,
    }
