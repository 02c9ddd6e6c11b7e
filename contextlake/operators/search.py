"""Ranked retrieval: BM25 over search texts, filters by terms, nearest vectors, and the blend of both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import query_terms, term_frequency
from contextlake.functions.vectors import cosine_similarity, l2_distance, literal_vector
from contextlake.sources.model import current_chunks

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
PATH_BONUS, NAME_BONUS = 1.3, 1.5
TOP_K = 10


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def term_counts(corpus: DataFrame, terms: Sequence[str], text: str = "search_text") -> DataFrame:
    """``corpus`` with its text's length ``dl`` and each term's frequency ``tf_i``; null texts count as empty."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    return corpus.withColumns({"dl": F.length(body).cast("double")} | {f"tf_{i}": term_frequency(body, t) for i, t in enumerate(terms)})


def corpus_stats(counted: DataFrame, n_terms: int) -> DataFrame:
    """One row: number of texts, mean length, and each term's document frequency, in one pass."""
    return counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"tf_{i}") > 0, 1.0).otherwise(0.0)).alias(f"df_{i}") for i in range(n_terms)])


def bm25_scores(corpus: DataFrame, terms: Sequence[str], text: str = "search_text", k1: float = K1, b: float = B) -> DataFrame:
    """The rows of ``corpus`` that score above 0, with ``score``.

    The statistics are those of ``corpus`` as given, so a filter before this call narrows them too. They are one row,
    which is broadcast; a repeated term counts as often as it comes.
    """
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return corpus.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    return score_counts(term_counts(corpus, distinct, text), terms, k1, b).select(*corpus.columns, "score")


def score_counts(counted: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """The rows that score above 0, from their counts (``dl``, and ``tf_i`` of the i-th distinct term)."""
    distinct = list(dict.fromkeys(terms))
    stats = corpus_stats(counted, len(distinct))
    parts = []
    for i, term in enumerate(distinct):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1.0)
        norm = tf + k1 * (1.0 - b + b * F.col("dl") / F.nullif(F.col("avgdl"), F.lit(0.0)))
        parts.append(terms.count(term) * F.when(tf > 0, idf * tf * (k1 + 1.0) / norm).otherwise(0.0))
    scored = counted.crossJoin(F.broadcast(stats)).withColumn("score", _total(parts))
    return scored.filter("score > 0")


def with_bonuses(scored: DataFrame, terms: Sequence[str], path: str = "path", name: str = "name") -> DataFrame:
    """Scores raised for each term that the path or the name contains; repeated terms raise again."""
    factor = F.lit(1.0)
    for term in terms:
        for column, bonus in ((path, PATH_BONUS), (name, NAME_BONUS)):
            factor = factor * F.when(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(term), bonus).otherwise(1.0)
    return scored.withColumn("score", F.col("score") * factor)


def top(scored: DataFrame, k: int, tie: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows; ties go to the smaller id. None if k is 0 or less."""
    return scored.orderBy(F.col(score).desc(), tie).limit(max(0, k))


def search(chunks: DataFrame, files: DataFrame, query: str, top_k: int = TOP_K, language: str | None = None, prefetch_factor: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 with bonuses over chunks (chunk_id, file_id, name, search_text) of known files (file_id, path, language).

    A query without terms finds nothing; an unknown language has an empty corpus. Rows that repeat a chunk_id count
    once, by the least of each column. Texts are reduced to counts where they are read, so only these are shuffled, and
    the statistics and the scores read the same shuffle. Contents are for the caller to join to the result. With a
    ``prefetch_factor`` only so many times top_k of the best chunks without bonuses are ranked with them.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.join(files.select("file_id", "path"), "file_id").select("chunk_id", "file_id", "path", "name", F.lit(0.0).alias("score")).filter(F.lit(False))
    known = files.filter(F.col("language") == language) if language is not None else files
    distinct = list(dict.fromkeys(terms))
    counted = term_counts(chunks.select("chunk_id", "file_id", "name", "search_text"), distinct)
    once = counted.filter("chunk_id is not null").groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in ["file_id", "name", "dl", *(f"tf_{i}" for i in range(len(distinct)))]])
    corpus = once.join(known.select("file_id", "path", "language"), "file_id")
    scored = score_counts(corpus, terms, k1, b)
    scored = with_bonuses(scored if prefetch_factor is None else top(scored, top_k * prefetch_factor), terms)
    return top(scored.select("chunk_id", "file_id", "path", "name", F.round("score", 6).alias("score")), top_k)


def document_frequency(corpus: DataFrame, terms: Sequence[str], text: str = "search_text") -> DataFrame:
    """Rows (term, df, n): in how many texts each term stands, in one pass for all terms."""
    stats = corpus_stats(term_counts(corpus, terms, text), len(terms))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df_{i}").cast("bigint").alias("df"), F.col("n").cast("bigint").alias("n")) for i, t in enumerate(terms)])).alias("x")).select("x.*")


def like_all(chunks: DataFrame, query: str, limit: int = TOP_K, text: str = "search_text", keep: Sequence[str] | None = None) -> DataFrame:
    """The cheapest chunks (chunk_id, token_count, ``keep``, by default all columns but the text) whose text is LIKE every word of the query; ``%`` and ``_`` in
    words are wildcards. Rows that repeat a chunk_id count once; only rows that match are compared or shuffled, and
    without their text."""
    words = query.lower().split()
    found = chunks.filter(reduce(lambda a, b: a & b, [F.lower(F.col(text)).like(f"%{w}%") for w in words]) if words else F.lit(False))
    found = current_chunks(found, "token_count", *([c for c in chunks.columns if c not in ("chunk_id", "token_count", text)] if keep is None else keep))
    return found.orderBy(F.col("token_count").asc_nulls_first(), "chunk_id").limit(max(0, limit))


def nearest(vectors: DataFrame, query: Sequence[float], top_k: int = TOP_K, id_col: str = "chunk_id", vec_col: str = "embedding", repeated: bool = False) -> DataFrame:
    """The k vectors nearest to one query vector by exact Euclidean distance; those of another length don't count.

    Where ids are ``repeated``, rows without one are left out and each id counts once, by its least distance; vectors are
    reduced to distances before that.
    """
    distance = F.round(l2_distance(F.col(vec_col), literal_vector(query)), 6)
    found = vectors.select(id_col, distance.alias("distance")).filter("distance is not null and not isnan(distance)")
    if repeated:
        found = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("distance").alias("distance"))
    return found.orderBy("distance", id_col).limit(max(0, top_k))


def most_similar(vectors: DataFrame, query: Sequence[float], top_k: int = TOP_K, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors most similar to one query vector by cosine; those that have none are left out."""
    e = F.col(vec_col)
    similarity = F.round(cosine_similarity(e, literal_vector(query)), 6)
    usable = (F.size(e) == len(query)) & F.exists(e, lambda x: x != 0) & F.forall(e, lambda x: ~F.isnan(x))
    return vectors.filter(usable).select(id_col, similarity.alias("similarity")).orderBy(F.col("similarity").desc(), id_col).limit(max(0, top_k))


def hybrid_merge(ranked: DataFrame, near: DataFrame, alpha: float = 0.5, top_k: int = TOP_K, known: DataFrame | None = None) -> DataFrame:
    """Blend of ``ranked`` (chunk_id, score) and ``near`` (chunk_id, distance); a missing side counts 0.

    Scores are divided by the greatest, distances turned into 1 - d / max(greatest, 1). Both sides are short lists, so
    the two extremes are one-row aggregates. Chunks that ``known`` lacks are dropped.
    """
    best, far = ranked.agg(F.max("score").alias("best")), near.agg(F.greatest(F.max("distance"), F.lit(1.0)).alias("far"))
    both = ranked.select("chunk_id", "score").join(near.select("chunk_id", "distance"), "chunk_id", "full").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(far))
    if known is not None:
        both = both.join(known.select("chunk_id").distinct(), "chunk_id", "left_semi")
    lexical = F.coalesce(F.col("score") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(0.0))
    semantic = F.coalesce(1.0 - F.col("distance") / F.col("far"), F.lit(0.0))
    merged = both.select("chunk_id", F.round((1 - alpha) * lexical + alpha * semantic, 6).alias("score"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("bm25_score"), F.round(semantic, 6).alias("semantic_score"))
    return top(merged, top_k)
