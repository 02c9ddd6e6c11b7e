"""Near-duplicate texts with small edits, over collections too large for pairwise comparison.

Method: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

1. Each text becomes its set of word runs (*shingles*). Texts with equal sets share one *class*; from here on classes
   stand for their members.
2. A class is hashed once: its shingles fall into ``BINS`` bins, each bin keeps its least value, empty bins borrow from
   a full one. Runs of ``rows_of(threshold)`` bins form bands; classes that agree on a band share a *bucket*. Two sets
   at the threshold miss each other in every band with a probability of at most ``MISS``, more alike ones far less.
3. Each class of a bucket gets one candidate edge, to the bucket's centre (its smallest class), so edges grow with the
   classes and not with their pairs. Edges are checked exactly on the sets.
4. What the stars leave open is settled exactly. Of two classes that are linked to the same centre the pair is checked
   itself. Classes whose edge to a centre failed, and all that share its bucket, may be alike without the centre;
   these, and only these, go through an exact prefix-filter join, so no bucket's rest is left to chance.

The prefix-filter join puts the shingles in one order, those frequent in a sample of the classes last. Two sets that
are alike enough share k shingles (all, if the similarity needs fewer) among the first ones of each (*prefix*):
n - ceil(t n) + k of n shingles at similarity t, and of the smaller set even n - ceil(2t / (1 + t) n) + k. Every order
gives all pairs; the sample only decides how many candidates there are. Boilerplate is frequent and comes last, so it
lies behind the prefix of texts that share nothing else, however many have it.

Scale: texts are read once and reduced to integers in Arrow batches; the reduced table is written to the shared
checkpoint folder. Bands go through one shuffle, in which a bucket's rows meet its centre in a window. Buckets that
hold more than ``HOT_SHARE`` of the classes, of which there are ``BANDS / HOT_SHARE`` at most, are known from a sample;
their centres are combined map-side and broadcast, so their rows aren't shuffled at all. Sets are shuffled once, and
only those of classes with an edge go further; sizes rule out edges before sets are joined. Copies of a text within a
task carry no set, so a group of copies costs one row for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contextlake.operators.components import connected_components
from contextlake.session import cut, spread

BINS = 96
#: The probability, at most, that two sets at the threshold agree on no band.
MISS = 5e-4
#: The share of the sampled classes from which on a bucket is hot, and the least number of sampled classes that counts.
HOT_SHARE, HOT_LEAST = 0.001, 200

#: One of so many classes is sampled for frequent shingles; those met so often in the sample, at most so many, are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 2, 1_000_000
#: The shingles that candidates share in their prefixes.
AGREE = 3
#: What rounding may take from a product that should be a whole number.
_EPS = 1e-9

_WORD = re.compile(r"[a-z0-9_]+")
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD))
#: Words whose hashes a Python worker keeps.
_MEMO_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _ODD[3]
    x = (x ^ (x >> _U(29))) * _ODD[4]
    return x ^ (x >> _U(32))


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the columns' values in order."""
    total = np.zeros(len(columns[0]), _U)
    for column in columns:
        total = _mix((total ^ column) * _ODD[0] + _ODD[1])
    return total


def shingle_sets(texts: list[str | None], words: int, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 32-bit shingle) of every distinct shingle, sorted."""
    found: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            before = len(found)
            found += _WORD.findall(text.lower())
            lengths[i] = len(found) - before
    hashes = np.fromiter(map(memo.__getitem__, found), _U, len(found))
    owner = np.repeat(np.arange(len(texts), dtype=_U), lengths)
    runs = max(0, len(found) - words + 1)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    inside = owner[:runs] == owner[words - 1 :]
    shingles = _combine([hashes[k : k + runs][inside] for k in range(words)]) >> _U(32)
    both = np.unique((owner[:runs][inside] << _U(32)) | shingles)
    return (both >> _U(32)).astype(np.int64), both.astype(np.uint32)


def _bin(values: np.ndarray) -> np.ndarray:
    """The bin of each hash: its upper half as a fraction of ``BINS``."""
    return (((values >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)


def signatures(owner: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """The ``BINS`` least values of each of ``n`` texts; rows of texts without shingles are meaningless."""
    spread_out = _mix(shingles.astype(_U) * _ODD[0] + _ODD[2])
    empty = ~_U(0)
    least = np.full(n * BINS, empty)
    np.minimum.at(least, owner * BINS + _bin(spread_out), _mix(spread_out))
    least = least.reshape(n, BINS)
    full = least != empty
    result = least.copy()
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        donor = _bin(_mix(bins.astype(_U) * _ODD[1] + _U(attempt)))
        ok = full[rows, donor]
        result[rows[ok], bins[ok]] = least[rows[ok], donor[ok]]
        rows, bins = rows[~ok], bins[~ok]
    return result


def rows_of(threshold: float) -> int:
    """The bins of a band: as many as keep the chance of missing a pair at the threshold within ``MISS``."""
    fits = [r for r in range(1, BINS + 1) if (1 - threshold**r) ** (BINS // r) <= MISS]
    return max(fits, default=1)


def band_keys(owner: np.ndarray, shingles: np.ndarray, n: int, rows: int) -> np.ndarray:
    """The bucket of each of ``n`` non-empty sets in each band."""
    bins = signatures(owner, shingles, n)
    number = np.zeros(n, _U)
    return np.stack([_combine([number + _U(i), *(bins[:, i * rows + r] for r in range(rows))]) for i in range(BINS // rows)], axis=1).view(np.int64)


def _reduced(texts: list[str | None], words: int, memo: dict) -> tuple[np.ndarray, ...]:
    """For each text with shingles: its number, class key and set size; and all shingles."""
    owner, shingles = shingle_sets(texts, words, memo)
    sizes = np.bincount(owner, minlength=len(texts))
    some = np.nonzero(sizes)[0]
    if not len(some):
        return some, np.zeros(0, np.int64), sizes[some], shingles.view(np.int32)
    starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
    key = _mix(np.add.reduceat(_mix(shingles.astype(_U) * _ODD[3] + _ODD[4]), starts) + sizes[some].astype(_U))
    return some, key.view(np.int64), sizes[some], shingles.view(np.int32)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values, kind))


def reduce_texts(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, key, size, shingles) of the texts that have shingles.

    shingles is empty where the task has met the class before; the first row of a class in each task carries the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, met = _WordHashes(), set()
        for batch in batches:
            some, key, sizes, shingles = _reduced(batch.column(1).to_pylist(), words, memo)
            new = np.zeros(len(some), bool)
            for i, k in enumerate(key.tolist()):
                if k not in met:
                    met.add(k)
                    new[i] = True
            columns = [batch.column(0).take(pa.array(some)), pa.array(key, pa.int64()), pa.array(sizes, pa.int32()), _lists(shingles[np.repeat(new, sizes)], np.where(new, sizes, 0), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "shingles"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    return spread(source).mapInArrow(run, f"id {kind}, key bigint, size int, shingles array<int>")


def bucket_rows(reduced: DataFrame, threshold: float) -> DataFrame:
    """Rows (bucket, key): every class in its bucket of each band."""
    rows = rows_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            bands = band_keys(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), len(sizes), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bands.ravel(), np.full(len(sizes), bands.shape[1]), pa.int64())], names=["key", "buckets"])

    made = reduced.filter(F.size("shingles") > 0).select("key", "shingles").mapInArrow(run, "key bigint, buckets array<bigint>")
    return made.select(F.explode("buckets").alias("bucket"), "key")


def hot_buckets(reduced: DataFrame, threshold: float, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list[int]:
    """The buckets that hold more than ``share`` of the sampled classes; at most 1 / share of them in each band."""
    sample = reduced.filter(F.pmod("key", F.lit(SAMPLE)) == 0)
    bound = max(least, share * sample.agg(F.approx_count_distinct("key")).first()[0])
    counted = bucket_rows(sample, threshold).groupBy("bucket").agg(F.count("*").alias("n"))
    return [r.bucket for r in counted.filter(F.col("n") >= bound).select("bucket").collect()]


def stars(reduced: DataFrame, threshold: float, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Rows (bucket, centre, key) of all classes that share a bucket with its centre, the smallest class in it.

    The rows of a hot bucket meet their centre where they are; all others in one shuffle.
    """
    rows, spark = bucket_rows(reduced, threshold), reduced.sparkSession
    hot = hot_buckets(reduced, threshold, share, least)
    named = F.broadcast(spark.createDataFrame([(b,) for b in hot], "bucket bigint"))
    whole = Window.partitionBy("bucket")
    cold = (rows.join(named, "bucket", "left_anti") if hot else rows).withColumn("centre", F.min("key").over(whole)).filter("key <> centre")
    if not hot:
        return cold.select("bucket", "centre", "key")
    mine = rows.join(named, "bucket", "left_semi")
    centres = F.broadcast(mine.groupBy("bucket").agg(F.min("key").alias("centre")))
    return cold.select("bucket", "centre", "key").unionByName(mine.join(centres, "bucket").filter("key <> centre").select("bucket", "centre", "key"))


def prefixes(shingles: np.ndarray, sizes: np.ndarray, threshold: float, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set number, place from 1, shingle) of the prefixes of sets that lie one after another in ``shingles``.

    ``frequent`` is sorted; its shingles come after all others, in the order of ``rank``.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    late = np.where(frequent[at] == shingles, rank[at], 0) if len(frequent) else np.zeros(len(shingles), np.int64)
    order = np.lexsort((shingles, late, owner))
    place = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    kept = place <= np.repeat(sizes - np.ceil(threshold * sizes - _EPS).astype(np.int64) + AGREE, sizes)
    return owner[kept], place[kept], shingles[order][kept]


def prefix_rows(reduced: DataFrame, threshold: float) -> DataFrame:
    """Rows (shingle, key, size, place), each once, of the shingles in the prefixes of at least two classes."""
    sets = reduced.filter(F.size("shingles") > 0).select("key", "shingles")
    counted = sets.filter(F.pmod("key", F.lit(SAMPLE)) == 0).select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    counted = counted.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()
    frequent = counted.column("shingle").to_numpy()
    order = np.argsort(frequent)
    given = reduced.sparkSession.sparkContext.broadcast((frequent[order], len(frequent) - order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, place, shingle = prefixes(lists.flatten().to_numpy(zero_copy_only=False), sizes, threshold, *given.value)
            key = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [pa.array(shingle, pa.int32()), pa.array(key[owner], pa.int64()), pa.array(sizes[owner], pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "key", "size", "place"])

    rows = sets.mapInArrow(run, "shingle int, key bigint, size int, place int").repartition("shingle").dropDuplicates(["shingle", "key"])
    whole = Window.partitionBy("shingle")
    rows = rows.withColumn("least", F.min("key").over(whole)).withColumn("most", F.max("key").over(whole))
    return rows.filter("least <> most").select("shingle", "key", "size", "place")


def prefix_pairs(reduced: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b), a < b, each once: all pairs of classes that can be alike, by their prefixes and sizes."""
    rows = cut(prefix_rows(reduced, threshold))
    share = threshold / (1 + threshold)
    short = rows.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * 2 * share - _EPS) + AGREE)
    x, y = (t.select("shingle", *[F.col(c).alias(f"{c}_{n}") for c in ("key", "size", "place")]) for t, n in ((short, "x"), (rows, "y")))
    smaller = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("key_x") < F.col("key_y")))
    enough = F.col("size_x") >= threshold * F.col("size_y") - _EPS
    needed = F.ceil(share * (F.col("size_x") + F.col("size_y")) - _EPS)
    rest = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) + AGREE
    near = x.join(y, "shingle").filter(smaller & enough & (rest >= needed))
    near = near.groupBy(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).agg(F.count("*").alias("met"), F.first(needed).alias("needed"))
    return near.filter(F.col("met") >= F.least("needed", F.lit(AGREE))).select("a", "b")


def sets_of(keys: DataFrame, reduced: DataFrame) -> DataFrame:
    """Rows (key, size, shingles), one for each class of ``keys`` (key)."""
    return reduced.filter(F.size("shingles") > 0).select("key", "size", "shingles").join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``threshold`` of their union, with similarity; pairs whose sizes rule
    that out are dropped before sets are joined."""
    a, b = (sets.select(F.col("key").alias(n), F.col("size").alias(f"size_{n}")) for n in "ab")
    near = pairs.join(a, "a").join(b, "b").filter(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - _EPS).select("a", "b")
    near = near.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    near = near.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return near.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)


def star_links(reduced: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets: key, size, shingles) of the classes with an edge; (edges: a, b) with a < b, from centre to class; (links: a,
    b, similarity), the edges that hold; and (left: key), the classes that share a bucket with one whose edge failed."""
    members = cut(stars(reduced, threshold).distinct())
    edges = cut(members.select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    sets = cut(sets_of(edges.select(F.explode(F.array("a", "b")).alias("key")), reduced))
    links = cut(verified(edges, sets, threshold))
    failed = members.join(links.select(F.col("a").alias("centre"), F.col("b").alias("key"), F.lit(True).alias("held")), ["centre", "key"], "left")
    by = failed.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("held").alias("held"), F.count("*").alias("n"))
    open_ = by.filter("least <> most and held < n").select("bucket")
    return sets, edges, links, cut(members.join(open_, "bucket", "left_semi").select("key").distinct())


def similar_classes(reduced: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, similarity), a < b, of all alike classes."""
    sets, edges, links, left = star_links(reduced, threshold)
    x, y = (links.select(F.col("a").alias("centre"), F.col("b").alias(n)) for n in "xy")
    beside = x.join(y, "centre").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = beside.unionByName(prefix_pairs(sets.join(left, "key", "left_semi"), threshold)).distinct().join(edges, ["a", "b"], "left_anti")
    return cut(links.unionByName(verified(more, sets, threshold)))


def linked_classes(reduced: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b) that join all alike classes to the same components as ``similar_classes``: the links to centres, and of
    the classes that these leave open the pairs from different components."""
    sets, edges, links, left = star_links(reduced, threshold)
    known = cut(connected_components(links))
    at = {n: known.select(F.col("node").alias(n), F.col("component").alias(f"{n}_in")) for n in "ab"}
    more = prefix_pairs(sets.join(left, "key", "left_semi"), threshold).join(edges, ["a", "b"], "left_anti")
    more = more.join(at["a"], "a", "left").join(at["b"], "b", "left").filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
    return cut(links.select("a", "b").unionByName(verified(more, sets, threshold).select("a", "b")))


def near_duplicate_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (id_a, id_b, similarity), id_a < id_b: every pair of different ids whose shingle sets share at least
    ``threshold`` of their union, pairs of equal texts with similarity 1 included.

    Null ids and texts, and texts with fewer than ``words`` words, make no pair. Repeated rows count once; an id with
    several texts pairs by each of them, with its greatest similarity. An empty table gives an empty one. The
    result holds every pair of a group, as its definition asks; ``near_duplicate_groups`` expands no copies.
    """
    reduced = cut(reduce_texts(df, id_col, text_col, words))
    members, links = cut(reduced.select("id", "key").distinct()), similar_classes(reduced, threshold)
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("key").alias(x)) for x in "ab")
    across = links.join(a, "a").join(b, "b").select("id_a", "id_b", "similarity")
    within = a.join(b.withColumnRenamed("b", "a"), "a").filter("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within).filter("id_a <> id_b")
    return both.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (id, class_id, group_id), one for each id with shingles.

    class_id is the smallest id with an equal shingle set, group_id the smallest id of the connected component of
    links. Copies are not expanded into pairs. Of an id with several texts the least class counts.
    """
    reduced = cut(reduce_texts(df, id_col, text_col, words))
    members = cut(reduced.groupBy("id").agg(F.min("key").alias("key")))
    components = connected_components(linked_classes(reduced, threshold))
    classes = members.groupBy("key").agg(F.min("id").alias("class_id"))
    classes = classes.join(components.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    groups = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.join(classes.join(groups, "component"), "key").select("id", "class_id", "group_id")


def near_duplicate_links(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (id, class_id, n_copies, n_links), one for each id with shingles: its class as in ``near_duplicate_groups``, how
    many other ids have an equal set, and to how many other classes it is alike. Of an id with several texts the least
    class counts; no copies are expanded into pairs."""
    reduced = cut(reduce_texts(df, id_col, text_col, words))
    members = cut(reduced.groupBy("id").agg(F.min("key").alias("key")))
    degree = similar_classes(reduced, threshold).select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("key").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_copies")).join(degree, "key", "left")
    return members.join(classes, "key").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
