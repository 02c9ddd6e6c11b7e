"""The k nearest other vectors of every vector, by Euclidean distance.

Method: inverted multi-index. The two halves of the vectors are quantised on their own with ``K`` centroids each, so
K x K centroid pairs divide the space. A query visits the pairs by rising sum of the two distances, with a heap over
the two sorted centroid lists, until the visited cells hold ``CANDIDATES`` vectors; these are reranked exactly. A cell
that holds more than ``BLOCK`` vectors has centroids of its own, and a query visits its parts by rising distance, so
what a query costs doesn't depend on how dense its surroundings are. With ``candidates`` as large as the collection
every cell is visited and the search is exact.

The codebooks are fitted on a bounded sample (``SAMPLE`` vectors, the first by a hash of the id); every vector is
indexed and every vector is a query. K follows the number of vectors so that a cell holds about ``OCCUPANCY``.

Scale: equal vectors are one entry that carries its k + 1 smallest ids, which is all that any result can need of it;
row_number limits run before the shuffle, so a group of copies is cut to k + 1 rows in each task. Cells are put in an
order that keeps near ones together, and runs of them with about ``REGION`` vectors form regions. A query is sent once to
each region that it visits, with the list of what it visits there, and brings back one list of its k best from it; to
its own region it goes as the point that it is. A region that many queries visit, by the visits of a sample, has several
copies that share them. A task holds one region at a time, and queries stream past it in Arrow batches. Broadcast
are the codebooks and the sizes of the cells only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contextlake.session import cut, spread

DIM = 64
SAMPLE = 65_536
OCCUPANCY = 100
MOST_CENTROIDS = 1024
CANDIDATES = 3000
BLOCK = 2048
#: Vectors of a region, at most and at least: fewer than at most only where there would be less regions than cores.
REGION, LEAST_REGION = 32_768, 4096
#: Sampled vectors to each centroid of a cell's own, and the queries whose visits show which regions are asked most.
SAMPLE_PART, SAMPLE_QUERIES = 16, 2048
#: Candidates beyond k that are reranked in double precision.
SPARE = 8
_ROUNDS = 12


def usable(embedding: str = "embedding", dim: int = DIM):
    """The condition that a vector has ``dim`` finite values that are not all zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


def fit_codebook(x: np.ndarray, k: int, rounds: int = _ROUNDS, seed: int = 0) -> np.ndarray:
    """k centroids of ``x`` by Lloyd's rounds; an empty centroid restarts at a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        there = np.nonzero(counts)[0]
        sums = np.zeros_like(centres, dtype=np.float64)
        sums[there] = np.add.reduceat(x[near.argsort(kind="stable")], (np.cumsum(counts) - counts)[there], axis=0, dtype=np.float64)
        empty = counts == 0
        centres = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
        centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centres


def _line_order(centres: np.ndarray) -> np.ndarray:
    """The place of each centroid along the direction in which they differ most."""
    away = centres - centres.mean(0)
    return (away @ np.linalg.svd(away, full_matrices=False)[2][0]).argsort().argsort()


def _interleaved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits of two numbers in turn: near pairs have near results."""
    total = np.zeros(np.broadcast(x, y).shape, np.int64)
    for bit in range(10):
        total |= ((x >> bit & 1) << (2 * bit + 1)) | ((y >> bit & 1) << (2 * bit))
    return total


class MultiIndex:
    """Centroid pairs, the finer centroids of dense cells, and the parts, blocks and regions that vectors are dealt to."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.finer: dict[int, np.ndarray] = {}
        self.cells = len(first) * len(second)
        self.order = np.argsort(_interleaved(_line_order(first)[:, None], _line_order(second)[None]).ravel(), kind="stable")
        self._number_parts()

    def _number_parts(self) -> None:
        counts = np.ones(self.cells, np.int64)
        for cell, own in self.finer.items():
            counts[cell] = len(own)
        starts = np.zeros(self.cells, np.int64)
        starts[self.order] = np.cumsum(counts[self.order]) - counts[self.order]
        self.part_of, self.parts = starts, int(counts.sum())

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(v[:, : self.half], self.first), _squared(v[:, self.half :], self.second)

    def cell(self, v: np.ndarray) -> np.ndarray:
        first, second = self.halves(v)
        return first.argmin(1) * len(self.second) + second.argmin(1)

    def part(self, v: np.ndarray) -> np.ndarray:
        """The part of each vector: its cell, or the part of a dense cell whose centroid is nearest."""
        cells = self.cell(v)
        parts = self.part_of[cells]
        for cell in np.unique(cells):
            if int(cell) in self.finer:
                here = np.nonzero(cells == cell)[0]
                parts[here] += _squared(v[here], self.finer[int(cell)]).argmin(1)
        return parts

    def refine(self, sizes: np.ndarray, sample: np.ndarray) -> None:
        """Give cells of more than ``BLOCK`` vectors centroids of their own, as many as their size and sample allow."""
        cells = self.cell(sample)
        for cell in np.nonzero(sizes > BLOCK)[0].tolist():
            own = sample[cells == cell]
            wanted = min(-(-int(sizes[cell]) // (4 * OCCUPANCY)), len(own) // SAMPLE_PART, MOST_CENTROIDS)
            if wanted > 1:
                self.finer[cell] = fit_codebook(np.ascontiguousarray(own), wanted)
        self._number_parts()

    def deal(self, sizes: np.ndarray, region: int) -> None:
        """Cut parts into blocks, and put the blocks together to regions of about ``region`` vectors."""
        self.sizes, self.blocks = sizes, np.maximum(1, -(-sizes // BLOCK))
        self.block_of = np.cumsum(self.blocks) - self.blocks
        per_block = np.repeat(sizes / self.blocks, self.blocks)
        self.region_of = ((np.cumsum(per_block) - per_block) // region).astype(np.int64)
        self.share(np.ones(int(self.region_of[-1]) + 1, np.int64))

    def share(self, copies: np.ndarray) -> None:
        """Set how many copies of each region share its queries."""
        self.copies, self.slot_of = copies, np.cumsum(copies) - copies

    def visited(self, v: np.ndarray, first: np.ndarray, second: np.ndarray, wanted: int) -> np.ndarray:
        """The blocks that a query visits: those of non-empty cells by rising ``first[i] + second[j]``, and of the parts of
        a dense cell by rising distance, until they hold ``wanted`` vectors."""
        i_order, j_order = first.argsort().tolist(), second.argsort().tolist()
        i_cost, j_cost = np.sort(first).tolist(), np.sort(second).tolist()
        width, total, found = len(second), 0, []
        heap, seen = [(i_cost[0] + j_cost[0], 0, 0)], {(0, 0)}
        while heap and total < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * width + j_order[j]
            part = int(self.part_of[cell])
            own = self.finer.get(cell)
            for p in [part] if own is None else (part + _squared(v[None], own)[0].argsort()).tolist():
                if (size := int(self.sizes[p])) and total < wanted:
                    found.append(p)
                    total += size
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < len(i_cost) and step[1] < width and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (i_cost[step[0]] + j_cost[step[1]], *step))
        return np.concatenate([np.arange(self.block_of[p], self.block_of[p] + self.blocks[p]) for p in found]) if found else np.zeros(0, np.int64)


def _nearest(queries: np.ndarray, names: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k nearest points, exactly: ids and squared distances, infinite for the query itself."""
    rough = _squared(queries, points)
    rough[names[:, None] == ids[None]] = np.inf
    keep = min(k + SPARE, len(ids))
    pick = np.argpartition(rough, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(queries), 1))
    exact = ((queries[:, None].astype(np.float64) - points[pick]) ** 2).sum(2)
    exact[names[:, None] == ids[pick]] = np.inf
    order = np.lexsort((ids[pick], exact), axis=1)[:, :k]
    return np.take_along_axis(ids[pick], order, 1), np.take_along_axis(exact, order, 1)


class _Region:
    """The points of one region, and the search among them."""

    def __init__(self, dim: int, k: int):
        self.k, self.held = k, []
        self.points, self.ids = np.zeros((0, dim), np.float32), np.zeros(0, np.int64)
        self.starts: dict[int, tuple[int, int]] = {}

    def add(self, block: np.ndarray, rep: np.ndarray, v: np.ndarray) -> None:
        self.held.append((block, rep, v))

    def close(self) -> None:
        """Sort what was added by block."""
        if self.held:
            block, ids, points = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(block, kind="stable")
            names, starts = np.unique(block[order], return_index=True)
            self.starts = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True), strict=True))
            self.points, self.ids, self.held = points[order], ids[order], []

    def search(self, rep: np.ndarray, v: np.ndarray, visits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query over its blocks: (number of the query, id, squared distance), sorted."""
        query = np.repeat(np.arange(len(rep)), lengths)
        order = np.argsort(visits, kind="stable")
        query, visits = query[order], visits[order]
        edges = np.r_[0, np.nonzero(np.diff(visits))[0] + 1, len(visits)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if at == end or int(visits[at]) not in self.starts:
                continue
            low, high = self.starts[int(visits[at])]
            who = query[at:end]
            ids, far = _nearest(v[who], rep[who], self.points[low:high], self.ids[low:high], self.k)
            good = np.isfinite(far)
            found.append((np.repeat(who, far.shape[1]).reshape(far.shape)[good], ids[good], far[good]))
        who, ids, far = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, far, who))
        who, ids, far = who[order], ids[order], far[order]
        begins = np.searchsorted(who, np.arange(len(rep)))
        kept = np.arange(len(who)) - begins[who] < self.k
        return who[kept], ids[kept], far[kept]


def _classes(df: DataFrame, k: int, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, key), each id once; and (classes: key, rep, ids, v), a row for each different vector.

    Vectors are shuffled once; of an id with several, which only their hashes tell, the least counts.
    """
    rows = df.filter(usable(vec_col, dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).withColumn("key", F.xxhash64("v"))
    pairs = cut(rows.select("id", "key").distinct())
    several = pairs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    least = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min_by("key", "v").alias("key"))
    members = cut(pairs.join(several, "id", "left_anti").unionByName(least), pairs)
    few = members.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("rn") <= k + 1)
    named = few.groupBy("key").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    return members, cut(rows.select("key", "v").dropDuplicates(["key"]).join(named, "key"))


def build_index(classes: DataFrame, n: int, dim: int, candidates: int, cores: int) -> MultiIndex:
    """The index over ``classes`` (rep, v): codebooks from the sample, sizes from all rows."""
    half = dim // 2
    sample = _matrix(classes.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column(0).combine_chunks(), dim)
    width = min(MOST_CENTROIDS, max(1, round((n / OCCUPANCY) ** 0.5)))
    index = MultiIndex(fit_codebook(np.ascontiguousarray(sample[:, :half]), width), fit_codebook(np.ascontiguousarray(sample[:, half:]), width))

    def sizes() -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts, counts = np.unique(index.part(_matrix(batch.column(0), dim)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(counts, pa.int64())], names=["part", "n"])

        got = classes.select("v").mapInArrow(run, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(index.parts, np.int64)
        found[got.column("part").to_numpy()] = got.column("n").to_numpy()
        return found

    counted = sizes()
    index.refine(counted[index.part_of], sample)
    region = max(LEAST_REGION, min(REGION, n // max(1, cores)))
    index.deal(sizes() if index.finer else counted, region)
    asked = sample[:SAMPLE_QUERIES]
    first, second = index.halves(asked)
    visits = np.bincount(np.concatenate([np.unique(index.region_of[index.visited(asked[i], first[i], second[i], candidates)]) for i in range(len(asked))]), minlength=len(index.copies))
    index.share(np.maximum(1, np.round(visits * (n / len(asked)) / (4 * region))).astype(np.int64))
    return index


def nearest_neighbours(df: DataFrame, k: int = 10, id_col: str = "chunk_id", vec_col: str = "embedding", dim: int = DIM, candidates: int = CANDIDATES) -> DataFrame:
    """Rows (chunk_id, neighbour_id, distance): of each usable vector its k nearest others, fewer if there are fewer.

    Of equal distances the smaller id is nearer. Vectors that are null, of another length, all zero or hold null, NaN
    or infinite values, and rows with a null id, are left out. Repeated rows count once; of an id with several vectors
    the least counts. The search is approximate: see the module text.
    """
    members, classes = _classes(df, k, id_col, vec_col, dim)
    n = classes.count()
    if not n:
        return members.select(F.col("id").alias("chunk_id"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance"))
    context = df.sparkSession.sparkContext
    built = build_index(classes.select("rep", "v"), n, dim, candidates, context.defaultParallelism)
    given, slots = context.broadcast(built), int(built.copies.sum())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as a point of its block, in all copies of the region, and as a query of each region it visits."""
        index = given.value
        for batch in batches:
            rep, v = np.asarray(batch.column(0)), _matrix(batch.column(1), dim)
            first, second = index.halves(v)
            parts = index.part(v)
            home = index.block_of[parts] + rep % index.blocks[parts]
            row, slot, block, visits, lengths = [], [], [], [], []
            for i in range(len(rep)):
                to = index.visited(v[i], first[i], second[i], candidates)
                regions = index.region_of[to]
                order = np.argsort(regions, kind="stable")
                asks = {}
                for r, blocks in zip(*(lambda u, at: (u.tolist(), np.split(to[order], at[1:])))(*np.unique(regions[order], return_index=True)), strict=True):
                    asks[int(index.slot_of[r] + rep[i] % index.copies[r])] = blocks
                own = int(index.region_of[home[i]])
                for s in range(int(index.slot_of[own]), int(index.slot_of[own] + index.copies[own])):
                    asks.setdefault(s, np.zeros(0, np.int64))
                for s, blocks in asks.items():
                    row.append(i)
                    slot.append(s)
                    block.append(home[i] if index.slot_of[own] <= s < index.slot_of[own] + index.copies[own] else -1)
                    visits.append(blocks)
                    lengths.append(len(blocks))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(visits), pa.int32()))
            names = ["slot", "block", "visits", "rep", "v"]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(block, pa.int64()), lists, pa.array(rep[row], pa.int64()), batch.column(1).take(pa.array(row))], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, region, waiting = None, _Region(dim, k), []

        def answer(rep: np.ndarray, v: np.ndarray, visits: pa.ListArray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rep), 512):
                part = visits.slice(at, 512)
                lengths = part.value_lengths().to_numpy(zero_copy_only=False)
                who, ids, far = region.search(rep[at : at + 512], v[at : at + 512], np.asarray(part.flatten(), np.int64), lengths)
                ends = pa.array(np.searchsorted(who, np.arange(len(lengths) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, far)]
                yield pa.RecordBatch.from_arrays([pa.array(rep[at : at + 512], pa.int64()), *lists], names=["q", "who", "far"]).filter(pa.array(lengths > 0))

        def close() -> Iterator[pa.RecordBatch]:
            """Once all points of the region are there, the queries among them can be answered."""
            region.close()
            for asked in waiting:
                yield from answer(*asked)
            waiting.clear()

        for batch in batches:
            slot, block, rep, v = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(3)), _matrix(batch.column(4), dim)
            edges = np.nonzero((np.diff(slot) != 0) | (np.diff((block < 0).astype(np.int8)) != 0))[0] + 1
            for start, end in zip(np.r_[0, edges].tolist(), np.r_[edges, len(slot)].tolist(), strict=True):
                if slot[start] != now:
                    yield from close()
                    now, region = slot[start], _Region(dim, k)
                asked = rep[start:end], v[start:end], batch.column(2).slice(start, end - start)
                if block[start] >= 0:
                    region.add(block[start:end], *asked[:2])
                    waiting.append(asked)
                else:
                    yield from close()
                    yield from answer(*asked)
        yield from close()

    dealt = spread(classes.select("rep", "v")).mapInArrow(deal, "slot bigint, block bigint, visits array<int>, rep bigint, v array<float>")
    # A partition for each copy of a region, which AQE, going by bytes, would put together.
    found = dealt.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", F.col("block") < 0).mapInArrow(search, "q bigint, who array<bigint>, far array<double>")
    # A query has one row for each region that it visits, so these lists are short.
    best = found.groupBy("q").agg(F.flatten(F.collect_list("far")).alias("far"), F.flatten(F.collect_list("who")).alias("who"))
    near = best.select("q", F.explode(F.slice(F.array_sort(F.arrays_zip("far", "who")), 1, k)).alias("x")).select("q", F.col("x.far").alias("d"), F.col("x.who").alias("rep"))

    copied = classes.filter(F.size("ids") > 1).select("rep", "ids")
    others = near.join(copied, "rep", "left").select("q", F.explode(F.coalesce("ids", F.array("rep"))).alias("neighbour_id"), "d")
    own = copied.select(F.col("rep").alias("q"), F.explode("ids").alias("neighbour_id"), F.lit(0.0).alias("d"))
    ranked = others.unionByName(own).withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("d", "neighbour_id"))).filter(F.col("rn") <= k + 1)
    every = members.join(classes.select("key", F.col("rep").alias("q"), "ids"), "key").select(F.col("id").alias("chunk_id"), "q", ((F.size("ids") > 1) & F.array_contains("ids", F.col("id"))).alias("listed"))
    # A copy that stands in the list of its class takes one of the k + 1 places.
    result = every.join(ranked, "q").filter((F.col("chunk_id") != F.col("neighbour_id")) & (F.col("listed") | (F.col("rn") <= k)))
    return result.select("chunk_id", "neighbour_id", F.sqrt("d").alias("distance"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Rows (chunk_id_a, chunk_id_b), a < b: pairs of which one is among the nearest of the other, once each."""
    a, b = F.col("chunk_id"), F.col("neighbour_id")
    return neighbours.select(F.least(a, b).alias("chunk_id_a"), F.greatest(a, b).alias("chunk_id_b")).distinct()
