"""Parent-child links of unknown depth: paths, depths, roots and descendants, with cycles told apart.

Method: heavy-path decomposition. After cycle separation every node has the size of its subtree; the child with the
largest subtree continues its parent's chain, all others start one. Everything else comes from the chains: a node's
root is the head of the last chain on its way up, its depth and its place in a preorder walk are sums over the chains
on that way, paths are chain segments put together, and as a chain occupies consecutive places of the walk, the
descendants of a node are one interval of places.

Scale: everything a node needs from above or below is reached by pointer doubling, so a tree of depth d takes log2(d)
rounds of joins on unique keys; a way up crosses at most log2(n) chains, so the rounds over chains are log2(log2(n)). A
round is one job: it writes its table, counts on the way what decides on the next round, and deletes the table before.
Only paths and descendants, which the caller asks for on their own, have as many entries as the depths add up to.
Children are combined to sums map-side before the shuffle, and numbered in parts, so a parent may have any number of
them; looking up a parent that many share is a join with distinct keys on the other side, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.session import cut

#: The ids that one part of the children of a parent spans, and so its most children.
SIBLING_SPAN = 65_536
#: The blocks of one level that a block of the next level holds, where intervals are cut into blocks.
BLOCK_BASE = 16


def links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Rows (node, parent) of all nodes, parent null at the top; repeated pairs and pairs with a null end don't count."""
    pairs = edges.select(F.col(parent).cast("bigint").alias("parent"), F.col(child).cast("bigint").alias("node")).dropna().distinct()
    tops = pairs.select(F.col("parent").alias("node")).distinct().join(pairs, "node", "left_anti").select("node", F.lit(None).cast("bigint").alias("parent"))
    return pairs.select("node", "parent").unionByName(tops)


def sized(nodes: DataFrame) -> DataFrame:
    """Rows (node, parent, size): size counts a node and all beneath it, and is -1 on and below cycles.

    ``nodes`` has one row (node, parent) for each node. The k-th round knows the 2^k-th ancestor of the nodes that
    haven't arrived at the top; their sums so far are what lies 2^k to 2^(k+1) - 1 links beneath that ancestor. As depths
    have no gaps, a round in which no node arrives ends the walk, and what hasn't arrived never will.
    """
    top = F.col("parent").isNull()
    now = cut(nodes.select("node", "parent", F.coalesce("parent", "node").alias("up"), top.alias("done"), F.lit(False).alias("new"), F.lit(1).cast("bigint").alias("size")))
    while True:
        going = now.filter("not done")
        below = going.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("done").alias("end"))
        moved = going.join(above, "up").select("node", "parent", F.col("next").alias("up"), F.col("end").alias("done"), F.col("end").alias("new"), "size")
        every = now.filter("done").withColumn("new", F.lit(False)).unionByName(moved).join(below, "node", "left")
        now = cut(every.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"), now, arrived=F.count_if("new"))
        if not now.observed["arrived"]:
            return now.select("node", "parent", F.when(F.col("done"), F.col("size")).otherwise(-1).cast("bigint").alias("size"))


def chains(nodes: DataFrame) -> DataFrame:
    """Rows (node, parent, root, depth, size, head, place, first, last) of all nodes.

    head is the top of the node's chain and place its distance to it. first and last are the node's place in a preorder
    walk of its tree, heavy children first, then by id, and the last place beneath it: a node's descendants are the
    nodes of its root with first in (first, last]. On and below cycles all but node and parent are -1.
    """
    known = sized(nodes)
    trees = known.filter("size <> -1")
    kids = trees.filter("parent is not null").select("node", "parent", "size")
    start = trees.join(_offsets(kids), "node", "left")
    heavy, zero = F.coalesce("heavy", F.lit(False)), F.lit(0).cast("bigint")
    step = cut(start.select("node", "parent", "size", "offset", F.when(heavy, F.col("parent")).otherwise(F.col("node")).alias("head"), F.when(heavy, 1).otherwise(0).cast("bigint").alias("place")))
    step = _run_up(step, "head", "place")
    # From chain to chain: a head's depth and first place, summed over the chains above, and the last of these.
    tops = step.filter("node = head").select("node", "parent", "offset")
    above = step.select(F.col("node").alias("parent"), F.col("head").alias("over"), F.col("place").alias("along"))
    alone = F.col("over").isNull()
    jumps = tops.join(above, "parent", "left").select("node", F.coalesce("over", "node").alias("up"), F.when(alone, zero).otherwise(F.col("along") + 1).alias("depth"), F.when(alone, zero).otherwise(F.col("along") + F.col("offset")).alias("first"))
    jumps = _run_up(cut(jumps), "up", "depth", "first")
    placed = step.join(jumps.select(F.col("node").alias("head"), F.col("up").alias("root"), F.col("depth").alias("over"), F.col("first").alias("base")), "head")
    placed = placed.withColumns({"depth": F.col("over") + F.col("place"), "first": F.col("base") + F.col("place")})
    placed = placed.select("node", "parent", "root", "depth", "size", "head", "place", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    lost = known.filter("size = -1").select("node", "parent", *[F.lit(-1).cast("bigint").alias(c) for c in ("root", "depth", "size", "head", "place", "first", "last")])
    return placed.unionByName(lost)


def _offsets(kids: DataFrame) -> DataFrame:
    """Rows (node, heavy, offset) for ``kids`` (node, parent, size): whether a node is its parent's largest child, and
    the room that the parent and the siblings before it take in the walk.

    The largest child comes first, the smaller id of equal ones; the others follow by id. A parent's children are
    dealt to parts by id, ``SIBLING_SPAN`` ids each, and summed up within these; of a parent with any number of children
    one task sees one part, or one sum for each part.
    """
    largest = kids.groupBy("parent").agg(F.max_by(F.struct(F.col("node").alias("first_child"), F.col("size").alias("first_size")), F.struct("size", -F.col("node"))).alias("x")).select("parent", "x.*")
    every = kids.join(largest, "parent")
    rest = every.filter("node <> first_child").withColumn("part", F.floor(F.col("node") / SIBLING_SPAN))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = rest.groupBy("parent", "part").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before("parent", "part")), F.lit(0)))
    light = rest.withColumn("inside", F.coalesce(F.sum("size").over(before("parent", "part", "node")), F.lit(0))).join(parts.drop("total"), ["parent", "part"])
    first = every.filter("node = first_child").select("node", F.lit(True).alias("heavy"), F.lit(1).cast("bigint").alias("offset"))
    return first.unionByName(light.select("node", F.lit(False).alias("heavy"), (1 + F.col("first_size") + F.col("base") + F.col("inside")).alias("offset")))


def _run_up(nodes: DataFrame, up: str, *totals: str) -> DataFrame:
    """Follow ``up`` in the written table ``nodes`` until it points to a node that points to itself, adding each of
    ``totals`` on the way, by doubling."""
    while True:
        above = nodes.select(F.col("node").alias(up), F.col(up).alias("next"), *[F.col(t).alias(f"more_{t}") for t in totals])
        more = {t: F.col(t) + F.when(F.col(up) == F.col("node"), 0).otherwise(F.col(f"more_{t}")) for t in totals}
        columns = [(F.col("next") if c == up else more.get(c, F.col(c))).alias(c) for c in nodes.columns if c != "moved"]
        nodes = cut(nodes.join(above, up).select(*columns, (F.col("next") != F.col(up)).alias("moved")), nodes, moved=F.count_if("moved"))
        if not nodes.observed["moved"]:
            return nodes.drop("moved")


def paths(chained: DataFrame) -> DataFrame:
    """Rows (node, path): node ids from the root down to the node; null on and below cycles.

    A round of joins for each chain crossed; each prepends the segment of the chain above. Segments are collected by
    chain, as the path of a chain's last node holds them anyway.
    """
    trees = chained.filter("root <> -1")
    segments = cut(trees.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("segment")))
    above = trees.select(F.col("node").alias("parent"), F.col("head").alias("over"), F.col("place").alias("along"))
    tops = cut(trees.filter("node = head").select("node", "parent").join(above, "parent", "left").select("node", "over", "along"))
    now = cut(tops.select("node", "over", "along", F.array().cast("array<bigint>").alias("path")))
    while True:
        far = tops.select(F.col("node").alias("over"), F.col("over").alias("next"), F.col("along").alias("next_along"))
        climb = now.filter("over is not null").join(far, "over").join(segments.withColumnRenamed("head", "over"), "over")
        climb = climb.select("node", F.col("next").alias("over"), F.col("next_along").alias("along"), F.concat(F.slice("segment", F.lit(1), (F.col("along") + 1).cast("int")), "path").alias("path"))
        now = cut(now.filter("over is null").unionByName(climb), now, going=F.count("over"))
        if not now.observed["going"]:
            break
    whole = trees.select("node", "head", "place").join(now.select(F.col("node").alias("head"), "path"), "head").join(segments, "head")
    found = whole.select("node", F.concat("path", F.slice("segment", F.lit(1), (F.col("place") + 1).cast("int"))).alias("path"))
    return found.unionByName(chained.filter("root = -1").select("node", F.lit(None).cast("array<bigint>").alias("path")))


def _whole_blocks(first: Column, after: Column, level: int) -> Column:
    """The numbers of the blocks of a level within [first, after) that no block of the next level within it holds."""
    unit, wide = BLOCK_BASE**level, BLOCK_BASE ** (level + 1)
    low, high = F.ceil(first / unit).cast("bigint"), F.floor(after / unit).cast("bigint")
    low_wide, high_wide = F.ceil(first / wide).cast("bigint") * BLOCK_BASE, F.floor(after / wide).cast("bigint") * BLOCK_BASE
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(low_wide < high_wide, F.concat(run(low, low_wide), run(high_wide, high))).otherwise(run(low, high))


def descendants(chained: DataFrame) -> DataFrame:
    """Rows (node, descendant, distance): every node with all nodes beneath it, from the intervals of ``chains``; none for
    nodes on and below cycles.

    A node's interval is cut into whole blocks of places, of ``BLOCK_BASE`` to the power of a level each, and every place
    stands in one block of each level. So the join is one on equal blocks that meets no pair in vain; each node has some
    rows for each level, the levels follow the logarithm of the largest tree.
    """
    trees = chained.filter("root <> -1").select("node", "root", "depth", "first", "last")
    largest = trees.agg(F.max("last")).first()[0] or 0
    levels = range(next(n for n in range(1, 17) if BLOCK_BASE**n > largest))
    first, after = F.col("first") + 1, F.col("last") + 1
    blocks = F.array(*[F.struct(F.lit(k).alias("level"), _whole_blocks(first, after, k).alias("blocks")) for k in levels])
    over = trees.filter("last > first").select("node", "root", F.col("depth").alias("from"), F.explode(blocks).alias("x")).select("node", "root", "from", "x.level", F.explode("x.blocks").alias("block"))
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("first") / BLOCK_BASE**k).cast("bigint").alias("block")) for k in levels])
    under = trees.select(F.col("node").alias("descendant"), "root", "depth", F.explode(places).alias("x")).select("descendant", "root", "depth", "x.*")
    return over.join(under, ["root", "level", "block"]).select("node", "descendant", (F.col("depth") - F.col("from")).alias("distance"))


def module_links(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(node, parent) of the module trees: `mod` rows whose two files exist.

    A file with two parents, which the data rules out, keeps the smaller one.
    """
    known = files.select(F.col("file_id").alias("id")).dropna().distinct()
    pairs = dependencies.filter("dep_type = 'mod'").select("source_file_id", "target_file_id").dropna().distinct()
    pairs = pairs.join(known.withColumnRenamed("id", "source_file_id"), "source_file_id", "left_semi").join(known.withColumnRenamed("id", "target_file_id"), "target_file_id", "left_semi")
    return links(pairs.groupBy("target_file_id").agg(F.min("source_file_id").alias("source_file_id")), "source_file_id", "target_file_id")
