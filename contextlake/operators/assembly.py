"""Packing the best chunks into a token budget: the file tree, current, related and frequent code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.operators.numbering import numbered
from contextlake.session import cut

#: Fixed values of the layers.
BUDGET = 40_000
WEIGHTS = {"fixed": 0.1, "short_term": 0.3, "associative": 0.4, "spare": 0.2}
LEAST_SPARE = 500
ACTIVE_SHARE = 0.7
TREE_DEPTH = 3
RELATED_SCORE = 0.8
#: Items that the greedy filling looks at in one go.
FILL_BLOCK = 1000
#: Lines of the stretches that long files are summed up in.
STRETCH_LINES = 256
#: Fixed value: sections in the order of the output.
SECTIONS = ("fixed", "associative", "spare", "short_term")


def layer_budgets(budget: int = BUDGET, weights: dict[str, float] = WEIGHTS) -> dict[str, int]:
    """The tokens of each layer before any is used; spare gets at most its share of what is left."""
    return {name: math.floor(budget * weight) for name, weight in weights.items()}


def spare_budget(budget: int, used: int, share: float = WEIGHTS["spare"]) -> int:
    """What is left for the spare layer; 0 unless that exceeds ``LEAST_SPARE``."""
    left = min(math.floor(budget * share), budget - used)
    return left if left > LEAST_SPARE else 0


def prefix_fill(items: DataFrame, budget: Column | int, order: list[str], tokens: str = "tokens") -> DataFrame:
    """The items of a short list, in order, up to the first that would exceed the budget.

    Null and negative sizes count as 0.
    """
    size = F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))
    window = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(window)).filter(F.col("used") <= budget)


def prefix_fill_files(chunks: DataFrame, budget: int, tokens: str = "token_count") -> DataFrame:
    """The same for all files at once: of each file_id its chunks by start_line and chunk_id, nulls first.

    Files are summed up in stretches of ``STRETCH_LINES`` lines first; stretches that start beyond the budget go before
    any window, so no task sees a long file as a whole.
    """
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("bigint")
    sized = chunks.filter("file_id is not null").withColumns({"size": size, "stretch": F.coalesce(F.floor(F.col("start_line") / STRETCH_LINES), F.lit(-(1 << 40)))})
    before = Window.partitionBy("file_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("file_id", "stretch").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    near = sized.join(starts.filter(F.col("base") <= budget).drop("total"), ["file_id", "stretch"])
    within = Window.partitionBy("file_id", "stretch").orderBy(F.col("start_line").asc_nulls_first(), "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("used", F.col("base") + F.sum("size").over(within)).filter(F.col("used") <= budget).drop("size", "stretch", "base")


def greedy_fill(items: DataFrame, budget: int, tokens: str = "tokens", rank: str = "rank") -> DataFrame:
    """The items, by rank, that still fit when their turn comes; what doesn't fit is skipped.

    Null and negative sizes count as 0; such items take no room and are all kept. The others are taken in blocks of the
    ``FILL_BLOCK`` next ones that fit what is left, so the driver holds one block; as every block's first item is kept,
    and each takes a token at least, what is kept is bounded by the budget and so may be broadcast. ``items`` are read once
    for each block, so they should be written before.
    """
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("bigint")
    kept, left, last = [], budget, None
    while left > 0:
        fits = items.select(F.col(rank).cast("bigint").alias("rank"), size.alias("size")).filter(F.col("size").between(1, left))
        block = (fits if last is None else fits.filter(F.col("rank") > last)).orderBy("rank").limit(FILL_BLOCK).collect()
        for item in block:
            if item["size"] <= left:
                kept.append(item["rank"])
                left -= item["size"]
        if len(block) < FILL_BLOCK:
            break
        last = block[-1]["rank"]
    ranks = items.sparkSession.createDataFrame([(r,) for r in kept], "_rank bigint")
    free = items.filter((size == 0) & F.lit(budget >= 0))
    return free.unionByName(items.filter(size > 0).join(F.broadcast(ranks), F.col(rank) == F.col("_rank"), "left_semi"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each file by start line and id."""
    return chunks.groupBy("file_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "file_id"]), F.struct("start_line", "chunk_id")).alias("x")).select("file_id", "x.*")


def cheapest_chunks(chunks: DataFrame) -> DataFrame:
    """The chunk of each file with the fewest tokens; ties go to the earlier line, then the smaller id."""
    return chunks.groupBy("file_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "file_id"]), F.struct("token_count", "start_line", "chunk_id")).alias("x")).select("file_id", "x.*")


def tree_entries(files: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """Rows (entry, name, depth, is_dir) of the file tree down to ``max_depth`` directories.

    Only files within the depth count; parts that start with an underscore hide what is beneath.
    """
    parts = F.split("path", "/")
    shown = files.select("path", parts.alias("parts")).filter((F.size("parts") - 1 <= max_depth) & ~F.exists("parts", lambda p: p.startswith("_")))
    each = shown.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    rows = each.select(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("entry"), F.element_at("parts", F.col("n")).alias("name"), F.col("n").cast("bigint").alias("depth"), (F.col("n") < F.size("parts")).alias("is_dir"))
    return rows.groupBy("entry", "name", "depth").agg(F.bool_or("is_dir").alias("is_dir"))


def _sorted_tree(node: dict) -> list[tuple[str, dict | None]]:
    return sorted(node.items(), key=lambda x: (x[1] is None, x[0].casefold(), x[0].swapcase()))


def render_tree(paths: list[str], max_depth: int = TREE_DEPTH) -> str:
    """The tree as text, directories first; for the paths of one project, already cut to the depth."""
    root: dict = {}
    for path in paths:
        parts = path.split("/")
        if len(parts) - 1 > max_depth or any(p.startswith("_") for p in parts):
            continue
        node = root
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if node is None:
                break
        else:
            node.setdefault(parts[-1], None)
    if not root:
        return "(no indexed files)"
    out: list[str] = []

    def draw(node: dict, lead: str, top: bool) -> None:
        entries = _sorted_tree(node)
        for i, (name, below) in enumerate(entries):
            last = i == len(entries) - 1
            out.append(lead + ("" if top else "└── " if last else "├── ") + name + ("/" if below is not None else ""))
            if below:
                draw(below, lead + ("" if top else "    " if last else "│   "), False)

    draw(root, "", True)
    return "\n".join(out)


def related_items(hits: DataFrame, dep_chunks: DataFrame) -> DataFrame:
    """Hits (chunk_id, path, start_line, tokens, score), a short list, and, below them, the chunks of dependencies, of
    which there may be any number.

    These score ``RELATED_SCORE`` of the last hit, or 1 without hits; a place (path, start_line) that a hit holds
    isn't repeated. The result has rank by falling score, hits before dependencies, then by id.
    """
    hits = cut(hits)
    extra = dep_chunks.join(F.broadcast(hits.select("path", "start_line")), ["path", "start_line"], "left_anti")
    extra = extra.groupBy("path", "start_line").agg(F.min(F.struct("chunk_id", "tokens")).alias("x")).select("path", "start_line", "x.*")
    count, least = hits.agg(F.count("*"), F.min("score")).first()
    score = F.lit(1.0 if least is None else least * RELATED_SCORE)
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "chunk_id")).cast("bigint"))
    names = ["chunk_id", "path", "start_line", "tokens", "score", "rank"]
    return first.select(names).unionByName(numbered(extra, "chunk_id", start=count, name="rank").withColumn("score", score).select(names))


def layer_summary(items: DataFrame) -> DataFrame:
    """Tokens and items of each layer."""
    return items.groupBy("layer").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count("*").alias("item_count"))


def arrange(sections: dict[str, str]) -> str:
    """The non-empty sections in their order, with rules between them."""
    return "\n---\n".join(sections[name] for name in SECTIONS if sections.get(name))
