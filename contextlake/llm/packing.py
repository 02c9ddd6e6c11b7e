"""Filling containers of fixed capacity with items, with as little unused space as possible.

Method: best-two-fit. A container is filled greedily with the largest item that still fits; then its smallest item
is replaced by the two unpacked items whose sum fits the gap that its removal would leave most tightly, as long as
that leaves less unused space. Items are only split if they alone exceed the capacity.

Scale: containers are independent, so items and pieces are dealt to shards of about ``SHARD_ITEMS`` by a hash of id and
piece, and each shard is packed on its own; so the pieces of one huge item lie in all shards. A shard leaves one partly
filled container at most, which at some thousand containers a shard is under a tenth of a percent of the space. The
number of shards follows the number of items; pieces beyond these grow a shard by the share that they have in all rows.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Items of a shard, on average.
SHARD_ITEMS = 20_000
#: Containers a shard may number; ids of different shards don't meet.
_SHARD_STRIDE = 1 << 32


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item. Sizes are between 0 and ``capacity``; items of size 0 go to container 0."""
    stock: dict[int, list[int]] = {}
    for index in sorted(range(len(sizes)), key=lambda i: -i):
        if sizes[index] > 0:
            stock.setdefault(sizes[index], []).append(index)
    left = sorted(stock)
    bins = [0] * len(sizes)

    def take(size: int) -> int:
        items = stock[size]
        index = items.pop()
        if not items:
            left.pop(bisect_right(left, size) - 1)
        return index

    def give(size: int, index: int) -> None:
        if not stock[size]:
            left.insert(bisect_right(left, size), size)
        stock[size].append(index)

    def best_pair(room: int, above: int) -> tuple[int, int] | None:
        """The two stocked sizes with the largest sum over ``above`` and within ``room``."""
        best, found, low, high = above, None, 0, bisect_right(left, room) - 1
        while low <= high:
            total = left[low] + left[high]
            if total > room:
                high -= 1
                continue
            if total > best and (low != high or len(stock[left[low]]) > 1):
                best, found = total, (left[low], left[high])
                if best == room:
                    break
            low += 1
        return found

    number = 0
    while left:
        held: list[tuple[int, int]] = []
        gap = capacity
        while (at := bisect_right(left, gap) - 1) >= 0:
            size = left[at]
            held.append((size, take(size)))
            gap -= size
        while gap and left:
            smallest = min(held)
            pair = best_pair(gap + smallest[0], smallest[0])
            if not pair:
                break
            held.remove(smallest)
            held += [(size, take(size)) for size in pair]
            gap += smallest[0] - sum(pair)
            give(*smallest)
        for _, index in held:
            bins[index] = number
        number += 1
    return bins


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, n_items: int | None = None) -> DataFrame:
    """Rows (``id_col``, bin_id, piece, start_token, n_tokens), one for each item, or piece of an item over ``capacity``.

    An item over the capacity becomes full pieces and one rest; all others stay whole, as piece 0. Null sizes count
    as 0; items of size 0 take no room and stand in the first container of their shard. Items with a null id are
    packed like others. Repeated rows are packed as often as they come. The number of shards follows the number of
    rows, ``n_items``; without it they are counted, which computes the sizes once more.
    """
    shards = max(1, -(-(sizes.count() if n_items is None else n_items) // shard_items))
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    items = (
        sizes.select(F.col(id_col).alias("item"), size.alias("total"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(total - 1) div {capacity}")))))
        .select(
            F.pmod(F.xxhash64("item", "piece"), F.lit(shards)).alias("shard"),
            "item",
            "piece",
            (F.col("piece") * capacity).alias("start_token"),
            F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity).cast("bigint")).alias("n"),
        )
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "item", "piece"], ascending=[False, True, True], kind="stable")
        numbers = best_two_fit(rows["n"].tolist(), capacity)
        return pd.DataFrame({id_col: rows["item"].array, "bin_id": [key[0] * _SHARD_STRIDE + b for b in numbers], "piece": rows["piece"].array, "start_token": rows["start_token"].array, "n_tokens": rows["n"].array})

    kind = sizes.schema[id_col].dataType.simpleString()
    return items.groupBy("shard").applyInPandas(run, f"`{id_col}` {kind}, bin_id bigint, piece bigint, start_token bigint, n_tokens bigint")


def split_items(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of items that had to be split, once each."""
    return packed.filter(F.col("piece") > 0).select(id_col).distinct()
