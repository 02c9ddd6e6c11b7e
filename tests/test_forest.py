"""Module trees against walks in plain Python."""

import random

from contextlake.operators import forest
from contextlake.session import cut


def _walk(parent, node):
    seen, depth, now = {node}, 0, node
    while (up := parent.get(now)) is not None:
        depth += 1
        if up in seen:
            return -1, -1
        seen.add(up)
        now = up
    return now, depth


def _cases():
    """A chain, a star, cycles and random trees, side by side."""
    rng = random.Random(7)
    parent = {i + 1: i for i in range(70)}
    parent |= {1000 + i: 1000 for i in range(1, 60)}
    parent |= {2000 + c: 2000 + p for c, p in {1: 1, 2: 1, 3: 2, 10: 11, 11: 12, 12: 10, 13: 12, 20: 19, 21: 20}.items()}
    parent |= {3000 + i: 3000 + rng.randrange(i) for i in range(1, 90)} | {3100: 3101, 3101: 3100, 3102: 3100}
    # Children of one parent in several parts of ids, negative ones among them.
    return parent | {4000: 5, 400_000: 4000, -70_000: 4000, 400_001: 4000, 400_002: 400_000}


def test_trees(spark):
    parent = _cases()
    pairs = [(p, c) for c, p in parent.items()]
    edges = spark.createDataFrame(pairs + pairs[:3] + [(None, 5), (6, None)], "p long, c long")
    frame = cut(forest.chains(forest.links(edges, "p", "c")))
    chained = frame.toPandas()
    nodes = set(parent) | set(parent.values())
    assert set(chained.node) == nodes and len(chained) == len(nodes)
    assert {n: (r, d) for n, r, d in zip(chained.node, chained.root, chained.depth)} == {n: _walk(parent, n) for n in nodes}
    paths = {r.node: r.path for r in forest.paths(frame).collect()}
    for node in nodes:
        if _walk(parent, node)[0] == -1:
            assert paths[node] is None
            continue
        up = [node]
        while parent.get(up[-1]) is not None:
            up.append(parent[up[-1]])
        assert paths[node] == up[::-1]
    at = {(r.root, r.first): r.node for r in chained.itertuples() if r.root != -1}
    below: dict[int, dict[int, int]] = {}
    for r in forest.descendants(frame).collect():
        assert r.descendant not in below.setdefault(r.node, {})
        below[r.node][r.descendant] = r.distance
    depth = dict(zip(chained.node, chained.depth, strict=True))
    for r in chained.itertuples():
        if r.root != -1:
            interval = {at[r.root, k] for k in range(r.first, r.last + 1)} - {r.node}
            assert {d: depth[d] - r.depth for d in interval} == below.get(r.node, {}) and r.size == len(interval) + 1
            assert all(r.node in paths[d] for d in interval)


def test_empty(spark):
    empty = spark.createDataFrame([], "p long, c long")
    chained = forest.chains(forest.links(empty, "p", "c"))
    assert chained.count() == 0 and forest.paths(chained).count() == 0 and forest.descendants(chained).count() == 0


def test_module_links_need_files(spark):
    deps = spark.createDataFrame([(1, 2, "mod"), (1, 2, "mod"), (1, 9, "mod"), (2, 3, "use"), (None, 2, "mod"), (2, 4, "mod")], "source_file_id long, target_file_id long, dep_type string")
    files = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 4)] + [(None, "y")], "file_id long, path string")
    got = {(r.node, r.parent) for r in forest.module_links(deps, files).collect()}
    assert got == {(2, 1), (4, 2), (1, None)}
