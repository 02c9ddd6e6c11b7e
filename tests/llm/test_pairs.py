"""Near duplicates and neighbours against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from contextlake.llm import near_duplicates, neighbours


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(4, 80))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    return [" ".join(t) for t in texts] + [None, "", "one two", "One TWO\tthree", "one-two three"]


def _sets(texts, n):
    for text in texts:
        found = re.findall("[a-z0-9_]+", (text or "").lower())
        yield set(zip(*(found[i:] for i in range(n)), strict=False))


def _pairs(texts, n, threshold):
    sets = list(_sets(texts, n))
    return {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_pairs(spark):
    texts = _texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x")], "chunk_id long, content string, key string")
    got = near_duplicates.near_duplicate_pairs(frame, words=3, threshold=0.6)
    assert {(r.id_a, r.id_b) for r in got.collect()} == _pairs(texts, 3, 0.6)
    groups = {r.id: r for r in near_duplicates.near_duplicate_groups(frame, words=3, threshold=0.6).collect()}
    sets = list(_sets(texts, 3))
    assert set(groups) == {i for i, s in enumerate(sets) if s}
    for i, j in _pairs(texts, 3, 0.6):
        assert groups[i].group_id == groups[j].group_id
        assert (groups[i].class_id == groups[j].class_id) == (sets[i] == sets[j])


def _family(n, own=30):
    """2n texts with the same head of 66 words; texts 2i and 2i + 1 also share most of their own words."""
    rng = random.Random(7)
    head = [f"h{i}" for i in range(66)]
    texts = []
    for i in range(n):
        mine = [f"o{i}x{k}" for k in range(own)]
        for side in "ab":
            cut_off = rng.randint(9, 11)
            texts.append(" ".join(head + mine[:cut_off] + [f"{side}{i}y{k}" for k in range(own - cut_off)]))
    return texts


def test_pairs_in_a_boilerplate_family(spark):
    texts = _family(250)
    frame = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    true = _pairs(texts, 3, 0.6)
    assert true == {(i, i + 1) for i in range(0, 500, 2)}
    got = near_duplicates.near_duplicate_pairs(frame, words=3, threshold=0.6)
    assert {(r.id_a, r.id_b) for r in got.collect()} == true
    groups = near_duplicates.near_duplicate_groups(frame, words=3, threshold=0.6)
    assert {r.id: r.group_id for r in groups.collect()} == {i: i - i % 2 for i in range(500)}


def test_copies_stay_linear(spark):
    frame = spark.createDataFrame([(i, "alpha beta gamma delta epsilon zeta") for i in range(3000)], "chunk_id long, content string")
    reduced = near_duplicates.reduce_texts(frame, "chunk_id", "content", 5)
    assert reduced.filter("size(shingles) > 0").count() <= 8
    assert near_duplicates.near_duplicate_links(frame).filter("class_id = 0 and n_copies = 2999 and n_links = 0").count() == 3000
    groups = near_duplicates.near_duplicate_groups(frame)
    assert groups.count() == 3000 and groups.filter("class_id = 0 and group_id = 0").count() == 3000


def test_empty_pairs(spark):
    frame = spark.createDataFrame([], "chunk_id long, content string")
    assert near_duplicates.near_duplicate_pairs(frame).count() == 0 and near_duplicates.near_duplicate_groups(frame).count() == 0


def test_rows_of_a_band():
    assert near_duplicates.rows_of(0.6) == 3 and near_duplicates.rows_of(0.8) == 4 and near_duplicates.rows_of(0.01) == 1


def test_hot_buckets_give_the_same_stars(spark):
    frame = spark.createDataFrame(list(enumerate(_family(100))), "chunk_id long, content string")
    reduced = near_duplicates.cut(near_duplicates.reduce_texts(frame, "chunk_id", "content", 3))
    plain = {tuple(r) for r in near_duplicates.stars(reduced, 0.6).collect()}
    assert near_duplicates.hot_buckets(reduced, 0.6, 0.001, 3) and not near_duplicates.hot_buckets(reduced, 0.6)
    assert {tuple(r) for r in near_duplicates.stars(reduced, 0.6, 0.001, 3).collect()} == plain


def test_links(spark):
    texts = [t for t in _texts() if t]
    frame = spark.createDataFrame([*enumerate(texts), (900, texts[0])], "chunk_id long, content string")
    got = {r.id: r for r in near_duplicates.near_duplicate_links(frame, words=3, threshold=0.6).collect()}
    sets = [frozenset(s) for s in _sets([*texts, texts[0]], 3)]
    known = {s for s in sets if s}
    ids = [*range(len(texts)), 900]
    for i, s in zip(ids, sets, strict=True):
        if s:
            assert got[i].n_copies == sets.count(s) - 1
            assert got[i].n_links == sum(len(s & o) >= 0.6 * len(s | o) for o in known if o != s)


def test_signatures_estimate_similarity():
    a, b = np.arange(0, 2000), np.arange(500, 2500)
    rng = np.random.default_rng(1)
    names = rng.integers(0, 1 << 32, 2500, dtype=np.uint32)
    signs = near_duplicates.signatures(np.repeat([0, 1], 2000), np.concatenate([names[a], names[b]]), 2)
    assert abs((signs[0] == signs[1]).mean() - 0.6) < 0.2


def _brute(ids, vectors, k):
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order].astype(np.float64)
    found = {}
    for i in range(len(ids)):
        d = ((vectors - vectors[i]) ** 2).sum(1)
        d[i] = np.inf
        found[int(ids[i])] = set(ids[np.lexsort((ids, d))[:k]].tolist())
    return found


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    vectors = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 64)) * 0.2).astype(np.float32)
    vectors[:200] = vectors[0]
    ids = rng.permutation(5000)[:1500]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    bad = [(9001, None), (9002, []), (9003, [1.0] * 32), (9004, [0.0] * 64), (9005, [float("nan")] * 64), (9006, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (9007, [None] + [1.0] * 63)]
    frame = spark.createDataFrame(rows + rows[:5] + bad, "chunk_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in neighbours.nearest_neighbours(frame).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    true = _brute(ids, vectors, 10)
    assert set(got) == set(true) and all(len(v) == 10 for v in got.values())
    assert sum(len(got[i] & true[i]) for i in true) >= 0.97 * 10 * len(true)
    copies = {int(i) for i in ids[:200]}
    assert all(got[i] == true[i] for i in copies)


def test_dense_cells_have_parts_and_asked_regions_copies(spark, monkeypatch):
    for name, value in (("BLOCK", 100), ("LEAST_REGION", 150), ("MOST_CENTROIDS", 3), ("OCCUPANCY", 20)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(1400, 64)) * 0.01 + 5, rng.normal(size=(200, 64))]).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>")
    classes = frame.select(F.col("chunk_id").alias("rep"), F.col("embedding").alias("v"))
    index = neighbours.build_index(classes, 1600, 64, 400, 4)
    assert index.finer and index.sizes.sum() == 1600 and len(index.copies) == 4
    assert max(len(index.visited(v, *(h[0] for h in index.halves(v[None])), 400)) for v in vectors[:50]) < len(index.region_of)
    index.share(np.full(len(index.copies), 3))
    monkeypatch.setattr(neighbours, "build_index", lambda *a: index)
    got: dict[int, set] = {}
    for r in neighbours.nearest_neighbours(frame, candidates=1600).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    assert got == _brute(np.arange(1600), vectors, 10)


def test_few_neighbours(spark):
    frame = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (3, [1.0] * 64)], "chunk_id long, embedding array<float>")
    frame = frame.union(frame.sparkSession.createDataFrame([(3, [5.0] * 64)], frame.schema))
    got = {(r.chunk_id, r.neighbour_id) for r in neighbours.nearest_neighbours(frame).collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)}
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0 and neighbours.nearest_neighbours(frame.limit(1)).count() == 0
