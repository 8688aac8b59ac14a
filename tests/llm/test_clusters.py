import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import clusters as C

SCHEMA = "vector_key string, vector array<float>, model string"


def planted(seed, sizes, noise, model, size=64):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for c, n in enumerate(sizes):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for k in range(n):
            v = centre + rng.normal(size=size) * rng.uniform(0.01, 0.05)
            key = f"{model}-{rng.integers(1 << 40):010x}-{c}"
            truth.setdefault(c, []).append(key)
            rows.append((key, (v * rng.uniform(0.4, 3)).astype(float).tolist(), model))
    rows += [(f"{model}-noise-{k}", rng.normal(size=size).tolist(), model) for k in range(noise)]
    return rows, [sorted(keys) for keys in truth.values() if len(keys) >= 5]


def bad_rows():
    return [("null", None, "a"), ("short", [1.0] * 10, "a"), ("zero", [0.0] * 64, "a"), ("nan", [float("nan")] * 64, "a"), ("inf", [float("inf")] * 64, "a"), ("hole", [1.0] * 63 + [None], "a"), (None, [1.0] * 64, "a"), ("nomodel", [1.0] * 64, None)]


@pytest.mark.parametrize("nodes", [4_000, 40])
def test_planted(spark, monkeypatch, nodes):
    monkeypatch.setattr(C, "NODE_LEAVES", nodes)  # with few leaves a node, clusters are cut by the borders of nodes
    a, truth_a = planted(1, [5, 6, 30, 200, 3, 4], 60, "a")
    b, truth_b = planted(1, [5, 12], 10, "b")  # the same vectors in another model
    rows = a + b + a[:40] + bad_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("key", "v", "node", "cluster", "n")})
    members, centroids = C.cluster_vectors(df, "vector_key", "vector", "model")
    found: dict = {}
    for r in members.collect():
        found.setdefault(r.cluster, []).append(r.key)
    assert sorted(sorted(k) for k in found.values()) == sorted(truth_a + truth_b)
    pairs = {tuple(r) for r in C.sorted_neighbours(members).collect()}
    assert pairs == {p for keys in truth_a + truth_b for p in zip(keys, keys[1:])}
    earlier = spark.createDataFrame([(1, [float(x) for x in a[30][1]], "a"), (2, None, "a")], "cluster_id long, centroid array<double>, model string")
    described = C.describe(members, centroids, earlier).collect()
    assert sorted(r["size"] for r in described) == sorted(map(len, truth_a + truth_b)) and all(1 <= len(r.typical) <= 5 for r in described)
    assert all((r.earlier_cluster == 1) == (r.model == "a") for r in described)


def test_ward_merges_to_groups():
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    sums = np.concatenate([c + 0.02 * rng.normal(size=(n, 64)) for c, n in zip(centres, (7, 1, 20, 2))])
    n, merged = C.ward(np.ones(len(sums)), sums)
    assert sorted(n) == [1, 2, 7, 20] and merged.sum(0) == pytest.approx(sums.sum(0))
    assert len(C.ward(np.ones(6), np.repeat(centres[:1], 6, 0))[0]) == 1  # ties


def test_empty(spark):
    members, _ = C.cluster_vectors(spark.createDataFrame([], SCHEMA), "vector_key", "vector", "model")
    assert members.count() == 0 and C.sorted_neighbours(members).count() == 0
    members, _ = C.cluster_vectors(spark.createDataFrame(bad_rows(), SCHEMA), "vector_key", "vector", "model")
    assert members.count() == 0


def test_chains_of_summaries_are_followed_to_their_end(spark):
    vectors = [[float(np.cos(k * 0.6)), float(np.sin(k * 0.6))] for k in range(5)]  # each is near to the next one only
    rows = [("a", 2.0 + k, [x * (2 + k) for x in v]) for k, v in enumerate(vectors)] + [("b", 2.0, [2.0, 0.0])]
    united, count = C._united(spark.createDataFrame(rows, "model string, n double, sums array<float>"))
    assert count == 2 and sorted((r.model, r.n) for r in united.collect()) == [("a", 20.0), ("b", 2.0)]


def test_repeated_rows_count_once(spark):
    rows, _ = planted(3, [6], 1, "a")
    members, centroids = C.cluster_vectors(spark.createDataFrame(rows * 3, SCHEMA).repartition(3), "vector_key", "vector", "model")
    assert members.count() == 6 and [r.n for r in centroids.collect()] == [6.0]


def test_pivots_are_few_though_all_rows_have_one_key(spark, monkeypatch):
    monkeypatch.setattr(C, "NODE_LEAVES", 100)
    vectors = spark.range(3_000).select(F.lit("a").alias("model"), F.lit("k").alias("key"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    assert all(5 < len(held["a"]) < 100 for held in C._pivots(vectors, 3_000))


def test_the_largest_near_summary_wins_whatever_the_ids(spark):
    """Ids of a late partition are large; a summary that isn't near must not win for them, and a larger one must."""
    late = 400 << 33
    rows = [("a", late, 2.0, [1.0, 0.0, 0.0]), ("a", late + 1, 3.0, [0.9, 0.1, 0.0]), ("a", late + 2, 900.0, [0.0, 0.0, 1.0]), ("a", late + 3, 3.0, [0.9, 0.1, 0.01]), ("a", (900 << 33) + 7, 2.0, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "model string, id long, n double, sums array<float>")
    for block in (40_000, 1):
        C.BLOCK, kept = block, C.BLOCK
        try:
            near = C._nearest(df.select("model", "id", F.col("sums").alias("v")), df, 5, "model string, id long, v array<float>", larger=True)
            assert {r.id - late: r.near - late for r in near.collect()} == {0: 1, 1: 1, 2: 2, 3: 1, (500 << 33) + 7: (500 << 33) + 7}
        finally:
            C.BLOCK = kept


def test_heavy_nodes_are_split(spark, monkeypatch):
    """All vectors near one pivot: the node is agglomerated in parts of bounded size, and clusters still come out whole."""
    monkeypatch.setattr(C, "NODE_LEAVES", 40)
    monkeypatch.setattr(C, "_pivots", lambda vectors, total: [{}, {}])
    rows, truth = planted(5, [40, 60, 9, 30, 5, 8] * 6, 300, "a")
    members, _ = C.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), "vector_key", "vector", "model")
    found: dict = {}
    for r in members.collect():
        found.setdefault(r.cluster, []).append(r.key)
    assert sorted(sorted(k) for k in found.values()) == sorted(truth)
    x = C._units(np.random.default_rng(2).normal(size=(4000, 64)).astype(np.float32))
    assert max(np.bincount(C._sides(x, None, 4, 7))) < 600
