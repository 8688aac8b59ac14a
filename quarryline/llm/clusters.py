"""Clusters of similar vectors: mergeable cluster-feature trees, reduced by Spark, and Ward agglomeration of leaves.

A cluster feature of unit vectors is (n, sum of vectors). Every task builds a tree over its part of the vectors: its
inner nodes are pivots from a bounded sample, the same in all tasks, so trees merge node by node; its leaves are
features. The leaves, not the vectors, are shuffled by node and agglomerated there, twice with different pivots, as a
node's border may cut a cluster. What is left are summaries of at least two vectors. They are merged across nodes by an
exact search of all summaries in blocks, and one full pass assigns every vector to its nearest summary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release, spread, stored

#: Cosine similarity of two features' centroids from which they may be one cluster, and of a vector to its cluster.
MERGE, ASSIGN = 0.8, 0.75
#: Least number of distinct keys of a cluster.
LEAST = 5
#: Leaves that a node is to hold on average; sampled vectors that pivots are drawn from at most; leaves that a task holds.
NODE_LEAVES, PIVOTS, HELD = 4_000, 2_000, 100_000
#: Centroids that are broadcast together.
BLOCK = 40_000


def unit_vectors(df: DataFrame, key: str, vector: str, model: str, size: int = 64) -> DataFrame:
    """(model, key, v): full valid vectors, made unit length. Null, short, long, zero, NaN and infinite ones are left out."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            kept = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False)))
            x = pc.list_flatten(column.take(pa.array(kept))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            units = (x[good] / norm[good, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, size), pa.int32()), pa.array(units.ravel()))
            rows = batch.take(pa.array(kept[good]))
            yield pa.RecordBatch.from_arrays([rows.column("model"), rows.column("key"), lists], ["model", "key", "v"])

    named = df.filter(F.col(key).isNotNull() & F.col(model).isNotNull()).select(F.col(model).alias("model"), F.col(key).alias("key"), F.col(vector).alias("v"))
    return spread(named).mapInArrow(whole, "model string, key string, v array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def _units(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


class Leaves:
    """The leaf features below one inner node."""

    def __init__(self, size: int) -> None:
        self.n, self.sums, self.used = np.zeros(16), np.zeros((16, size), np.float32), 0

    def insert(self, x: np.ndarray) -> None:
        """Adds unit vectors: each to its most similar leaf if that is near enough, else to a new one."""
        if self.used:
            near = x @ _units(self.sums[: self.used]).T
            leaf, fits = near.argmax(1), near.max(1) >= MERGE
            np.add.at(self.sums, leaf[fits], x[fits])
            np.add.at(self.n, leaf[fits], 1)
            x = x[~fits]
        while len(x):
            if self.used == len(self.n):
                self.n, self.sums = np.r_[self.n, np.zeros(len(self.n))], np.r_[self.sums, np.zeros_like(self.sums)]
            joins = x @ x[0] >= MERGE
            joins[0] = True
            self.sums[self.used], self.n[self.used] = x[joins].sum(0), joins.sum()
            self.used += 1
            x = x[~joins]


def _tree(pivots: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes: dict[tuple[str, int], Leaves] = {}

    def leaves() -> pa.RecordBatch:
        rows = [(m, float(n), s) for (m, _), leaf in nodes.items() for n, s in zip(leaf.n[: leaf.used], leaf.sums[: leaf.used])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["model", "n", "sums"])

    for batch in batches:
        if not batch.num_rows:
            continue
        models, x = np.array(batch.column("model").to_pylist()), _matrix(batch.column("v"))
        for m in np.unique(models):
            own = x[models == m]
            node = _node(own, pivots.get(m))
            for k in np.unique(node):
                nodes.setdefault((m, int(k)), Leaves(own.shape[1])).insert(own[node == k])
        if sum(leaf.used for leaf in nodes.values()) > HELD:
            yield leaves()
            nodes.clear()
    if nodes:
        yield leaves()


def ward(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Agglomerates features by Ward's distance, reciprocal nearest neighbours at once, while centroids are near enough."""
    while len(n) > 1:
        centroids, length = _units(sums), (sums / n[:, None])
        square = (length * length).sum(1)
        best, which = np.full(len(n), np.inf), np.full(len(n), -1)
        for k in range(0, len(n), 1024):
            part = slice(k, k + 1024)
            near = centroids[part] @ centroids.T >= MERGE
            near[np.arange(near.shape[0]), np.arange(k, k + near.shape[0])] = False
            distance = np.where(near, (square[part, None] + square[None] - 2 * length[part] @ length.T) * (n[part, None] * n[None] / (n[part, None] + n[None])), np.inf)
            which[part], best[part] = distance.argmin(1), distance.min(1)
        which[~np.isfinite(best)] = -1
        a = np.arange(len(n))
        pairs = (which >= 0) & (a < which)
        pairs[pairs] = which[which[a[pairs]]] >= 0
        pairs[pairs] = which[which[a[pairs]]] == a[pairs]
        if not pairs.any():
            # ties may form no reciprocal pair: then the nearest pair of all is merged
            if not np.isfinite(best).any():
                break
            k = int(best.argmin())
            pairs, which[k] = np.zeros(len(n), bool), which[k]
            pairs[k] = True
        left, right = a[pairs], which[pairs]
        n, sums = n.copy(), sums.copy()
        n[left] += n[right]
        sums[left] += sums[right]
        kept = np.ones(len(n), bool)
        kept[right] = False
        n, sums = n[kept], sums[kept]
    return n, sums


def _pivots(vectors: DataFrame, total: int) -> list[dict[str, np.ndarray]]:
    """Two sets of at most about PIVOTS sampled vectors; any pivots give a right tree, better ones a faster one."""
    count = max(1, min(PIVOTS, math.ceil(total / NODE_LEAVES)))
    chosen = [F.pmod(F.xxhash64("key", "v", F.lit(seed)), F.lit(max(1, total // count))) == 0 for seed in (1, 2)]
    held: list[dict[str, list]] = [{}, {}]
    for model, v, *sets in vectors.select("model", "v", *(c.alias(f"set{k}") for k, c in enumerate(chosen))).filter("set0 or set1").collect():
        for k in (0, 1):
            if sets[k]:
                held[k].setdefault(model, []).append(v)
    return [{m: np.array(v, np.float32) for m, v in h.items()} for h in held]


def _node(x: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """The most similar pivot; a model too small for a pivot is one node."""
    return np.zeros(len(x), np.int32) if pivots is None else (x @ pivots.T).argmax(1).astype(np.int32)


def _sides(x: np.ndarray, pivot: np.ndarray | None, bits: int, seed: int) -> np.ndarray:
    """A part of a heavy node: on which sides of random planes through its pivot a vector lies."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits)).astype(np.float32)
    return ((x if pivot is None else x - pivot) @ planes > 0) @ (1 << np.arange(bits))


def _agglomerated(features: DataFrame, pivots: dict[str, np.ndarray], least: int, seed: int = 0) -> DataFrame:
    """Features are shuffled by node and agglomerated there. A node with more than NODE_LEAVES features is split into
    parts by random planes, so no group grows with the data though the number of pivots is bounded."""

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, x = np.array(batch.column("model").to_pylist()), _matrix(batch.column("sums")) if batch.num_rows else None
            out = np.zeros(batch.num_rows, np.int32)
            for m in np.unique(models):
                out[models == m] = _node(x[models == m], pivots.get(m))
            yield batch.append_column("node", pa.array(out))

    placed = stored(features.mapInArrow(node, "model string, n double, sums array<float>, node int"))
    # at most two rows for each pivot reach the driver
    heavy = {(r["model"], r["node"]): math.ceil(math.log2(r["count"] / NODE_LEAVES)) for r in placed.groupBy("model", "node").count().filter(F.col("count") > NODE_LEAVES).collect()}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, models, out = batch.column("node").to_numpy(), batch.column("model").to_pylist(), np.zeros(batch.num_rows, np.int64)
            for m, k in {*zip(models, nodes.tolist())} & {*heavy}:
                at = np.flatnonzero((nodes == k) & (np.array(models) == m))
                own = pivots.get(m)
                out[at] = _sides(_units(_matrix(batch.column("sums").take(pa.array(at)))), None if own is None else own[k], heavy[m, k], 1000 * seed + k)
            yield batch.append_column("part", pa.array(out))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sums = pdf.n.to_numpy(), np.stack(pdf.sums.to_numpy()).astype(np.float64)
        order = np.lexsort([*sums.T[:3], -n])  # the same result in whatever order rows arrive
        n, sums = n[order], sums[order]
        done = [ward(n[k : k + 2 * NODE_LEAVES], sums[k : k + 2 * NODE_LEAVES]) for k in range(0, len(n), 2 * NODE_LEAVES)]
        n, sums = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        if len(done) > 1 and len(n) <= 2 * NODE_LEAVES:
            n, sums = ward(n, sums)  # beyond that, what is left is united by the exact search of all summaries
        keep = n >= least
        return pd.DataFrame({"model": pdf.model.iloc[0], "n": n[keep], "sums": pd.Series(list(sums[keep].astype(np.float32)), dtype=object)})

    parts = placed.mapInArrow(part, "model string, n double, sums array<float>, node int, part long") if heavy else placed.withColumn("part", F.lit(0).cast("long"))
    return parts.groupBy("model", "node", "part").applyInPandas(merged, "model string, n double, sums array<float>")


def _nearest(vectors: DataFrame, centroids: DataFrame, total: int, columns: str, larger: bool) -> DataFrame:
    """Each row with its most similar centroid (id, similarity) of its model, or with its largest near one; of equal ones the least id.

    Centroids are broadcast in blocks of at most BLOCK; a pass over the rows for each keeps the best so far.
    """
    blocks = max(1, math.ceil(total / BLOCK))
    rows = vectors.withColumns({"near": F.lit(None).cast("long"), "score": F.lit(-2.0), "similarity": F.lit(-2.0)})
    schema = f"{columns}, near long, score double, similarity double"
    for k in range(blocks):
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        collected: dict[str, list] = {}
        for model, cid, n, sums in centroids.filter(F.pmod("id", F.lit(blocks)) == k).select("model", "id", "n", "sums").collect():
            collected.setdefault(model, []).append((cid, n, sums))
        for model, c in collected.items():
            c.sort()
            held[model] = (np.array([x[0] for x in c]), np.array([x[1] for x in c]), _units(np.array([x[2] for x in c], np.float32)))
        sent = vectors.sparkSession.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                models, x = np.array(batch.column("model").to_pylist()), _units(_matrix(batch.column("v")))
                near = pc.fill_null(batch.column("near"), -1).to_numpy(zero_copy_only=False).copy()
                score, similarity = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("score", "similarity"))
                for m in np.unique(models):
                    if m not in sent.value:
                        continue
                    ids, n, c = sent.value[m]
                    at = np.flatnonzero(models == m)
                    for lo in range(0, len(at), 128):
                        part = at[lo : lo + 128]
                        s = x[part] @ c.T
                        rank = np.where(s >= MERGE, n[None], -1.0) if larger else s
                        best = rank.argmax(1)  # ids are sorted: of equal ranks the least id
                        value = rank[np.arange(len(part)), best]
                        better = (value > score[part]) | (value == score[part]) & (ids[best] < near[part])
                        better &= value >= 0 if larger else True
                        near[part[better]], score[part[better]] = ids[best[better]], value[better]
                        similarity[part[better]] = s[np.arange(len(part)), best][better]
                out = [batch.column(c) for c in batch.schema.names if c not in ("near", "score", "similarity")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(near, pa.int64(), mask=near < 0), pa.array(score), pa.array(similarity)], schema=batch.schema)

        rows = rows.mapInArrow(search, schema)
    return rows


def _united(features: DataFrame) -> tuple[DataFrame, int]:
    """Summaries merged across nodes: each joins the largest near one, which is followed to its end; what joined is added up, until nothing joins. -> (features with id, count)"""
    old: tuple[DataFrame, ...] = ()
    while True:
        numbered = stored(features.select("model", F.monotonically_increasing_id().alias("id"), "n", "sums"))
        release(*old)
        total = numbered.count()
        if not total:
            return numbered, total
        near = _nearest(numbered.select("model", "id", "n", F.col("sums").alias("v")), numbered, total, "model string, id long, n double, v array<float>", larger=True)
        roots = stored(near.select("id", F.coalesce("near", "id").alias("root")))
        if not roots.filter("id != root").head(1):
            return numbered, total
        while True:
            onward = roots.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
            moved = stored(roots.join(onward, "root").select("id", F.col("beyond").alias("root"), (F.col("root") != F.col("beyond")).alias("moved")))
            release(roots)
            roots = moved
            if not moved.filter("moved").head(1):
                break
        old = numbered, roots
        points = numbered.join(roots.select("id", "root"), "id")
        values = points.select("model", "root", "n", F.posexplode("sums").alias("at", "x")).groupBy("model", "root", "at").agg(F.sum("x").alias("x"))
        sums = values.groupBy("model", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"].cast("float")).alias("sums"))
        features = sums.join(points.groupBy("root").agg(F.sum("n").alias("n")), "root").select("model", "n", "sums")


def cluster_vectors(df: DataFrame, key: str, vector: str, model: str, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, centroids): (model, cluster, key, similarity), one row per distinct key in a cluster, and (model, cluster, n, sums).

    Clusters have at least LEAST distinct keys; other keys have no row. Repeated rows count once. A key with several
    vectors in one model belongs to the cluster of the most similar. An empty table gives none.
    """
    vectors = stored(unit_vectors(df, key, vector, model, size).dropDuplicates(["model", "key", "v"]))
    pivots = _pivots(vectors, vectors.count())
    leaves = vectors.select("model", "v").mapInArrow(lambda batches: _tree(pivots[0], batches), "model string, n double, sums array<float>")
    features = _agglomerated(_agglomerated(leaves, pivots[0], 1), pivots[1], 2, seed=1)
    centroids, count = _united(features)
    assigned = _nearest(vectors, centroids, count, "model string, key string, v array<float>", larger=False)
    near = assigned.filter(F.col("similarity") >= ASSIGN).select("model", "key", F.col("near").alias("cluster"), "similarity")
    distinct = stored(near.groupBy("model", "key").agg(F.max_by("cluster", F.struct("similarity", "cluster")).alias("cluster"), F.max("similarity").alias("similarity")))
    kept = distinct.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") >= LEAST)
    return distinct.join(kept, "cluster").select("model", "cluster", "key", "similarity", "size"), centroids.withColumnRenamed("id", "cluster")


def sorted_neighbours(members: DataFrame) -> DataFrame:
    """(key_a, key_b): keys that follow each other when each cluster's keys are sorted.

    The rows are range-partitioned and sorted, so a cluster of any size is spread over tasks; where two partitions
    meet, the last and the first row of each (two rows per partition on the driver) close the gap.
    """
    ranged = cut(members.select("cluster", "key").repartitionByRange("cluster", "key").sortWithinPartitions("cluster", "key"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            cluster, keys = batch.column("cluster").to_pylist(), batch.column("key").to_pylist()
            a, b = [], []
            for row in zip(cluster, keys):
                if row[0] == last[0]:
                    a.append(last[1]), b.append(row[1])
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["key_a", "key_b"])

    ends = ranged.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("cluster", "key")).alias("first"), F.max(F.struct("cluster", "key")).alias("last")).orderBy("at").collect()
    gaps = [(p["last"]["key"], q["first"]["key"]) for p, q in zip(ends, ends[1:]) if p["last"]["cluster"] == q["first"]["cluster"]]
    pairs = ranged.mapInArrow(follow, "key_a string, key_b string")
    return pairs.unionByName(members.sparkSession.createDataFrame(gaps, "key_a string, key_b string"))


def describe(members: DataFrame, centroids: DataFrame, earlier: DataFrame, typical: int = 5) -> DataFrame:
    """(model, cluster, size, mean_similarity, typical, earlier_cluster, earlier_similarity) for each cluster.

    typical: its most central keys. earlier: (cluster_id, centroid, model) of an earlier run; the most similar valid
    centroid of the model is named, or null.
    """
    rank = "row_number() over (partition by cluster{} order by similarity desc, key)"
    few = members.withColumn("r", F.expr(rank.format(", pmod(hash(key), 64)"))).filter(F.col("r") <= typical)
    few = few.withColumn("r", F.expr(rank.format(""))).filter(F.col("r") <= typical)
    central = few.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("typical"))
    sizes = members.groupBy("model", "cluster").agg(F.count("*").alias("size"), F.avg("similarity").alias("mean_similarity"))
    old = unit_vectors(earlier.withColumn("_id", F.col("cluster_id").cast("string")), "_id", "centroid", "model").dropDuplicates(["model", "key"])
    numbered = stored(old.select("model", F.col("key").cast("long").alias("id"), F.lit(1.0).alias("n"), F.col("v").alias("sums")))
    mine = centroids.join(sizes.select("cluster"), "cluster", "left_semi").select("model", F.col("cluster").cast("string").alias("key"), F.col("sums").alias("v"))
    compared = _nearest(mine, numbered, numbered.count(), "model string, key string, v array<float>", larger=False)
    compared = compared.select(F.col("key").cast("long").alias("cluster"), F.col("near").alias("earlier_cluster"), F.when(F.col("near").isNotNull(), F.col("similarity")).alias("earlier_similarity"))
    return sizes.join(central, "cluster").join(compared, "cluster", "left")
