"""Items that appear together: an external sort of packed 64-bit pair codes.

Items get 32-bit ids, so a pair is one 64-bit code. Each map task turns its baskets into codes and writes them
as sorted runs with run lengths; the shuffle moves runs to the partition of their code; Spark's external sort
merges (and spills) the runs there; one streaming pass adds the lengths of equal neighbours. A basket of up to BLOCK
items is one row; a larger one never is: its items are dealt out to blocks of about BLOCK items, each a row of its own,
and each pair of blocks is joined in the shuffle, so a basket of any size is spread over tasks. A frequent pair arrives
as one row per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, dense_ids, stored

#: Renamed paths up to which the map of newest paths is broadcast; it is counted first, and a larger one is joined by shuffle.
FEW_RENAMES = 100_000

#: Items of a basket that are one row; larger baskets become blocks of about as many.
BLOCK = 256
#: Ids of a slice of scopes that are coded together.
SLICE = 1 << 31
#: Codes that a map task sorts at once, 8 bytes each.
RUN = 2_000_000


def _codes(left: pa.ListArray, right: pa.ListArray) -> Iterator[np.ndarray]:
    """The pair codes of each row: all pairs within left where right is null, else all of left x right."""
    flat, offsets, lone = left.values.to_numpy(zero_copy_only=False), left.offsets.to_numpy(), np.asarray(right.is_null())
    lengths = np.diff(offsets)
    for m in np.unique(lengths[lone]):
        if m < 2:
            continue
        starts = offsets[:-1][lone & (lengths == m)]
        i, j = np.triu_indices(int(m), 1)
        step = max(1, RUN // len(i))
        for k in range(0, len(starts), step):
            block = flat[starts[k : k + step, None] + np.arange(m)]
            yield ((block[:, i] << 32) | block[:, j]).ravel()
    other, ends = right.values.to_numpy(zero_copy_only=False), right.offsets.to_numpy()
    for r in np.flatnonzero(~lone):
        a, b = flat[offsets[r] : offsets[r + 1]][:, None], other[ends[r] : ends[r + 1]][None, :]
        yield ((np.minimum(a, b) << 32) | np.maximum(a, b)).ravel()


def _run(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, length = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(length, pa.int32())], ["code", "length"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for codes in _codes(batch.column("left"), batch.column("right")):
            held.append(codes)
            size += len(codes)
            if size >= RUN:
                yield _run(held)
                held, size = [], 0
    if held:
        yield _run(held)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the lengths of equal neighbours in a sorted partition; the last code is held back over batch borders."""
    last, carried = None, 0
    for batch in batches:
        code, length = batch.column("code").to_numpy(), batch.column("length").to_numpy().astype(np.int64)
        if not len(code):
            continue
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        out, total = code[first], np.add.reduceat(length, first)
        if last is not None:
            if out[0] == last:
                total[0] += carried
            else:
                out, total = np.r_[last, out], np.r_[carried, total]
        last, carried = out[-1], total[-1]
        if len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(out[:-1], pa.int64()), pa.array(total[:-1], pa.int64())], ["code", "joint"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([carried], pa.int64())], ["code", "joint"])


def _counted(rows: DataFrame) -> DataFrame:
    """(left, right) -> (id_a, id_b, joint): the pairs within left where right is null, else those of left and right."""
    runs = rows.mapInArrow(_sorted_runs, "code long, length int")
    counted = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, joint long")
    return counted.select(F.shiftrightunsigned("code", 32).alias("id_a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b"), "joint")


def blocks_of(items: DataFrame) -> DataFrame:
    """(scope, basket, size, id) of large baskets -> (left, right): each block of a basket by itself and with each other one.

    size is at least the basket's number of items; an item's block follows from its id. Repeated rows count once.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = items.withColumns({"blocks": count, "block": F.pmod(F.xxhash64("id"), count).cast("int")})
    held = placed.groupBy("scope", "basket", "blocks", "block").agg(F.sort_array(F.collect_set("id")).alias("items"))
    alone = held.select(F.col("items").alias("left"), F.lit(None).cast("array<long>").alias("right"))
    i = held.filter("block < blocks - 1").select("scope", "basket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"), F.col("items").alias("left"))
    j = held.filter("block > 0").select("scope", "basket", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("items").alias("right"))
    return alone.unionByName(i.join(j, ["scope", "basket", "i", "j"]).select("left", "right"))


def items_together(records: DataFrame, scope: str, basket: str, item: str, *, min_item: int = 1, min_joint: int = 1) -> DataFrame:
    """Pairs of items of one scope with their joint count and its excess over chance.

    records: one row per (scope, basket, item); repeated rows count once; a basket counts for n also where its
    item is null. Rows whose scope or basket is null belong to nothing and are left out. min_item and min_joint are
    thresholds of the result: rarer items are removed before pairs are made, which loses no pair as joint <= count.
    -> (scope, item_a, item_b, n, n_a, n_b, joint, odds_ratio, lift, log_odds_error). odds_ratio has 0.5 added to
    each cell (the continuity correction), so it is finite when a cell is empty. An empty table gives no row.
    """
    records = records.select(F.col(scope).alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item")).filter("scope is not null and basket is not null")
    baskets = stored(records.groupBy("scope", "basket").agg(F.count("item").alias("size")))  # repeated rows make it no smaller
    n = baskets.groupBy("scope").agg(F.count("*").alias("n"))
    large = baskets.filter(F.col("size") > BLOCK)
    touched = records.filter("item is not null").distinct()
    items = dense_ids(touched.groupBy("scope", "item").agg(F.count("*").alias("n_item")).filter(F.col("n_item") >= max(min_item, min_joint)), ["scope", "item"], "id")
    # codes hold ids from the first scope of their slice on, so there may be any number of items, below 2^31 of one scope
    firsts = items.groupBy("scope").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    slices, most = firsts.agg(F.coalesce(F.floor(F.max("first") / SLICE) + 1, F.lit(0)), F.coalesce(F.max("held"), F.lit(0))).first()
    if most > SLICE:
        raise ValueError(f"a scope has {most} items; a pair code holds {SLICE}")
    many = large.count()
    few = F.broadcast(large) if many <= FEW_RENAMES else large
    ordinary = records.join(few.select("scope", "basket"), ["scope", "basket"], "left_anti") if many else records
    pairs = None
    for k in range(max(1, slices)):
        ids = items.select("scope", "item", "id")
        if slices > 1:
            ids = ids.join(firsts.filter(F.floor(F.col("first") / SLICE) == k).select("scope"), "scope").withColumn("id", F.col("id") - k * SLICE)
        # repeated rows fall away in collect_set, so the pair branch needs no distinct of its own
        small = ordinary.join(ids, ["scope", "item"]).groupBy("scope", "basket").agg(F.sort_array(F.collect_set("id")).alias("left"))
        rows = small.filter(F.size("left") > 1).select("left", F.lit(None).cast("array<long>").alias("right"))
        if many:
            rows = rows.unionByName(blocks_of(records.join(few, ["scope", "basket"]).join(ids, ["scope", "item"]).select("scope", "basket", "size", "id")))
        part = _counted(rows).select((F.col("id_a") + k * SLICE).alias("id_a"), (F.col("id_b") + k * SLICE).alias("id_b"), "joint")
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.filter(F.col("joint") >= min_joint)
    a = items.select("scope", F.col("id").alias("id_a"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = items.select(F.col("id").alias("id_b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    both = pairs.join(a, "id_a").join(b, "id_b").join(n, "scope")
    half = F.lit(0.5)
    cells = [F.col("joint") + half, F.col("n_a") - F.col("joint") + half, F.col("n_b") - F.col("joint") + half, F.col("n") - F.col("n_a") - F.col("n_b") + F.col("joint") + half]
    return both.select(
        "scope", "item_a", "item_b", "n", "n_a", "n_b", "joint",
        (cells[0] * cells[3] / (cells[1] * cells[2])).alias("odds_ratio"),
        (F.col("joint") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.sqrt(sum((F.lit(1.0) / c for c in cells), F.lit(0.0))).alias("log_odds_error"),
    )


def newest_paths(commits: DataFrame) -> DataFrame:
    """(repo_id, path, newest): each renamed path with the last path of its chain, by pointer doubling.

    Where a path was renamed to several, the latest commit's target counts. Paths on a cycle all get its least path.
    """
    edges = (
        commits.select("repo_id", "author_date", "seq", F.explode("files").alias("f"))
        .filter("repo_id is not null and f.old_path is not null and f.path is not null and f.old_path != f.path")
        .groupBy("repo_id", F.col("f.old_path").alias("path"))
        .agg(F.max_by("f.path", F.struct("author_date", "seq", "f.path")).alias("newest"))
    )
    links, steps = cut(edges.withColumn("low", F.col("path"))), 1
    total = links.count()
    while total:
        ahead = links.select("repo_id", F.col("path").alias("newest"), F.col("newest").alias("beyond"), F.col("low").alias("low_ahead"))
        joined = links.join(ahead, ["repo_id", "newest"], "left")
        if steps > total:  # whatever still has a link ahead leads into a cycle
            links = joined.select("repo_id", "path", F.coalesce("low_ahead", "newest").alias("newest"))
            break
        links = cut(joined.select("repo_id", "path", F.coalesce("beyond", "newest").alias("newest"), F.least("low", F.coalesce("low_ahead", "low")).alias("low"), F.col("beyond").isNotNull().alias("moved")))
        if not links.filter("moved").head(1):
            break
        links, steps = links.drop("moved"), steps * 2
    return links.select("repo_id", "path", "newest")


def file_pairs(commits: DataFrame, *, min_joint: int = 1) -> DataFrame:
    """items_together for the files of a repository's commits, each under its newest path."""
    newest = newest_paths(commits)
    if newest.count() <= FEW_RENAMES:
        newest = F.broadcast(newest)
    packed = F.when(F.col("hash").rlike("^([0-9a-f]{2})+$"), F.unhex("hash")).otherwise(F.encode("hash", "utf-8"))  # half the bytes to shuffle
    touched = commits.select("repo_id", packed.alias("hash"), F.explode_outer("files.path").alias("path")).join(newest, ["repo_id", "path"], "left")
    return items_together(touched.select("repo_id", "hash", F.coalesce("newest", "path").alias("path")), "repo_id", "hash", "path", min_joint=min_joint)
