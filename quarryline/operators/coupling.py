"""Files that change together: weighted association rules, hubs, edges, and implicit modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import decay, strength
from ..runtime import dense_ids, release, stored
from .commits import current

MOST_FILES, MIN_SHARED, MIN_CONFIDENCE, MIN_LIFT, HUB_DEGREE = 50, 3.0, 0.25, 1.5, 3


def coupling(
    commits: DataFrame, reference: str, half_life_days: float = 180.0, *, renames: DataFrame | None = None, most_files: int = MOST_FILES, min_shared: float = MIN_SHARED, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT
) -> DataFrame:
    """(repo_id, file_a, file_b, shared, confidence_ab, confidence_ba, lift, strength), file_a < file_b.

    Commits weigh by their age. Those that touch more than most_files files are left out, which bounds the pairs of one
    commit. renames: (repo_id, old_path, path) puts paths under their later name. The pairs of a commit are made within
    its row, and weights are added up before the shuffle.
    """
    c = current(commits, "author_date", "files").filter("author_date is not null")
    c = c.select("repo_id", "hash", decay(F.col("author_date"), F.lit(reference).cast("timestamp"), half_life_days).alias("w"), F.array_sort(F.array_distinct(F.filter(F.transform("files", lambda f: f["path"]), lambda p: p.isNotNull()))).alias("paths"))
    if renames is not None:
        named = c.select("repo_id", "hash", "w", F.explode("paths").alias("old_path")).join(renames, ["repo_id", "old_path"], "left")
        c = named.groupBy("repo_id", "hash", "w").agg(F.sort_array(F.collect_set(F.coalesce("path", "old_path"))).alias("paths"))
    c = c.filter(F.size("paths").between(1, most_files))
    total = c.groupBy("repo_id").agg(F.sum("w").cast("double").alias("total"))
    single = c.select("repo_id", "w", F.explode("paths").alias("path")).groupBy("repo_id", "path").agg(F.sum("w").cast("double").alias("weight"))
    second = F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, F.size("paths")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b"))))
    pairs = c.filter(F.size("paths") > 1).select("repo_id", "w", F.inline(F.flatten(second))).groupBy("repo_id", "file_a", "file_b").agg(F.sum("w").cast("double").alias("shared")).filter(F.col("shared") >= min_shared)
    a, b = (single.select("repo_id", F.col("path").alias(f"file_{k}"), F.col("weight").alias(f"weight_{k}")) for k in "ab")
    full = pairs.join(a, ["repo_id", "file_a"]).join(b, ["repo_id", "file_b"]).join(total, "repo_id")
    ab, ba = F.col("shared") / F.col("weight_a"), F.col("shared") / F.col("weight_b")
    lift = (F.col("shared") / F.col("total")) / ((F.col("weight_a") / F.col("total")) * (F.col("weight_b") / F.col("total")))
    full = full.select("repo_id", "file_a", "file_b", "shared", ab.alias("ab"), ba.alias("ba"), lift.alias("lift")).filter((F.greatest("ab", "ba") >= min_confidence) & (F.col("lift") >= min_lift))
    return full.select(
        "repo_id", "file_a", "file_b", F.round("shared", 4).alias("shared"), F.round("ab", 4).alias("confidence_ab"), F.round("ba", 4).alias("confidence_ba"), F.round("lift", 4).alias("lift"),
        F.round(strength(F.col("shared"), F.greatest("ab", "ba"), F.col("lift")), 4).alias("strength"),
    )


def hubs(pairs: DataFrame) -> DataFrame:
    """(repo_id, path, coupled_files, weight): files coupled with at least three others."""
    ends = pairs.select("repo_id", F.explode(F.array("file_a", "file_b")).alias("path"), F.col("shared").cast("decimal(18,4)").alias("shared"))
    return ends.groupBy("repo_id", "path").agg(F.count("*").alias("coupled_files"), F.sum("shared").cast("double").alias("weight")).filter(F.col("coupled_files") >= HUB_DEGREE)


def file_edges(pairs: DataFrame) -> DataFrame:
    """(repo_id, src, dst, edge_type, score, reason): each pair in both directions."""
    reason = F.concat(F.lit("co-change ("), F.floor(F.greatest("confidence_ab", "confidence_ba") * 100 + 0.5).cast("string"), F.lit("% of relevant commits)"))
    both = [pairs.select("repo_id", F.col(x).alias("src"), F.col(y).alias("dst"), F.lit("cochange").alias("edge_type"), F.col("strength").alias("score"), reason.alias("reason")) for x, y in (("file_a", "file_b"), ("file_b", "file_a"))]
    return both[0].unionByName(both[1])


def related_files(edges: DataFrame, files: list[str], per_file: int = 5) -> DataFrame:
    """(repo_id, path, score): the strongest neighbours of the given files, at most per_file of each, the best score of each."""
    asked = edges.filter(F.col("src").isin(files))
    top = asked.withColumn("r", F.expr("row_number() over (partition by repo_id, src order by score desc, dst)")).filter(F.col("r") <= per_file)
    return top.filter(~F.col("dst").isin(files)).groupBy("repo_id", F.col("dst").alias("path")).agg(F.max("score").alias("score"))


def modules(pairs: DataFrame) -> DataFrame:
    """(repo_id, module, path): communities of the co-change graph, by weighted label propagation in Spark.

    Every file starts as its own module. A file wants the label with the largest sum of shared weight among its
    neighbours (the least of equal ones), if that is more than its own label has. In each round those move that come
    first, by a hash that changes with the round, among their neighbours that want to go elsewhere: so each move adds to
    the weight inside modules, and it ends without a bound on rounds. Methods that need a global order of moves fit no
    shuffle; this one is local. Modules are named by their least file.
    """
    ends = [pairs.select("repo_id", F.col(a).alias("s"), F.col(b).alias("d"), F.col("shared").cast("decimal(18,4)").alias("shared")) for a, b in (("file_a", "file_b"), ("file_b", "file_a"))]
    edges = stored(ends[0].unionByName(ends[1]))
    labels, k = stored(edges.select("repo_id", F.col("s").alias("path")).distinct().withColumn("label", F.col("path"))), 0
    while True:
        near = edges.join(labels.select("repo_id", F.col("path").alias("d"), "label"), ["repo_id", "d"]).groupBy("repo_id", F.col("s").alias("path"), "label").agg(F.sum("shared").alias("w"))
        own = labels.select("repo_id", "path", F.col("label").alias("mine"))
        sums = near.join(own, ["repo_id", "path"]).groupBy("repo_id", "path").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"), F.max(F.when(F.col("label") == F.col("mine"), F.col("w"))).alias("kept"))
        turn = F.struct(F.md5(F.concat("path", F.lit(f"|{k}"))).alias("h"), "path")
        wish = stored(sums.filter(-F.col("best.w") > F.coalesce("kept", F.lit(0))).select("repo_id", "path", F.col("best.label").alias("label"), turn.alias("turn")))
        if not wish.head(1):
            release(edges, wish)
            break
        other = edges.join(wish.select("repo_id", F.col("path").alias("d"), F.col("label").alias("away"), F.col("turn").alias("rival")), ["repo_id", "d"])
        first = other.join(wish.withColumnRenamed("path", "s"), ["repo_id", "s"]).filter("away != label").groupBy("repo_id", F.col("s").alias("path")).agg(F.min("rival").alias("rival"))
        move = wish.join(first, ["repo_id", "path"], "left").filter("rival is null or turn < rival").select("repo_id", "path", F.col("label").alias("next"))
        moved = stored(labels.join(move, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("next", "label").alias("label")))
        release(labels, wish)
        labels, k = moved, k + 1
    named = labels.groupBy("repo_id", "label").agg(F.min("path").alias("module"))
    return labels.join(named, ["repo_id", "label"]).select("repo_id", "module", "path")


def module_sizes(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo_id, module_id, module, files, internal_coupling_avg): a repository's modules numbered from 0, the largest first.

    internal_coupling_avg is the mean strength of the pairs within a module, 0 without any.
    """
    a, b = (found.select("repo_id", F.col("path").alias(f"file_{k}"), F.col("module").alias(f"module_{k}")) for k in "ab")
    inside = pairs.join(a, ["repo_id", "file_a"]).join(b, ["repo_id", "file_b"]).filter("module_a = module_b")
    mean = inside.groupBy("repo_id", F.col("module_a").alias("module")).agg((F.sum(F.col("strength").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean"))
    sizes = found.groupBy("repo_id", "module").agg(F.count("*").alias("files")).withColumn("_o", -F.col("files"))
    numbered = dense_ids(sizes, ["repo_id", "_o", "module"], "n").drop("_o")
    first = numbered.groupBy("repo_id").agg(F.min("n").alias("first"))
    rows = numbered.join(first, "repo_id").join(mean, ["repo_id", "module"], "left")
    return rows.select("repo_id", (F.col("n") - F.col("first")).alias("module_id"), "module", "files", F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("internal_coupling_avg"))
