"""Operators over review comments: reading pull requests, filters, categories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .vectors import centroids

# Categories of a comment.
CATEGORIES = ("bug", "security", "performance", "architecture", "convention", "nitpick", "question", "praise")

# number is a bigint: what stands in for it may be a key beyond the range of int.
PULL_REQUEST = """
number bigint, title string, mergedAt string, author struct<login:string>,
reviewThreads struct<nodes:array<struct<isResolved:boolean, path:string, line:int, comments:struct<nodes:array<struct<body:string, author:struct<login:string>, createdAt:string, diffHunk:string>>>>>>,
reviews struct<nodes:array<struct<state:string, author:struct<login:string>, body:string, submittedAt:string>>>,
comments struct<nodes:array<struct<body:string, author:struct<login:string>, createdAt:string>>>
"""


def current_comments(comments: DataFrame) -> DataFrame:
    """Each distinct comment once; redelivered rows have equal content."""
    return comments.filter("comment_id is not null").dropDuplicates(["comment_id"])


def worth_reading(comments: DataFrame) -> DataFrame:
    """Without trivial comments and those of machines."""
    return comments.filter(F.col("body").isNotNull() & ~T.is_trivial(F.col("body")) & ~T.is_machine(F.coalesce("author", F.lit("ghost"))))


def _moment(column: Column) -> Column:
    return F.coalesce(F.to_timestamp(F.nullif(column, F.lit(""))), F.timestamp_seconds(F.lit(0)))


def flatten_pull_requests(nodes: DataFrame) -> DataFrame:
    """Comments of pull requests: first comments of threads with their replies, review texts, and later remarks.

    Trivial ones are left out; in threads only the first comment is judged, and its replies are kept. Remarks in the
    conversation carry all later ones of people as replies; those of machines are left out.
    """
    thread = nodes.select("number", F.explode("reviewThreads.nodes").alias("t")).withColumn("c", F.col("t.comments.nodes")).filter(F.size("c") > 0)
    first = F.col("c")[0]
    threads = thread.filter(~T.is_trivial(F.coalesce(first["body"], F.lit("")))).select(
        F.col("number").alias("pr_number"), F.col("t.path").alias("file_path"), F.col("t.line").alias("line"), first["body"].alias("body"), F.coalesce(first["author"]["login"], F.lit("ghost")).alias("author"), _moment(first["createdAt"]).alias("created_at"),
        F.col("t.isResolved").alias("is_resolved"), first["diffHunk"].alias("diff_context"), F.transform(F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda x: x["body"]).alias("thread_comments"), F.lit(None).cast("string").alias("review_state"),
    )
    none = {"file_path": "string", "line": "int", "is_resolved": "boolean", "diff_context": "string"}
    blank = {k: F.lit(None).cast(v) for k, v in none.items()}
    empty = F.array().cast("array<string>")
    review = nodes.select("number", F.explode("reviews.nodes").alias("r")).filter(F.col("r.body").isNotNull() & (F.col("r.body") != "") & ~T.is_trivial(F.col("r.body")))
    reviews = review.select(F.col("number").alias("pr_number"), F.col("r.body").alias("body"), F.coalesce("r.author.login", F.lit("ghost")).alias("author"), _moment(F.col("r.submittedAt")).alias("created_at"), F.col("r.state").alias("review_state"), empty.alias("thread_comments")).withColumns(blank)
    remark = nodes.select("number", F.posexplode("comments.nodes").alias("k", "m")).withColumn("author", F.coalesce("m.author.login", F.lit("ghost"))).filter(~T.is_machine(F.col("author")))
    # the interface returns at most 30 remarks of a request, so a window holds few rows
    after = F.collect_list(F.when(F.coalesce("m.body", F.lit("")) != "", F.col("m.body"))).over(W.partitionBy("number").orderBy("k").rowsBetween(1, W.unboundedFollowing))
    remarks = remark.withColumn("thread_comments", after).filter(F.col("m.body").isNotNull() & ~T.is_trivial(F.col("m.body")))
    remarks = remarks.select(F.col("number").alias("pr_number"), F.col("m.body").alias("body"), "author", _moment(F.col("m.createdAt")).alias("created_at"), F.lit(None).cast("string").alias("review_state"), "thread_comments").withColumns(blank)
    return threads.unionByName(reviews).unionByName(remarks)


def parse_response(raw: Column) -> tuple[Column, Column]:
    """(categories, confidence) of a provider's answer: known categories in order; [question] and 0.0 without any."""
    found = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"<category>\s*(\w+)\s*</category>"), F.lit(1)), lambda c: F.lower(c)), lambda c: c.isin(*CATEGORIES))
    number = F.regexp_extract(raw, r"<confidence>\s*(-?[\d.]+)\s*</confidence>", 1).try_cast("double")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.5))))
    some = F.coalesce(F.size(found), F.lit(0)) > 0
    return F.when(some, found).otherwise(F.array(F.lit("question"))), F.when(some, confidence).otherwise(0.0)


def with_provider(texts: DataFrame, column: str, provider: Callable[[list[str]], list[str]], out: str) -> DataFrame:
    """Adds the provider's answer for each text, in batches; a batch that fails is asked one by one, a failed text is null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in texts.schema)}, `{out}` string"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(text: str) -> str | None:
            try:
                return provider([text])[0]
            except Exception:  # noqa: BLE001
                return None

        for batch in batches:
            values = ["" if v is None else v for v in batch.column(column).to_pylist()]
            try:
                answers = provider(values)
            except Exception:  # noqa: BLE001
                answers = [one(v) for v in values]
            yield batch.append_column(out, pa.array(answers, pa.string()))

    return texts.mapInArrow(ask, schema)


def classify_comments(comments: DataFrame, provider: Callable[[list[str]], list[str]], model: str, cache: DataFrame | None = None) -> DataFrame:
    """Adds categories and confidence. cache: (key, categories, confidence); only texts that it lacks reach the provider.

    A failed answer gives [question] and 0.0.
    """
    keyed = comments.withColumn("key", F.sha2(F.concat(F.lit(model), F.char(F.lit(0)), F.coalesce("body", F.lit(""))), 256))
    texts = keyed.select("key", "body").dropDuplicates(["key"])
    if cache is not None:
        texts = texts.join(cache, "key", "left_anti")
    categories, confidence = parse_response(F.coalesce("answer", F.lit("")))
    fresh = with_provider(texts, "body", provider, "answer").select("key", categories.alias("categories"), confidence.alias("confidence"))
    known = fresh if cache is None else fresh.unionByName(cache.select("key", F.filter("categories", lambda c: c.isin(*CATEGORIES)).alias("categories"), "confidence").withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("question")))))
    return keyed.join(known, "key", "left").drop("key")


def notable(classified: DataFrame) -> DataFrame:
    """Comments of confidence 0.5 or more that are more than a nitpick or praise."""
    return classified.filter((F.col("confidence") >= 0.5) & F.exists("categories", lambda c: ~c.isin("nitpick", "praise")))


def review_patterns(clusters: DataFrame, vectors: DataFrame, comments: DataFrame, file: str | None = None, samples: int = 3) -> DataFrame:
    """(cluster_id, size, files, samples) of clusters given as lists of vector keys, by the comments behind them.

    files: at most ten, sorted; samples: the first comments by id, 200 characters each. file keeps clusters with a
    comment on a path that contains it.
    """
    member = clusters.select("cluster_id", F.explode("comments").alias("vector_key")).filter("cluster_id is not null").distinct()
    keys = vectors.select("vector_key", "comment_id").dropDuplicates(["vector_key"])
    rows = member.join(keys, "vector_key").select("cluster_id", "comment_id").distinct().join(current_comments(comments).select("comment_id", "file_path", "body"), "comment_id")

    def first(df: DataFrame, column: str, most: int) -> DataFrame:
        """The first rows of each cluster, taken from parts of it first, so a cluster of any size is spread over tasks."""
        for part in ((F.pmod(F.xxhash64(column), F.lit(64)),), ()):
            df = df.withColumn("r", F.row_number().over(W.partitionBy("cluster_id", *part).orderBy(column))).filter(F.col("r") <= most)
        return df

    listed = lambda c: F.array_sort(F.collect_list(c))
    by = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.bool_or(F.contains("file_path", F.lit(file or ""))).alias("on_file"))
    files = first(rows.select("cluster_id", "file_path").filter("file_path is not null").distinct(), "file_path", 10).groupBy("cluster_id").agg(listed("file_path").alias("files"))
    few = first(rows, "comment_id", samples).groupBy("cluster_id").agg(listed(F.struct("comment_id", F.substring("body", 1, 200).alias("body"))).alias("s"))
    by = by.join(few, "cluster_id").join(files, "cluster_id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    by = by.filter("on_file") if file else by
    return by.select("cluster_id", "size", "files", F.transform("s", lambda x: x["body"]).alias("samples"))


def assemble_clusters(members: DataFrame, vectors: DataFrame, least: int = 5) -> DataFrame:
    """(cluster_id, size, keys, centroid, coherence) from (cluster_id, vector_key) and valid vectors, the noise label -1 left out.

    keys are sorted. Fewer than the least number of distinct keys in all, noise included, give no cluster.
    """
    rows = members.filter("cluster_id is not null and vector_key is not null").distinct().join(vectors.select("vector_key", "vector"), "vector_key")
    enough = rows.agg(F.count_distinct("vector_key").alias("n")).filter(F.col("n") >= least)
    kept = rows.filter("cluster_id != -1").join(F.broadcast(enough), F.lit(True)).drop("n")  # one row or none
    keys = kept.groupBy("cluster_id").agg(F.sort_array(F.collect_list("vector_key")).alias("keys"))
    return centroids(kept, "cluster_id").join(keys, "cluster_id").select("cluster_id", "size", "keys", "centroid", "coherence")


def embedding_text(text: Column, model: str) -> Column:
    """What is embedded for clustering: models of one family expect a prefix that names the task."""
    return F.concat(F.lit("clustering: "), text) if "nomic" in model.lower() else text
