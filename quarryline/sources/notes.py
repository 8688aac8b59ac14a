"""Knowledge notes: reading JSON lines, storing and reading the index, caches with keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..runtime import exists

_SCHEMA = "text string, anchors string, evidence string, confidence string, created_at string"


def _list(column: str):
    """An array of non-empty strings from a JSON array or a single value."""
    raw = F.col(column)
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(parsed, lambda s: stripped(s)), lambda s: s.isNotNull() & (s != ""))


def parse_notes(lines: DataFrame) -> DataFrame:
    """value -> (id, text, anchors, evidence_refs, confidence, search_text, created_at). Bad lines and empty texts give no row.

    Unknown confidence becomes medium. The id is taken from a hash of text and anchors.
    """
    rows = lines.select(F.from_json("value", _SCHEMA).alias("n")).select("n.*").filter("text is not null").withColumn("text", stripped(F.col("text"))).filter("text != ''")
    rows = rows.withColumns({"anchors": _list("anchors"), "evidence_refs": _list("evidence"), "confidence": F.lower("confidence")})
    digest = F.sha1(F.concat("text", F.char(F.lit(0)), F.array_join("anchors", ",")))
    confidence = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium")
    search = F.when(F.size("anchors") > 0, F.concat("text", F.lit(" "), F.array_join("anchors", " "))).otherwise(F.col("text"))
    return rows.select(F.substring(digest, 1, 16).alias("id"), "text", "anchors", "evidence_refs", confidence.alias("confidence"), search.alias("search_text"), F.col("created_at").try_cast("timestamp").alias("created_at"))


def store_index(notes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str) -> None:
    """Replaces the index under a path. The last row of an id or of an edge counts. metadata is written last, so a reader that asks for it never sees half of a build."""
    notes.withColumn("_k", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.struct(*notes.columns), "_k").alias("n")).select("n.*").write.mode("overwrite").parquet(f"{path}/notes")
    edges.withColumn("_k", F.monotonically_increasing_id()).groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct(*edges.columns), "_k").alias("e")).select("e.*").write.mode("overwrite").parquet(f"{path}/edges")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/notes").orderBy("confidence", "id")


def fresh(cache: DataFrame, now, hours: float = 24.0) -> DataFrame:
    """Entries of a cache (key, ..., fetched_at) that are younger than the given hours, the newest of each key."""
    young = cache.filter(F.unix_micros("fetched_at") > F.unix_micros(now) - int(hours * 3600e6))
    return young.groupBy("key").agg(F.max_by(F.struct(*cache.columns), "fetched_at").alias("c")).select("c.*")


def has_index(spark: SparkSession, path: str) -> bool:
    """Whether a build left metadata, or notes, under a path."""
    return any(exists(spark, f"{path}/{part}/_SUCCESS") and bool(spark.read.parquet(f"{path}/{part}").head(1)) for part in ("metadata", "notes"))


def load_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The metadata of the build under a path, or None."""
    return spark.read.parquet(f"{path}/metadata") if exists(spark, f"{path}/metadata/_SUCCESS") else None


def vector_key(text, model: str):
    return F.sha2(F.concat(F.lit(model), F.char(F.lit(0)), text), 256)


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts (text) in a cache (key, vector), keyed by model and text."""
    keyed = texts.withColumn("key", vector_key(F.col("text"), model))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def all_cached_vectors(texts: DataFrame, cache: DataFrame, model: str, batch: str) -> DataFrame:
    """(batch, text, key, vector) of the batches whose texts are all in the cache; a batch with a miss gives no row."""
    keyed = texts.withColumn("key", vector_key(F.col("text"), model)).join(cache.select("key", "vector"), "key", "left")
    whole = keyed.groupBy(batch).agg(F.bool_and(F.col("vector").isNotNull()).alias("whole")).filter("whole").select(batch)
    return keyed.join(whole, batch)
