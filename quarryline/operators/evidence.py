"""Evidence queries: short answers from the outputs of the analyzers. Limits are min(asked or default, most)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _few(df: DataFrame, limit: int | None, default: int, most: int) -> DataFrame:
    return df.limit(min(limit or default, most))


def hotspots(churn: DataFrame, limit: int | None = None) -> DataFrame:
    top = churn.orderBy(F.desc("score"), "repo_id", "path").select("repo_id", "path", "commits", "churn_ratio", F.round("fix_ratio", 2).alias("fix_ratio"), F.round("score", 1).alias("score"))
    return _few(top, limit, 20, 50)


def coupling_for_file(pairs: DataFrame, path: str) -> DataFrame:
    either = pairs.filter((F.col("file_a") == path) | (F.col("file_b") == path))
    first = F.col("file_a") == path
    return either.select("repo_id", F.when(first, F.col("file_b")).otherwise(F.col("file_a")).alias("path"), F.when(first, F.col("confidence_ab")).otherwise(F.col("confidence_ba")).alias("confidence"), F.col("shared").cast("int").alias("shared"), "lift").orderBy(F.desc("confidence"), "repo_id", "path")


def hub_files(hubs: DataFrame, limit: int | None = None) -> DataFrame:
    return _few(hubs.orderBy(F.desc("coupled_files"), F.desc("weight"), "repo_id", "path"), limit, 10, 30)


def fix_after_chains(chains: DataFrame, commits: DataFrame, file: str | None = None, limit: int | None = None) -> DataFrame:
    if file:
        touched = commits.filter(F.exists("files", lambda f: f["path"] == file)).select("repo_id", F.col("hash").alias("original_hash")).distinct()
        chains = chains.join(touched, ["repo_id", "original_hash"], "left_semi")
    rows = chains.select("repo_id", F.substring("original_hash", 1, 10).alias("original"), F.size("fixup_hashes").alias("fixups"), "tier", "seconds")
    return _few(rows.orderBy(F.desc("fixups"), "repo_id", "original"), limit, 10, 30)


def revert_chains(chains: DataFrame, commits: DataFrame, file: str | None = None, limit: int | None = None) -> DataFrame:
    if file:
        touched = commits.filter(F.exists("files", lambda f: f["path"] == file)).select("repo_id", F.col("hash").alias("original_hash")).distinct()
        chains = chains.join(touched, ["repo_id", "original_hash"], "left_semi")
    rows = chains.select("repo_id", F.substring("original_hash", 1, 10).alias("original"), "original_subject", "depth", "is_effectively_reverted")
    return _few(rows.orderBy(F.desc("depth"), "repo_id", "original"), limit, 10, 30)


def review_comments(classified: DataFrame, file: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    rows = classified.filter((F.col("confidence") >= 0.5) & F.exists("categories", lambda c: ~c.isin("nitpick", "praise")))
    rows = rows.filter(F.contains("file_path", F.lit(file))) if file else rows
    rows = rows.filter(F.array_contains("categories", category)) if category else rows
    return _few(rows.orderBy(F.desc("confidence"), "comment_id").select("comment_id", "file_path", "categories", "confidence", F.substring("body", 1, 300).alias("body")), limit, 20, 50)


def doc_snippets(snippets: DataFrame, topic: str | None = None) -> DataFrame:
    if topic:
        snippets = snippets.filter(F.contains(F.lower("title"), F.lit(topic.lower())) | F.contains(F.lower("content"), F.lit(topic.lower())))
    return snippets.orderBy("path", "section").select("path", "title", F.substring("content", 1, 500).alias("content")).limit(20)


def conventions(found: DataFrame, most: int = 8) -> DataFrame:
    """The outcome of the conventions operator with its eight most used types and scopes, as (name, count) lists."""

    def top(column: str):
        entries = F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("name"), e["value"].alias("n")))
        return F.transform(F.slice(F.array_sort(entries), 1, most), lambda e: F.struct(e["name"].alias("name"), e["n"].alias("n")))

    return found.select(
        "repo_id", "primary_format", F.round("format_adherence", 2).alias("format_adherence"), top("types_used").alias("types_used"), top("scopes_used").alias("scopes_used"), "ticket_format", F.round("ticket_adherence", 2).alias("ticket_adherence"), "detected_rules",
    )


def modules(sizes: DataFrame) -> DataFrame:
    return sizes.select("repo_id", "module_id", "files", F.round("internal_coupling_avg", 2).alias("internal_coupling_avg")).orderBy(F.desc("files"), "repo_id", "module_id")
