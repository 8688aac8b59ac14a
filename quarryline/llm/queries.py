"""Queries of the numbered problems over the test tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read
from . import abuse, clusters, cooccurrence, leakage, names, packing, pii, residue


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve(names.author_keys(read(spark, sf_dir, "commits"), read(spark, sf_dir, "review_comments")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_entities(spark, sf_dir)).select(F.col("key_a").alias("author_key_a"), F.col("key_b").alias("author_key_b"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = clusters.cluster_vectors(read(spark, sf_dir, "comment_vectors"), "vector_key", "vector", "model")
    return clusters.sorted_neighbours(members).select(F.col("key_a").alias("vector_key_a"), F.col("key_b").alias("vector_key_b"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = clusters.cluster_vectors(read(spark, sf_dir, "comment_vectors"), "vector_key", "vector", "model")
    return clusters.describe(members, centroids, read(spark, sf_dir, "comment_clusters"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(read(spark, sf_dir, "review_comments"), "comment_id", "body")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.file_pairs(read(spark, sf_dir, "commits"), min_joint=5)
    kept = pairs.filter("2 * joint >= n_a + n_b - joint and joint * n >= 2 * n_a * n_b")
    return kept.select(F.col("scope").alias("repo_id"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.file_pairs(read(spark, sf_dir, "commits"), min_joint=2)
    return pairs.select(
        F.col("scope").alias("repo_id"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n", "n_a", "n_b", "joint",
        F.round("odds_ratio", 4).alias("odds_ratio"), F.round("lift", 4).alias("lift"),
    )


_PAIRS_SQL = """
with recursive touched as (select repo_id, hash, unnest(files) f from commits where repo_id is not null),
edges as (select distinct repo_id, f.old_path o, f.path p from touched where f.old_path is not null and f.old_path <> f.path),
chain as (select repo_id, o, p, 1 d from edges union all select c.repo_id, c.o, e.p, d + 1 from chain c join edges e on c.repo_id = e.repo_id and c.p = e.o where d < 50),
newest as (select repo_id, o, arg_max(p, d) p from chain group by 1, 2),
item as (select distinct t.repo_id, t.hash, coalesce(r.p, t.f.path) path from touched t left join newest r on r.repo_id = t.repo_id and r.o = t.f.path where t.f.path is not null),
single as (select repo_id, path, count(*) c from item group by 1, 2),
n as (select repo_id, count(distinct hash) n from commits where repo_id is not null group by 1),
pair as (select a.repo_id, a.path path_a, b.path path_b, count(*) joint from item a join item b on a.hash = b.hash and a.repo_id = b.repo_id and a.path < b.path group by 1, 2, 3),
full_pair as (select p.repo_id, path_a, path_b, n.n, a.c n_a, b.c n_b, joint from pair p join n using (repo_id)
  join single a on a.repo_id = p.repo_id and a.path = path_a join single b on b.repo_id = p.repo_id and b.path = path_b)
"""

def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, comments = read(spark, sf_dir, "commits"), read(spark, sf_dir, "review_comments")
    found = pii.find_types(pii.bodies_of(commits, comments), commits, "author_name")
    return found.select("source_table", "record_key", F.explode("types").alias("pii_type")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, comments = read(spark, sf_dir, "commits"), read(spark, sf_dir, "review_comments")
    rows = pii.find_pii(pii.bodies_of(commits, comments), commits, "author_name").filter(F.size("types") > 0)
    return rows.groupBy("source_table", "record_key").agg(F.min("redacted").alias("body"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_lists(packing.fill_containers(read(spark, sf_dir, "documents"), "doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "item_text")
    return leaks.select(F.col("document").alias("doc_id"), F.col("item").alias("item_id"))


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text", "source", read(spark, sf_dir, "abuse_samples"), "sample_text", "label")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select(F.col("document").alias("doc_id")).distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).select(F.col("document").alias("doc_id"), F.round("score", 4).alias("score"), "kind")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_abuse_scores(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p6_containers": p6_containers, "p2_found": p2_found, "p2_clusters": p2_clusters, "p5_found": p5_found, "p5_redacted": p5_redacted, "p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates, "p7_found": p7_found, "p3_found": p3_found, "p4_found": p4_found, "p4_pairs": p4_pairs}

SQL = {
    "p4_found": _PAIRS_SQL + "select repo_id, path_a, path_b from full_pair where joint >= 5 and 2 * joint >= n_a + n_b - joint and joint * n >= 2 * n_a * n_b",
    "p4_pairs": _PAIRS_SQL
    + """select repo_id, path_a, path_b, n, n_a, n_b, joint,
  round((joint + 0.5) * (n - n_a - n_b + joint + 0.5) / ((n_a - joint + 0.5) * (n_b - joint + 0.5)), 4) odds_ratio,
  round(joint * n / (n_a * n_b), 4) lift from full_pair where joint >= 2""",
}
