"""Ranking of knowledge notes for one planning request, and selections for exports."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import confidence_weight, cosine

MOST_TOKENS = 20


@dataclass
class PlanningQuery:
    """What is planned: a task, and maybe a plan, a question, a diff, files, and an embedding of the request."""

    task: str = ""
    plan: str = ""
    question: str = ""
    diff: str = ""
    files: list[str] = field(default_factory=list)
    embedding: list[float] | None = None

    def tokens(self) -> list[str]:
        return re.findall(r"[a-zA-Z0-9_/.-]+", " ".join([self.task, self.plan, self.question, self.diff[:4000], *self.files]).lower())

    def phrases(self) -> list[str]:
        """The first 20 distinct tokens by alphabet, as phrases of words; tokens without letters and digits match nothing."""
        split = (" ".join(re.findall(r"[^\W_]+", t)) for t in sorted(set(self.tokens()))[:MOST_TOKENS])
        return [p for p in split if p]


def normalized_files(root: str, files: list[str]) -> list[str]:
    """Distinct paths below the root, relative to it and sorted; absolute ones outside of it are left out."""
    found = set()
    for file in map(PurePosixPath, files):
        if not file.is_absolute():
            found.add(str(file))
        elif file.is_relative_to(root):
            found.add(str(file.relative_to(root)))
    return sorted(found)


def note_embedding_text(text: Column, anchors: Column) -> Column:
    """What is embedded for a note: its text and its anchors."""
    return F.concat(text, F.lit(" "), F.array_join(F.coalesce(anchors, F.array().cast("array<string>")), " "))


def _name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)


def anchor_match(anchors: Column, files: list[str]) -> Column:
    """1 for a file in common, 0.5 for a file name, 0.3 where one lies in a directory of the other, else 0."""
    if not files:
        return F.lit(0.0)
    asked = F.array(*[F.lit(f) for f in files])
    names = F.array(*[F.lit(f.rstrip("/").rsplit("/", 1)[-1]) for f in files])
    below = F.exists(anchors, lambda a: F.exists(asked, lambda f: f.startswith(F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"))) | a.startswith(F.concat(F.regexp_replace(f, "/+$", ""), F.lit("/")))))
    known = F.coalesce(anchors, F.array().cast("array<string>"))
    return F.when(F.arrays_overlap(known, asked), 1.0).when(F.arrays_overlap(F.transform(known, _name), names), 0.5).when(F.coalesce(below, F.lit(False)), 0.3).otherwise(0.0)


def rank_notes(notes: DataFrame, query: PlanningQuery, related: DataFrame | None = None) -> DataFrame:
    """Adds anchor, lexical, fts, graph, semantic and score, and leaves out notes that have nothing to say.

    notes: (id, text, anchors, confidence, search_text, embedding?). related: (path, score) from the coupling graph.
    The request is a set of literals, so the notes are read once, without a shuffle but for the graph.
    """
    tokens = sorted(set(query.tokens()))
    asked = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    search = F.coalesce("search_text", F.lit(""))
    lexical = F.size(F.array_intersect(asked, T.tokens(search))) / F.lit(float(len(tokens))) if tokens else F.lit(0.0)
    haystack = F.concat(T.words(F.coalesce("text", F.lit(""))), T.words(F.array_join(F.coalesce("anchors", F.array().cast("array<string>")), " ")), T.words(search))
    phrases = query.phrases()
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(haystack, F.lit(f" {p} "))
    ranked = notes.withColumns({"anchor": anchor_match(F.col("anchors"), query.files), "lexical": lexical, "fts": F.when(hit, 1.0).otherwise(0.0)})
    if related is not None:
        scores = related.groupBy("path").agg(F.max("score").alias("g"))
        near = notes.select("id", F.explode("anchors").alias("path")).join(scores, "path").groupBy("id").agg(F.max("g").alias("graph"))
        ranked = ranked.join(near, "id", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
    else:
        ranked = ranked.withColumn("graph", F.lit(0.0))
    vectors = query.embedding is not None and "embedding" in notes.columns
    semantic = F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(x)) for x in query.embedding])), F.lit(0.0))) if vectors else F.lit(0.0)
    ranked = ranked.withColumns({"semantic": semantic, "weight": confidence_weight(F.coalesce("confidence", F.lit("medium")))})
    anchor, text, graph, near, weight = F.col("anchor"), F.greatest("lexical", "fts"), F.col("graph"), F.col("semantic"), F.col("weight")
    found = (anchor > 0) | (F.col("lexical") > 0) | (F.col("fts") > 0)
    bonus = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    score = 0.30 * anchor + 0.20 * text + 0.20 * near + 0.12 * graph + 0.10 * weight + 0.08 * bonus(found | (near > 0.5)) if vectors else 0.40 * anchor + 0.25 * text + 0.15 * graph + 0.10 * weight + 0.10 * bonus(found)
    return ranked.withColumn("score", score).filter((F.col("score") > 0.05) | found | (near >= 0.3)).drop("weight")


def planning_brief(notes: DataFrame, query: PlanningQuery, related: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """The best notes of a request, with at most three references each."""
    best = rank_notes(notes, query, related).orderBy(F.desc(F.round("score", 9)), "confidence", "text", "id").limit(limit)
    return best.select("id", "text", F.slice(F.coalesce("evidence_refs", F.array().cast("array<string>")), 1, 3).alias("refs"), "confidence", "score")


def export_selection(notes: DataFrame, limit: int = 12) -> DataFrame:
    """Notes for a repository-wide export: general ones of high or medium confidence, then others of high confidence."""
    general = (F.coalesce(F.size("anchors"), F.lit(0)) <= 0) & F.col("confidence").isin("high", "medium")
    chosen = notes.withColumn("priority", F.when(general, 0).when(F.col("confidence") == "high", 1)).filter("priority is not null")
    return chosen.orderBy("priority", "confidence", "id").limit(limit).drop("priority")
