"""The build: from commits, comments and documents to analyses, notes' edges and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commits as C
from ..operators import coupling as P
from ..operators import docs as D
from ..operators import reviews as R
from ..sources import notes as N
from ..sources.config import BuildConfig


def analyses(commits: DataFrame, reference: str, config: BuildConfig | None = None) -> dict[str, DataFrame]:
    """All outputs of the analyzers by name, as lazy DataFrames; nothing is collected."""
    config = config or BuildConfig()
    pairs = P.coupling(commits, reference, config.half_life_days, most_files=config.max_files_per_commit, min_shared=config.min_shared_commits, min_confidence=config.min_confidence)
    return {
        "classified": C.classify(commits), "churn": C.churn(commits, reference, config.half_life_days), "coupling": pairs, "hubs": P.hubs(pairs), "edges": P.file_edges(pairs), "modules": P.modules(pairs),
        "conventions": C.conventions(commits), "reverts": C.reverts(commits), "fix_after": C.fix_after(commits),
    }


def review_analyses(comments: DataFrame, provider, model: str, cache: DataFrame | None = None) -> DataFrame:
    """Comments worth reading with the provider's categories."""
    return R.classify_comments(R.worth_reading(R.current_comments(comments)), provider, model, cache)


def snippets(documents: DataFrame) -> DataFrame:
    """Sections of Markdown files and excerpts of others from (path, content)."""
    markdown = documents.filter("lower(path) like '%.md'")
    sections = D.markdown_sections(markdown).select("path", "title", "content", "source_type")
    return sections.unionByName(D.config_excerpts(documents.filter("lower(path) not like '%.md'")))


def recent(commits: DataFrame, reference: str, months: int) -> DataFrame:
    """Commits of the last months before the reference time."""
    return commits.filter(F.col("author_date") >= F.lit(reference).cast("timestamp") - F.make_interval(months=F.lit(months)))


def build(commits: DataFrame, comments: DataFrame, documents: DataFrame, notes: DataFrame, path: str, reference: str, config: BuildConfig | None = None) -> dict[str, DataFrame]:
    """Runs the analyzers on the configured months and stores notes, edges and metadata as an index under a path.

    comments, documents and notes may be empty: metadata tells what the build covers. What is stored are distinct notes
    and edges of the co-change graph; the analyses are returned and stay lazy.
    """
    config = config or BuildConfig()
    commits = recent(commits, reference, config.months)
    out = analyses(commits, reference, config) | {"snippets": snippets(documents), "comments": R.worth_reading(R.current_comments(comments))}
    counted = [df.agg(F.count("*").alias(name)) for name, df in (("total_commits_analyzed", C.current(commits)), ("comment_count", out["comments"]), ("snippet_count", out["snippets"]), ("note_count", notes.select("id").distinct()))]
    metadata = counted[0]
    for one in counted[1:]:
        metadata = metadata.join(F.broadcast(one), F.lit(True))  # one row each
    N.store_index(notes, out["edges"], metadata.withColumn("built_at", F.lit(reference).cast("timestamp")), path)
    return out
