"""Operators over project documents: sections of Markdown, excerpts of configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LENGTH, LINES = 800, 40


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(T.stripped(text), r"\n{3,}", "\n\n")


def _commands(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(T.COMMAND), F.lit(0)), "\n")


def markdown_sections(documents: DataFrame) -> DataFrame:
    """(path, content) -> (path, section, title, content, source_type): the text below each heading of level 1 to 3.

    What stands before the first heading and sections without text give no row; a document without headings is one
    section titled by its file. Longer sections are cut to 800 characters and keep their command lines. Null and blank
    documents, and those that start as generated, give no row. Other columns are kept.
    """
    text = F.col("content")
    kept = documents.filter(text.rlike(r"\S") & ~text.startswith("<!-- Generated by "))
    titles = F.regexp_extract_all(text, F.lit(T.HEADING), F.lit(1))
    bodies = F.split(text, T.HEADING)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    parts = F.when(F.size(titles) == 0, F.array(F.struct(stem.alias("title"), _trimmed(text).alias("body"), F.lit(True).alias("whole")))).otherwise(
        F.zip_with(titles, F.slice(bodies, 2, F.size(bodies)), lambda t, b: F.struct(F.trim(t).alias("title"), _trimmed(F.coalesce(b, F.lit(""))).alias("body"), F.lit(False).alias("whole")))
    )
    rows = kept.select("*", F.posexplode(parts).alias("section", "_s")).filter("_s.body != ''")
    body, commands = F.col("_s.body"), _commands(F.col("_s.body"))
    cut = F.when(F.length(body) <= LENGTH, body).otherwise(T.stripped(F.substring(body, 1, LENGTH)))
    content = F.when(F.col("_s.whole"), body).when(commands != "", F.concat(cut, F.lit("\n\nCommands:\n"), commands)).otherwise(cut)
    return rows.select(*[c for c in documents.columns if c not in ("content", "title")], "section", F.col("_s.title").alias("title"), content.alias("content"), F.lit("doc").alias("source_type"))


def config_excerpts(documents: DataFrame) -> DataFrame:
    """(path, content) -> (path, title, content, source_type): the first 40 lines and the command lines, 800 characters at most."""
    head = T.stripped(F.array_join(F.slice(F.split("content", r"\r?\n"), 1, LINES), "\n"))
    commands = _commands(F.col("content"))
    text = _trimmed(F.when(commands != "", F.concat(head, F.lit("\n\nCommands:\n"), commands)).otherwise(head))
    rows = documents.filter("content is not null").withColumn("_t", text).filter("_t != ''")
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("title"), F.substring("_t", 1, LENGTH).alias("content"), F.lit("config").alias("source_type"))
