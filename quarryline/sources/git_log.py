"""Commit logs as text: one record per commit, as printed by
git log --pretty=format:%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%s%x1f%b --numstat -M
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped

RECORD, FIELD = "\x1e", "\x1f"


def read_log(spark: SparkSession, path: str, *, no_merges: bool = True, since: str | None = None, repo_id: str = "") -> DataFrame:
    """Commits of log files under a path, with seq in the order of the log; splits are read in parallel."""
    raw = spark.read.option("lineSep", RECORD).text(path)
    commits = parse_log(raw).withColumns({"repo_id": F.lit(repo_id), "seq": F.monotonically_increasing_id()})
    commits = commits.filter(F.size("parents") <= 1) if no_merges else commits
    return commits.filter(F.col("author_date") >= F.lit(since).cast("timestamp")) if since else commits


def _renamed(path: Column, group: str) -> Column:
    """A path with {old => new} replaced by one side."""
    inner = F.regexp_replace(path, r"\{(.+?) => (.+?)\}", group)
    return F.when(path.rlike(r"\{(.+?) => (.+?)\}"), F.regexp_replace(F.regexp_replace(inner, "/+", "/"), "^/+|/+$", "")).otherwise(path)


def parse_log(raw: DataFrame) -> DataFrame:
    """value -> (hash, author_name, author_email, author_date, parents, subject, body, files).

    The first line with a field separator is the header; records without one or with too few fields give no row. Of a
    body only the first line remains, as later lines are read as numbers of changed lines where they have that form.
    """
    block = stripped(F.col("value"))
    lines = F.split(block, "\n")
    # separators at the end of a record vanish with its white space, so missing fields count as empty
    header = F.try_element_at(F.filter(lines, lambda s: F.contains(s, F.lit(FIELD))), F.lit(1))
    parts = F.split(header, FIELD)
    at = F.array_position(lines, header)
    numbers = F.filter(F.transform(F.slice(lines, at + 1, F.size(lines)), lambda s: F.split(s, "\t", 3)), lambda p: (F.size(p) == 3))

    def change(p: Column) -> Column:
        path = p[2]
        braces, arrow = path.rlike(r"\{(.*?) => (.*?)\}"), F.contains(path, F.lit(" => "))
        new = F.when(braces, _renamed(path, "$2")).when(arrow, F.element_at(F.split(path, " => ", 2), 2)).otherwise(path)
        old = F.when(braces, _renamed(path, "$1")).when(arrow, F.element_at(F.split(path, " => ", 2), 1))
        return F.struct(new.alias("path"), p[0].try_cast("int").alias("added"), p[1].try_cast("int").alias("deleted"), old.alias("old_path"))

    rows = raw.select(parts.alias("p"), F.transform(numbers, change).alias("files")).filter(F.size("p") >= 6)
    parents = F.filter(F.split(F.col("p")[4], " +"), lambda h: h != "")
    return rows.select(
        F.col("p")[0].alias("hash"), F.col("p")[1].alias("author_name"), F.col("p")[2].alias("author_email"), F.to_timestamp(F.col("p")[3]).alias("author_date"), parents.alias("parents"),
        F.col("p")[5].alias("subject"), F.array_join(F.slice("p", 7, F.size("p")), FIELD).alias("body"), F.filter("files", lambda f: f["path"] != "").alias("files"),
    )


def render_log(commits: DataFrame) -> DataFrame:
    """Commits back to records of a log (value), binaries with - and renames as old => new."""
    text = lambda c: F.coalesce(c, F.lit(""))
    count = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    path = lambda f: F.when(f["old_path"].isNotNull(), F.concat(f["old_path"], F.lit(" => "), f["path"])).otherwise(f["path"])
    lines = F.transform(F.coalesce("files", F.array().cast(commits.schema["files"].dataType)), lambda f: F.concat_ws("\t", count(f["added"]), count(f["deleted"]), path(f)))
    head = F.concat_ws(FIELD, "hash", text(F.col("author_name")), text(F.col("author_email")), F.date_format("author_date", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.array_join(F.coalesce("parents", F.array().cast("array<string>")), " "), text(F.col("subject")), text(F.col("body")))
    return commits.select(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("value"))
