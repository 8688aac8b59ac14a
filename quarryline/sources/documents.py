"""Documents and configuration of a checked-out repository, and saved pages of pull requests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reviews import PULL_REQUEST
from ..runtime import exists

# Files that describe a project. docs/ is read at any depth.
MARKDOWN = ("README*", "AGENTS.md", "CLAUDE.md", "CONTRIBUTING*")
CONFIG = ("pyproject.toml", "package.json", "Makefile", "justfile", ".github/workflows/*.yml")


def read_documents(spark: SparkSession, root: str, patterns: tuple[str, ...] = MARKDOWN + CONFIG, docs: str = "docs") -> DataFrame:
    """(path, content), paths relative to the root, each file once: files of the patterns, and all Markdown below docs."""
    root = root.rstrip("/")
    found = [f"{root}/{p}" for p in patterns if exists(spark, f"{root}/{p}")]
    parts = [spark.read.format("binaryFile").load(found)] if found else []
    if exists(spark, f"{root}/{docs}"):
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{root}/{docs}"))
    if not parts:
        return spark.createDataFrame([], "path string, content string")
    files = reduce(DataFrame.unionByName, parts).select("path", "content").dropDuplicates(["path"])
    return files.select(F.regexp_replace("path", "^(?:\\w+:)?/*" + re.escape(root.split(":", 1)[-1].strip("/")) + "/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def read_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of saved pull-request pages, one JSON node per line."""
    return spark.read.schema(PULL_REQUEST).json(path)
