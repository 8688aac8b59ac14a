import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from quarryline.plans import build
from quarryline.sources import notes as notes_source
from quarryline.sources.config import BuildConfig
from quarryline.streaming import commit_stream, distinct_commits, windowed_churn

from .fixtures import sample

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    code = "import sys, quarryline.plans.registry, quarryline.plans.build; sys.exit(any(m.startswith('quarryline.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_stream(spark, tmp_path):
    for k in range(2):  # the second delivery repeats the first
        sample(spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = distinct_commits(commit_stream(spark, str(tmp_path / "in"), sample(spark).schema))
    query = windowed_churn(stream).writeStream.outputMode("update").format("memory").queryName("churned").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    best = spark.sql("select max(commits) c, sum(added) a from (select window, max(commits) commits, max(added) added from churned group by window)").first()
    assert best.a == 793 and best.c <= 5


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_build_stores_an_index(spark, tmp_path):
    path = str(tmp_path / "index")
    comments = spark.createDataFrame([(1, "Why does the retry loop never stop here?", "ana"), (2, "LGTM", "ana")], "comment_id long, body string, author string")
    documents = spark.createDataFrame([("README.md", "# Run\nuv run app\n"), ("Makefile", "all:\n\tmake x\n")], "path string, content string")
    notes = spark.createDataFrame([("n1", "high"), ("n1", "low"), ("n2", "low")], "id string, confidence string").coalesce(1)
    out = build.build(sample(spark), comments, documents, notes, path, "2026-01-10 00:00:00", BuildConfig(min_shared_commits=1.5))
    stored = notes_source.load_metadata(spark, path).first()
    assert (stored.total_commits_analyzed, stored.comment_count, stored.snippet_count, stored.note_count) == (5, 1, 2, 2)
    assert notes_source.has_index(spark, path) and notes_source.load_notes(spark, path).count() == 2
    assert spark.read.parquet(f"{path}/edges").count() == out["edges"].count() > 0
    assert build.recent(sample(spark), "2026-03-03 12:00:00", 2).count() == 1
