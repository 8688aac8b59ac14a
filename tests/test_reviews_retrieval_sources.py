import json

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import coupling as P
from quarryline.operators import docs as D
from quarryline.operators import evidence as E
from quarryline.operators import retrieval as Q
from quarryline.operators import reviews as R
from quarryline.operators import vectors as V
from quarryline.plans import registry
from quarryline.sources import exports, git_log, notes
from quarryline.sources import notes as N
from quarryline.sources.config import BuildConfig, months_of
from quarryline.sources.documents import read_documents


@pytest.mark.parametrize(("body", "trivial"), [("ok", True), ("LGTM", True), ("+1", True), ("ship it", True), ("Looks good to me!", True), ("   ", True), ("## Coverage report of the build", True), ("This lock is taken twice in the loop.", False)])
def test_trivial(spark, body, trivial):
    assert spark.createDataFrame([(body,)], "b string").select(T.is_trivial(F.col("b"))).first()[0] == trivial


@pytest.mark.parametrize(
    ("raw", "categories", "confidence"),
    [
        ("<category>bug</category><confidence>0.95</confidence>", ["bug"], 0.95), ("<category>security</category><category>bug</category><confidence>0.9</confidence>", ["security", "bug"], 0.9),
        ("<category>bug</category><category>odd</category><category>nitpick</category><confidence>0.8</confidence>", ["bug", "nitpick"], 0.8), ("<category>odd</category><confidence>0.8</confidence>", ["question"], 0.0), ("", ["question"], 0.0),
        ("<category>bug</category><confidence>1.5</confidence>", ["bug"], 1.0), ("<category>bug</category><confidence>-0.3</confidence>", ["bug"], 0.0), ("<category>bug</category>", ["bug"], 0.5), ("<category> BUG </category><category>performance</category>", ["bug", "performance"], 0.5),
    ],
)
def test_response(spark, raw, categories, confidence):
    c, p = R.parse_response(F.col("r"))
    assert tuple(spark.createDataFrame([(raw,)], "r string").select(c, p).first()) == (categories, confidence)


def test_pull_requests(spark):
    long = "Please take the lock before the loop."
    remark = lambda login, body: {"body": body, "author": login and {"login": login}, "createdAt": "2025-01-15T10:30:00Z"}
    node = {
        "number": 7, "reviewThreads": {"nodes": [{"isResolved": True, "path": "a.py", "line": 3, "comments": {"nodes": [remark(None, long), remark("bob", "ok")]}}, {"isResolved": False, "path": "b.py", "line": 1, "comments": {"nodes": [remark("x", "LGTM")]}}]},
        "reviews": {"nodes": [{"state": "CHANGES_REQUESTED", "author": {"login": "eve"}, "body": long, "submittedAt": ""}]}, "comments": {"nodes": [remark("codecov", long), remark("ann", long), remark("bob", long + " Twice.")]},
    }
    bare = {"number": 8, "reviewThreads": {"nodes": []}, "reviews": {"nodes": []}}
    df = spark.createDataFrame([(json.dumps(node),), (json.dumps(bare),)], "j string").select(F.from_json("j", R.PULL_REQUEST).alias("n")).select("n.*")
    found = R.flatten_pull_requests(df).collect()
    assert {(r.author, r.file_path, len(r.thread_comments), r.review_state) for r in found} == {("ghost", "a.py", 1, None), ("eve", None, 0, "CHANGES_REQUESTED"), ("ann", None, 1, None), ("bob", None, 0, None)}
    assert next(r for r in found if r.author == "eve").created_at.year == 1970


def test_threads_of_keys_beyond_int(spark, tmp_path):
    long, far = "Please take the lock before the loop.", 2**31
    rows = [(7, "a.py", 3, long, "ann", True, "@@", ["ok", None]), (far + 7, "b.py", None, long, None, False, None, None), (far + 7, "b.py", None, long, None, False, None, None), (-far - 1, None, 1, long, "bob", None, None, []), (2**63 - 1, "c.py", 1, long, "eve", True, None, ["ok"]), (far + 8, "d.py", 1, "LGTM", "x", True, None, []), (None, "e.py", 1, long, "x", True, None, [])]
    schema = "comment_id bigint, file_path string, line int, body string, author string, is_resolved boolean, diff_context string, thread_comments array<string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "review_comments.parquet"))
    found = {tuple(r) for r in registry.pull_request_threads(spark, str(tmp_path)).collect()}
    assert found == {(7, "a.py", 3, long, "ann", 2, "true"), (far + 7, "b.py", -1, long, "ghost", 0, "false"), (-far - 1, None, 1, long, "bob", 0, None), (2**63 - 1, "c.py", 1, long, "eve", 1, "true")}


def test_provider_and_cache(spark):
    def provider(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError
        return [f"<category>{'bug' if 'crash' in t else 'praise'}</category><confidence>0.9</confidence>" for t in texts]

    comments = spark.createDataFrame([(1, "a crash here"), (2, "fine work"), (3, "boom"), (4, None)], "comment_id long, body string")
    key = comments.filter("comment_id = 2").select(F.sha2(F.concat(F.lit("m"), F.char(F.lit(0)), "body"), 256).alias("key"), F.array(F.lit("security"), F.lit("gone")).alias("categories"), F.lit(0.7).alias("confidence"))
    found = {r.comment_id: (r.categories, r.confidence) for r in R.classify_comments(comments, provider, "m", key).collect()}
    assert found == {1: (["bug"], 0.9), 2: (["security"], 0.7), 3: (["question"], 0.0), 4: (["praise"], 0.9)}
    classified = R.classify_comments(comments, provider, "m").withColumn("file_path", F.lit("a/b.py"))
    assert [r.comment_id for r in E.review_comments(classified, file="b.py").collect()] == [1]


def test_coherence(spark):
    rows = [("same", [1.0, 0.0]), ("same", [2.0, 0.0]), ("right", [1.0, 0.0]), ("right", [0.0, 3.0]), ("one", [1.0, 1.0])]
    found = {r.g: (r.size, r.coherence, r.centroid) for r in V.centroids(spark.createDataFrame(rows, "g string, vector array<double>"), "g").collect()}
    assert found["same"][1] == pytest.approx(1.0) and found["right"][1] == pytest.approx(0.0) and found["one"] == (1, 1.0, [1.0, 1.0])
    assert found["same"][2] == [1.5, 0.0]


NOTES = "id string, text string, anchors array<string>, evidence_refs array<string>, confidence string, search_text string"


def test_ranking(spark):
    df = spark.createDataFrame([("n1", "Retry with jitter in the client", ["src/client.py"], ["c1"], "high", "Retry with jitter src/client.py"), ("n2", "When you fix it, run all tests", [], [], "medium", "When you fix it, run all tests")], NOTES)
    related = spark.createDataFrame([("tests/test_client.py", 1.0), ("src/client.py", 1.0)], "path string, score double")
    query = Q.PlanningQuery(task="fix retry bug", files=["src/client.py"])
    found = {r.id: r for r in Q.rank_notes(df, query, related).collect()}
    assert (found["n1"].anchor, found["n1"].fts, found["n1"].graph, round(found["n1"].score, 6)) == (1.0, 1.0, 1.0, 1.0)
    assert (found["n2"].anchor, found["n2"].lexical, round(found["n2"].score, 6)) == (0.0, 0.25, 0.41)
    assert [r.text[:5] for r in Q.planning_brief(df, query, related).collect()] == ["Retry", "When "]


def test_phrases_and_cut_off(spark):
    df = spark.createDataFrame([("a", "see client_py here", [], [], "low", ""), ("b", "client of py", [], [], "low", ""), ("c", "nothing", [], [], "medium", "")], NOTES)
    assert {r.id for r in Q.rank_notes(df, Q.PlanningQuery(task="client.py !!")).collect()} == {"a", "c"}


def test_anchor_levels(spark):
    df = spark.createDataFrame([("a", ["src/x.py"]), ("b", ["lib/x.py"]), ("c", ["src"]), ("d", ["other"]), ("e", None)], "id string, anchors array<string>")
    assert {r[0]: r[1] for r in df.select("id", Q.anchor_match(F.col("anchors"), ["src/x.py"])).collect()} == {"a": 1.0, "b": 0.5, "c": 0.3, "d": 0.0, "e": 0.0}


def test_sections(spark):
    text = "intro\n# Test Repo\n\n# Build & Run\nText.\n\n\n\nuv sync\nuv run pytest\n## Conventions\nBe kind.\n"
    found = D.markdown_sections(spark.createDataFrame([("README.md", text), ("docs/plain.md", "no heading"), ("g.md", "<!-- Generated by x -->\n# A\nb"), ("n.md", None), ("e.md", " ")], "path string, content string")).collect()
    assert [(r.title, r.content) for r in found] == [("Build & Run", "Text.\n\nuv sync\nuv run pytest\n\nCommands:\n\nuv sync\nuv run pytest"), ("Conventions", "Be kind."), ("plain", "no heading")]
    config = D.config_excerpts(spark.createDataFrame([("a/Makefile", "\n".join(f"line {k}" for k in range(60)) + "\nmake all"), ("b.toml", "")], "path string, content string")).collect()
    assert len(config) == 1 and config[0].title == "Makefile" and config[0].content.endswith("line 39\n\nCommands:\nmake all")


def test_git_log(spark):
    block = lambda head, *lines: "\x1f".join(head) + "\n" + "\n".join(lines)
    raw = [
        block(["h1", "Ann", "a@x", "2026-01-01T00:00:00+00:00", "", "feat: x", "first line"], "second line", "", "10\t5\tsrc/main.py", "-\t-\timage.png", "5\t3\tsrc/{old.py => new.py}", "0\t0\told_file.py => new_file.py", "1\t1\tsrc/{ => sub}/f", "not a numstat line"),
        block(["h2", "Bob", "b@x", "2026-01-02T00:00:00+02:00", "p1 p2", "merge", ""]), "no header here", "\x1f\x1f",
    ]
    found = {r.hash: r for r in git_log.parse_log(spark.createDataFrame([(r,) for r in raw], "value string")).collect()}
    assert set(found) == {"h1", "h2"}
    assert found["h1"].body == "first line" and found["h1"].parents == [] and found["h2"].parents == ["p1", "p2"] and found["h2"].files == []
    assert [tuple(f) for f in found["h1"].files] == [("src/main.py", 10, 5, None), ("image.png", None, None, None), ("src/new.py", 5, 3, "src/old.py"), ("new_file.py", 0, 0, "old_file.py"), ("src/{ => sub}/f", 1, 1, "src/{ => sub}/f")]


def test_git_log_file(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(f"\x1eh{k}\x1fA\x1fa@x\x1f2026-01-0{k}T00:00:00+00:00\x1f{'p q' if k == 2 else 'p'}\x1fs\x1f\n1\t1\tf{k}\n" for k in (1, 2, 3)))
    assert {r.hash for r in git_log.read_log(spark, str(tmp_path)).collect()} == {"h1", "h3"}
    assert {r.hash for r in git_log.read_log(spark, str(tmp_path), no_merges=False, since="2026-01-02").collect()} == {"h2", "h3"}


def test_notes_and_index(spark, tmp_path):
    lines = ['{"text": " keep it ", "anchors": "a.py", "evidence": ["c1", " "], "confidence": "HIGH"}', "{bad", '{"text": ""}', '{"text": "other", "anchors": [], "confidence": "sure"}']
    parsed = notes.parse_notes(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = sorted(parsed.collect(), key=lambda r: r.text)
    assert [(r.text, r.anchors, r.evidence_refs, r.confidence, r.search_text) for r in found] == [("keep it", ["a.py"], ["c1"], "high", "keep it a.py"), ("other", [], [], "medium", "other")]
    assert all(len(r.id) == 16 for r in found)
    edges = spark.createDataFrame([("a", "b", "cochange", 0.1, "x"), ("a", "b", "cochange", 0.2, "y")], "src string, dst string, edge_type string, score double, reason string")
    notes.store_index(parsed, edges, spark.createDataFrame([(2,)], "note_count int"), str(tmp_path))
    assert [r.confidence for r in notes.load_notes(spark, str(tmp_path)).collect()] == ["high", "medium"]
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 1
    texts = exports.export(parsed, [*exports.FORMATS, "unknown"], "2026-01-01")
    assert set(texts) == set(exports.FORMATS) and "keep it" in texts["agents_md"] and json.loads(texts["json"])["notes"]


def test_cache_age(spark):
    df = spark.sql("select 'k' key, 1 data, timestamp '2026-01-01 00:00:00' fetched_at union all select 'k', 2, timestamp '2026-01-01 12:00:00' union all select 'old', 3, timestamp '2025-12-01 00:00:00'")
    assert [(r.key, r.data) for r in notes.fresh(df, F.lit("2026-01-01 13:00:00").cast("timestamp")).collect()] == [("k", 2)]


def test_export_selection(spark):
    rows = [("g1", "t", [], [], "medium", ""), ("g2", "t", [], [], "low", ""), ("a1", "t", ["x"], [], "high", ""), ("a2", "t", ["x"], [], "medium", ""), ("g3", "t", None, [], "high", "")]
    assert [r.id for r in Q.export_selection(spark.createDataFrame(rows, NOTES)).collect()] == ["g3", "g1", "a1"]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[history]\nmonths = 6\nunknown = 1\n[coupling]\nmin_confidence = 0.5\n")
    c = BuildConfig.load(str(tmp_path / "c.toml"))
    assert (c.months, c.min_confidence, c.half_life_days) == (6, 0.5, 180.0) and BuildConfig.load("/nowhere") == BuildConfig()
    assert (months_of("6m"), months_of("x"), months_of(None)) == (6, None, None)


def test_review_patterns(spark):
    clusters = spark.createDataFrame([(1, ["k1", "k2", "k2", "k3"]), (1, ["k1", "k2", "k3"]), (2, ["gone"]), (3, None), (None, ["k1"])], "cluster_id long, comments array<string>")
    vectors = spark.createDataFrame([("k1", 11), ("k1", 11), ("k2", 12), ("k3", 12)], "vector_key string, comment_id long")
    comments = spark.createDataFrame([(11, "b.py", "x" * 300), (11, "b.py", "x" * 300), (12, "a.py", None)], "comment_id long, file_path string, body string")
    found = R.review_patterns(clusters, vectors, comments).collect()
    assert [(r.cluster_id, r["size"], r.files, r.samples) for r in found] == [(1, 2, ["a.py", "b.py"], ["x" * 200, None])]
    assert R.review_patterns(clusters, vectors, comments, file="c.py").count() == 0


def test_evidence(spark):
    pairs = spark.createDataFrame([("r", "a", "b", 3.9, 0.5, 0.7, 2.0, 0.6), ("r", "b", "c", 2.0, 0.2, 0.9, 2.0, 0.6)], "repo_id string, file_a string, file_b string, shared double, confidence_ab double, confidence_ba double, lift double, strength double")
    assert [(r.path, r.confidence, r.shared) for r in E.coupling_for_file(pairs, "b").collect()] == [("a", 0.7, 3), ("c", 0.2, 2)]
    hubs = spark.createDataFrame([("r", f"f{k}", k, 1.0) for k in range(40)], "repo_id string, path string, coupled_files long, weight double")
    assert E.hub_files(hubs).first().path == "f39" and E.hub_files(hubs).count() == 10 and E.hub_files(hubs, 99).count() == 30
    modules = spark.createDataFrame([("r", "m", "a"), ("r", "m", "b"), ("r", "n", "c")], "repo_id string, module string, path string")
    sizes = P.module_sizes(modules, pairs)
    assert [(r.module_id, r.files, r.internal_coupling_avg) for r in E.modules(sizes).collect()] == [(0, 2, 0.6), (1, 1, 0.0)]
    chains = spark.createDataFrame([("r", "h1", "s", ["x"], 1, True), ("r", "h2", "s", ["x", "y"], 2, False)], "repo_id string, original_hash string, original_subject string, revert_hashes array<string>, depth int, is_effectively_reverted boolean")
    commits = spark.createDataFrame([("r", "h1", [("a",)]), ("r", "h2", None)], "repo_id string, hash string, files array<struct<path:string>>")
    assert [r.original for r in E.revert_chains(chains, commits).collect()] == ["h2", "h1"] and [r.original for r in E.revert_chains(chains, commits, "a").collect()] == ["h1"]
    snippets = spark.createDataFrame([("p", 0, "Retry", "text"), ("p", 1, "Other", "about RETRY"), ("q", 0, "None", "x")], "path string, section int, title string, content string")
    assert [r.title for r in E.doc_snippets(snippets, "retry").collect()] == ["Retry", "Other"]


def test_documents_at_any_depth(spark, tmp_path):
    for name in ("README.md", "docs/a.md", "docs/x/y/z/w/deep.md", "docs/x/skip.txt", "package.json", "src/other.md"):
        file = tmp_path / "repo (1)" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    found = {r.path: r.content for r in read_documents(spark, str(tmp_path / "repo (1)")).collect()}
    assert found == {p: p for p in ("README.md", "docs/a.md", "docs/x/y/z/w/deep.md", "package.json")}
    assert read_documents(spark, str(tmp_path / "none")).count() == 0


def test_normalized_files():
    assert Q.normalized_files("/r", ["/r/b", "a", "/r/b", "/x/c", "b"]) == ["a", "b"]


def test_index_is_found_once_it_is_stored(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not N.has_index(spark, path) and N.load_metadata(spark, path) is None
    notes = spark.createDataFrame([("n", "high"), ("n", "low")], "id string, confidence string").coalesce(1)
    edges = spark.createDataFrame([("a", "b", "t", 0.1), ("a", "b", "t", 0.2)], "src string, dst string, edge_type string, score double").coalesce(1)
    N.store_index(notes, edges, spark.createDataFrame([(1,)], "note_count int"), path)
    assert N.has_index(spark, path) and [tuple(r) for r in N.load_notes(spark, path).collect()] == [("n", "low")] and N.load_metadata(spark, path).first().note_count == 1


def test_vectors_of_a_batch_count_only_together(spark):
    texts = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "batch string, text string")
    cache = texts.filter("batch = 'y'").select(N.vector_key(F.col("text"), "m").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    assert [(r.batch, r.text) for r in N.all_cached_vectors(texts, cache, "m", "batch").collect()] == [("y", "a")]


def test_clusters_without_noise(spark):
    members = spark.createDataFrame([(1, f"k{k}") for k in range(4)] + [(1, "k0"), (-1, "n"), (None, "m"), (2, None), (2, "gone")], "cluster_id long, vector_key string")
    vectors = spark.createDataFrame([(k, [1.0, 0.0]) for k in ("k0", "k1", "k2", "k3", "n")], "vector_key string, vector array<double>")
    assert [(r.cluster_id, r["size"], r.keys, r.coherence) for r in R.assemble_clusters(members, vectors).collect()] == [(1, 4, ["k0", "k1", "k2", "k3"], 1.0)]
    assert R.assemble_clusters(members, vectors, least=6).count() == 0
    assert R.embedding_text(F.lit("x"), "Nomic-1") is not None
