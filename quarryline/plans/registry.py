"""The registered queries of the core over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import decay
from ..operators import commits as C
from ..operators import coupling as P
from ..operators import docs as D
from ..operators import evidence as E
from ..operators import retrieval as Q
from ..operators import reviews as R
from ..operators import vectors as V
from ..runtime import dense_ids, read, shared_dir
from ..sources import git_log as G
from ..sources import notes as N

REFERENCE, HALF_LIFE = "2026-01-01 00:00:00", 720.0
#: Thresholds of the registered coupling queries; the commits of the test tables are spread over years.
COUPLING = {"min_shared": 1.5, "min_confidence": 0.25, "min_lift": 1.5}
CACHE_TIME, CACHE_HOURS = "2026-01-10 00:00:00", 24.0 * 14
REQUEST = Q.PlanningQuery(task="fix the retry backoff of the search reader", question="why does the cache grow", files=["docs/adr/retry.md", "README.md"])
SEMANTIC = Q.PlanningQuery(task="fix the retry backoff of the search reader", files=["README.md"], embedding=[1.0 if k % 3 else -0.5 for k in range(64)])


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "commits")


def commit_decay(spark, d):
    weight = decay(F.col("author_date"), F.lit(REFERENCE).cast("timestamp"), HALF_LIFE)
    return C.current(_commits(spark, d), "author_date").select("repo_id", "hash", F.round(weight.cast("double"), 6).alias("weight"))


def commit_classification(spark, d):
    return C.classify(_commits(spark, d)).select("repo_id", "hash", "commit_type", "scope", "is_breaking", "ticket", "is_conventional")


def churn_hotspots(spark, d):
    return C.churn(_commits(spark, d), REFERENCE, HALF_LIFE)


def top_hotspots(spark, d):
    return E.hotspots(churn_hotspots(spark, d))


def coupling_pairs(spark, d):
    return P.coupling(_commits(spark, d), REFERENCE, HALF_LIFE, **COUPLING)


def coupling_renamed(spark, d):
    commits = _commits(spark, d)
    return P.coupling(commits, REFERENCE, HALF_LIFE, renames=C.rename_map(commits), **COUPLING)


def hub_files(spark, d):
    return P.hubs(coupling_pairs(spark, d))


def file_edges(spark, d):
    return P.file_edges(coupling_pairs(spark, d))


def related_files(spark, d):
    return P.related_files(file_edges(spark, d), ["README.md", "CHANGELOG.md", "deps/go.mod"])


def implicit_modules(spark, d):
    return P.modules(coupling_pairs(spark, d))


def fix_after_candidates(spark, d):
    return C.fix_after_candidates(_commits(spark, d))


def module_sizes(spark, d):
    pairs = coupling_pairs(spark, d)
    return P.module_sizes(P.modules(pairs), pairs)


def fix_after_chains(spark, d):
    return C.fix_after(_commits(spark, d)).withColumn("fixup_hashes", F.array_join("fixup_hashes", ","))


def revert_chains(spark, d):
    return C.reverts(_commits(spark, d)).withColumn("revert_hashes", F.array_join("revert_hashes", ","))


def commit_conventions(spark, d):
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    c = C.conventions(_commits(spark, d)).withColumns({"types_used": flat(F.col("types_used")), "scopes_used": flat(F.col("scopes_used")), "rules": F.array_join("detected_rules", "|")}).drop("detected_rules")
    return c.withColumns({n: F.round(n, 6) for n in ("format_adherence", "ticket_adherence", "imperative_rate", "avg_subject_length", "under_72_rate", "body_rate", "period_rate", "lower_rate")})


def rename_map(spark, d):
    return C.rename_map(_commits(spark, d))


def git_log_round_trip(spark, d):
    kept = C.current(_commits(spark, d), "author_name", "author_email", "author_date", "parents", "subject", "body", "files")
    parsed = G.parse_log(G.render_log(kept))
    changed = lambda name: F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f[name], F.lit(0)))
    return parsed.select(
        "hash", "author_name", "author_email", F.size("parents").alias("parents"), "subject", F.size("files").alias("files"), changed("added").alias("added"), changed("deleted").alias("deleted"), F.size(F.filter("files", lambda f: f["old_path"].isNotNull())).alias("renames"),
    )


def worth_reading(spark, d):
    return R.worth_reading(R.current_comments(read(spark, d, "review_comments"))).select("comment_id", "repo_id", "author")


def pull_request_threads(spark, d):
    c = R.current_comments(read(spark, d, "review_comments"))
    note = lambda body, login: F.struct(body.alias("body"), F.struct(login.alias("login")).alias("author"), F.lit("2025-01-15T10:30:00Z").alias("createdAt"), F.col("diff_context").alias("diffHunk"))
    first = F.array(note(F.col("body"), F.col("author")))
    replies = F.transform(F.coalesce("thread_comments", F.array().cast("array<string>")), lambda b: note(b, F.lit("someone")))
    thread = F.struct(F.col("is_resolved").alias("isResolved"), F.col("file_path").alias("path"), F.col("line").alias("line"), F.struct(F.concat(first, replies).alias("nodes")).alias("comments"))
    node = F.to_json(F.struct(F.col("comment_id").alias("number"), F.struct(F.array(thread).alias("nodes")).alias("reviewThreads")))
    flat = R.flatten_pull_requests(c.select(F.from_json(node, R.PULL_REQUEST).alias("n")).select("n.*"))
    return flat.select("pr_number", "file_path", F.coalesce("line", F.lit(-1)).alias("line"), "body", "author", F.size("thread_comments").alias("replies"), F.col("is_resolved").cast("string").alias("is_resolved"))


def parsed_classifications(spark, d):
    c = R.current_comments(read(spark, d, "review_comments"))
    kind = F.when(F.contains("body", F.lit("cache")), "performance").when(F.contains("body", F.lit("null")), "BUG").otherwise("unheard_of")
    raw = F.concat(F.lit("<category> "), kind, F.lit(" </category><category>nitpick</category>"), F.when(F.length("body") % 3 != 0, F.concat(F.lit("<confidence>"), (F.length("body") / 100).cast("decimal(8,2)").cast("string"), F.lit("</confidence>"))).otherwise(""))
    categories, confidence = R.parse_response(raw)
    return c.filter("body is not null").select("comment_id", F.array_join(categories, ",").alias("categories"), F.round(confidence, 4).alias("confidence"))


def _answers(texts: list[str]) -> list[str]:
    """Stands in for a language model: the answer follows from the text."""
    return [f"<category>{'performance' if 'cache' in t else 'bug' if 'null' in t else 'question'}</category><confidence>{0.9 if len(t) % 2 else 0.4}</confidence>" for t in texts]


def classified_comments(spark, d):
    """Comments with the answers of a provider; those whose text the cache knows (that of a resolved comment) aren't asked for."""
    c = R.current_comments(read(spark, d, "review_comments")).filter("body is not null")
    key = N.vector_key(F.col("body"), "model-a")
    cache = c.filter("is_resolved").select(key.alias("key")).distinct().select("key", F.array(F.lit("praise"), F.lit("unheard_of")).alias("categories"), F.lit(1.0).alias("confidence"))
    return R.classify_comments(c, _answers, "model-a", cache)


def comment_classification(spark, d):
    return classified_comments(spark, d).select("comment_id", F.array_join("categories", ",").alias("categories"), "confidence")


def notable_comments(spark, d):
    return R.notable(classified_comments(spark, d)).select("comment_id", F.array_join("categories", ",").alias("categories"))


def review_comment_evidence(spark, d):
    return E.review_comments(classified_comments(spark, d), file="src/", category="bug").select("comment_id", "file_path", "confidence", "body")


def pull_request_reviews(spark, d):
    """Review texts and later remarks of whole pull requests, put together from the comments outside a file."""
    c = R.current_comments(read(spark, d, "review_comments")).filter("file_path is null")
    requests = dense_ids(c.select("repo_id", "pr_number").distinct(), ["repo_id", "pr_number"], "number").withColumn("number", F.col("number").cast("int"))
    person = F.struct(F.col("author").alias("login"))
    made = F.lit("2025-01-15T10:30:00Z")
    review = F.when(F.col("review_state").isNotNull(), F.struct("comment_id", F.struct(F.col("review_state").alias("state"), person.alias("author"), "body", made.alias("submittedAt")).alias("x")))
    remark = F.when(F.col("review_state").isNull(), F.struct("comment_id", F.struct("body", person.alias("author"), made.alias("createdAt")).alias("x")))
    listed = lambda c: F.struct(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["x"]).alias("nodes"))
    nodes = c.join(requests, ["repo_id", "pr_number"]).groupBy("number").agg(listed(review).alias("reviews"), listed(remark).alias("comments"))
    flat = R.flatten_pull_requests(nodes.select(F.from_json(F.to_json(F.struct(*nodes.columns)), R.PULL_REQUEST).alias("n")).select("n.*"))
    return flat.select("pr_number", "body", "author", F.coalesce("review_state", F.lit("")).alias("review_state"), F.size("thread_comments").alias("replies"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def cluster_assembly(spark, d):
    found = R.assemble_clusters(read(spark, d, "comment_clusters").select("cluster_id", F.explode("comments").alias("vector_key")), V.valid(read(spark, d, "comment_vectors")))
    return found.select("cluster_id", "size", F.array_join("keys", ",").alias("keys"), F.round(F.element_at("centroid", 1), 6).alias("first"), F.round("coherence", 6).alias("coherence"))


def embedding_texts(spark, d):
    c = R.current_comments(read(spark, d, "review_comments")).filter("body is not null")
    return c.select("comment_id", R.embedding_text(F.col("body"), "nomic-embed-text").alias("named"), R.embedding_text(F.col("body"), "lumen-embed-1").alias("plain"))


def review_patterns(spark, d):
    found = R.review_patterns(read(spark, d, "comment_clusters"), read(spark, d, "comment_vectors"), read(spark, d, "review_comments"))
    return found.select("cluster_id", "size", F.array_join("files", ",").alias("files"), F.array_join("samples", "|", "").alias("samples"))


def coupling_for_file(spark, d):
    return E.coupling_for_file(coupling_pairs(spark, d), "README.md")


def vector_centroids(spark, d):
    c = V.centroids(V.valid(read(spark, d, "comment_vectors")), "model", "repo_id")
    return c.select("model", "repo_id", "size", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"), F.round("coherence", 6).alias("coherence"))


def embedding_centroids(spark, d):
    e = read(spark, d, "embeddings")
    v = e.select(F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return V.centroids(v, "label").select("label", "size", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round("coherence", 6).alias("coherence"))


def markdown_sections(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "path", F.col("text").alias("content"))
    return D.markdown_sections(docs).select("doc_id", "section", "title", "content")


def _notes(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null")
    source = F.lower(F.coalesce("source", F.lit("")))
    confidence = F.when(source.isin("adr", "runbook"), "high").when(source.isin("wiki", "readme"), "medium").otherwise("low")
    anchors = F.when(source.isin("readme"), F.array().cast("array<string>")).otherwise(F.array(F.coalesce("path", F.lit(""))))
    return docs.select(F.col("doc_id").alias("id"), F.col("text"), anchors.alias("anchors"), confidence.alias("confidence"), F.coalesce("title", F.lit("")).alias("search_text"), F.array(F.col("doc_id").cast("string")).alias("evidence_refs"))


def ranked_notes(spark, d):
    return Q.rank_notes(_notes(spark, d), REQUEST).select("id", "anchor", F.round("lexical", 6).alias("lexical"), "fts", F.round("score", 6).alias("score"))


def planning_brief(spark, d):
    return Q.planning_brief(_notes(spark, d), REQUEST).select("id", F.round("score", 6).alias("score"))


def ranked_notes_by_all_signals(spark, d):
    """Notes with vectors and anchors in the coupling graph: all four signals and the formula with embeddings."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    notes = _notes(spark, d).join(e, "id", "left").withColumn("anchors", F.concat("anchors", F.when(F.lower("search_text").contains("cache"), F.array(F.lit("CHANGELOG.md"))).otherwise(F.array(F.lit("docs/index.md")))))
    related = related_files(spark, d).groupBy("path").agg(F.max("score").alias("score")).unionByName(spark.createDataFrame([("docs/index.md", 0.25), ("CHANGELOG.md", 0.75)], "path string, score double"))
    ranked = Q.rank_notes(notes, SEMANTIC, related)
    return ranked.select("id", "anchor", F.round("lexical", 6).alias("lexical"), "fts", F.round("graph", 6).alias("graph"), F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"))


def note_embedding_texts(spark, d):
    return _notes(spark, d).select("id", F.md5(Q.note_embedding_text(F.col("text"), F.col("anchors"))).alias("digest"))


def index_round_trip(spark, d):
    """Notes and edges stored as an index and read back; of repeated ids one row remains."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    notes = _notes(spark, d).select("id", "confidence", "anchors")
    edges = file_edges(spark, d)
    before = N.has_index(spark, path)
    N.store_index(notes.unionByName(notes.filter("confidence = 'high'")), edges.unionByName(edges), notes.agg(F.count("*").alias("note_count")), path)
    metadata = N.load_metadata(spark, path).select("note_count", F.lit(N.has_index(spark, path) and not before).alias("built"))
    kept = N.load_notes(spark, path).groupBy("confidence").agg(F.count("*").alias("notes"), F.sum(F.size("anchors")).alias("anchors"))
    stored_edges = spark.read.parquet(f"{path}/edges").agg(F.count("*").alias("edges"))
    return kept.join(F.broadcast(stored_edges), F.lit(True)).join(F.broadcast(metadata), F.lit(True))


def fresh_cache_entries(spark, d):
    """Deliveries of comments as entries of a cache by repository: the newest of each, if it is young enough at the given time."""
    entries = read(spark, d, "review_comments").filter("repo_id is not null and ingested_at is not null").select(F.col("repo_id").alias("key"), F.col("ingested_at").alias("fetched_at"))
    return N.fresh(entries, F.lit(CACHE_TIME).cast("timestamp"), CACHE_HOURS).select("key", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


def wholly_cached_vectors(spark, d):
    """Repositories all of whose comment texts have a vector in a cache built from the first model's vectors of resolved comments."""
    c = R.current_comments(read(spark, d, "review_comments")).filter("body is not null and pr_number is not null").select("repo_id", "pr_number", F.col("body").alias("text"), "is_resolved")
    cache = c.filter("is_resolved").select(N.vector_key(F.col("text"), "m").alias("key")).distinct().withColumn("vector", F.array(F.lit(1.0)))
    hit = N.all_cached_vectors(c.withColumn("batch", F.concat_ws("#", "repo_id", "pr_number")), cache, "m", "batch")
    return hit.groupBy("batch").agg(F.count("*").alias("texts"))


def cached_vector_misses(spark, d):
    c = R.current_comments(read(spark, d, "review_comments")).filter("body is not null").select(F.col("body").alias("text"), "is_resolved")
    cache = c.filter("is_resolved").select(N.vector_key(F.col("text"), "m").alias("key")).distinct().withColumn("vector", F.array(F.lit(1.0)))
    _, misses = N.cached_vectors(c.select("text").distinct(), cache, "m")
    return misses.select("key")


def config_excerpts(spark, d):
    docs = read(spark, d, "documents").select(F.coalesce("path", F.lit("")).alias("path"), F.col("text").alias("content"))
    return D.config_excerpts(docs).select("path", "title", F.md5("content").alias("digest"), F.length("content").alias("length"))


def doc_snippet_evidence(spark, d):
    docs = read(spark, d, "documents").select("path", F.col("text").alias("content"))
    return E.doc_snippets(D.markdown_sections(docs), "retry").select("path", "title", "content")


def hub_evidence(spark, d):
    return E.hub_files(hub_files(spark, d))


def fix_after_evidence(spark, d):
    return E.fix_after_chains(C.fix_after(_commits(spark, d)), _commits(spark, d), limit=25)


def fix_after_evidence_of_file(spark, d):
    return E.fix_after_chains(C.fix_after(_commits(spark, d)), _commits(spark, d), file="README.md")


def revert_evidence(spark, d):
    return E.revert_chains(C.reverts(_commits(spark, d)), _commits(spark, d), limit=30)


def revert_evidence_of_file(spark, d):
    return E.revert_chains(C.reverts(_commits(spark, d)), _commits(spark, d), file="README.md")


def convention_evidence(spark, d):
    flat = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit(":"), e["n"].cast("string"))), ",")
    found = E.conventions(C.conventions(_commits(spark, d)))
    return found.withColumns({"types_used": flat(F.col("types_used")), "scopes_used": flat(F.col("scopes_used")), "rules": F.array_join("detected_rules", "|")}).drop("detected_rules")


def module_evidence(spark, d):
    return E.modules(module_sizes(spark, d))


def export_selection(spark, d):
    return Q.export_selection(_notes(spark, d)).select("id", "confidence")


def notes_from_json(spark, d):
    lines = _notes(spark, d).select(F.to_json(F.struct("text", "anchors", F.upper("confidence").alias("confidence"))).alias("value"))
    return N.parse_notes(lines).select("id", F.length("search_text").alias("length"), "confidence", F.size("anchors").alias("anchors"))


QUERIES = {
    f.__name__: f
    for f in (
        commit_decay, commit_classification, churn_hotspots, top_hotspots, coupling_pairs, coupling_renamed, hub_files, file_edges, related_files, implicit_modules, fix_after_candidates, fix_after_chains, revert_chains, commit_conventions, rename_map, module_sizes,
        git_log_round_trip, worth_reading, pull_request_threads, pull_request_reviews, parsed_classifications, comment_classification, notable_comments, review_patterns, cluster_assembly, embedding_texts, coupling_for_file, vector_centroids, embedding_centroids, markdown_sections, ranked_notes, planning_brief, export_selection, notes_from_json,
        ranked_notes_by_all_signals, note_embedding_texts, index_round_trip, fresh_cache_entries, wholly_cached_vectors, cached_vector_misses, config_excerpts, doc_snippet_evidence, hub_evidence,
        fix_after_evidence, fix_after_evidence_of_file, revert_evidence, revert_evidence_of_file, review_comment_evidence, convention_evidence, module_evidence,
    )
}

_CURRENT = "cur as (select distinct on (repo_id, hash) * from commits where repo_id is not null and hash is not null)"
_DECAY = f"cast(round(exp(-ln(2.0) / {HALF_LIFE} * greatest(0.0, (epoch_us(timestamp '{REFERENCE}') - epoch_us(author_date)) / 86400e6)), 12) as decimal(18, 12))"
_CASE = lambda x, table, rest: "case " + x + "".join(f" when '{k}' then '{v}'" for k, v in table.items()) + f" else {rest} end"
_TRIM = r"regexp_replace({}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"

_CLASSIFIED = f"""
{_CURRENT}, msg as (select *, regexp_replace(coalesce(subject, ''), '^\\s+|\\s+$', '', 'g') s, coalesce(body, '') b from cur),
m as (select *, case when b <> '' then s || chr(10) || chr(10) || b else s end message, list_filter(list_transform(coalesce(files, []), lambda f: f.path), lambda p: p is not null) paths,
  list_sum(list_transform(coalesce(files, []), lambda f: coalesce(f.added, 0))) adds, list_sum(list_transform(coalesce(files, []), lambda f: coalesce(f.deleted, 0))) dels,
  regexp_extract(s, '{T.TICKET_PREFIX}', 2) rest from msg),
k as (select *, case when len(paths) = 0 then 'unknown' when len(list_filter(paths, lambda p: not regexp_matches(p, '{T.TEST_PATH}'))) = 0 then 'test' when len(list_filter(paths, lambda p: not regexp_matches(p, '{T.DOC_PATH}'))) = 0 then 'docs'
  when len(list_filter(paths, lambda p: not regexp_matches(p, '{T.CI_PATH}'))) = 0 then 'ci' when len(list_filter(paths, lambda p: not regexp_matches(p, '{T.CONFIG_PATH}'))) = 0 then 'chore'
  when adds > 5 and dels > 0 and least(adds, dels) / greatest(adds, dels) > 0.6 then 'refactor' else 'unknown' end by_files,
  regexp_matches(s, '{T.REVERT_SUBJECT}') or regexp_matches(message, '{T.REVERT_HASH}') rv, regexp_matches(s, '{T.CONVENTIONAL}') cv, regexp_matches(s, '{T.TICKET_PREFIX}') tp, regexp_matches(s, '{T.BRACKET}') br, regexp_matches(s, '{T.GITMOJI}') gm,
  regexp_matches(rest, '{T.CONVENTIONAL}') inn, coalesce(nullif(regexp_extract(message, '{T.TICKET}', 1), ''), '#' || nullif(regexp_extract(message, '#(\\d+)', 1), '')) tk from m),
classified as (select *, case when rv then 'revert' when cv then {_CASE(f"lower(regexp_extract(s, '{T.CONVENTIONAL}', 1))", T.TYPES, "'unknown'")}
  when tp then case when inn then {_CASE(f"lower(regexp_extract(rest, '{T.CONVENTIONAL}', 1))", T.TYPES, "'unknown'")} else by_files end when br then by_files
  when gm then {_CASE(f"regexp_extract(s, '{T.GITMOJI}', 1)", T.EMOJI_TYPES, "by_files")} when len(parents) > 1 then 'merge' else by_files end commit_type,
  case when rv then null when cv then nullif(regexp_extract(s, '{T.CONVENTIONAL}', 2), '') when tp then case when inn then nullif(regexp_extract(rest, '{T.CONVENTIONAL}', 2), '') end when br then regexp_extract(s, '{T.BRACKET}', 1) end scope,
  case when rv then false when cv then regexp_extract(s, '{T.CONVENTIONAL}', 3) = '!' or regexp_matches(b, '{T.BREAKING}') when tp and inn then regexp_extract(rest, '{T.CONVENTIONAL}', 3) = '!' else false end is_breaking,
  case when not rv and not cv and tp then regexp_extract(s, '{T.TICKET_PREFIX}', 1) else tk end ticket, not rv and cv is_conventional from k)
"""  # noqa: E501

_CHURN = f"""with {_CLASSIFIED}, x as (select repo_id, commit_type, {_DECAY} w, unnest(files) f from classified),
churned as (select repo_id, f.path path, count(*) commits, cast(sum(w) as double) weighted, sum(coalesce(f.added, 0)) added, sum(coalesce(f.deleted, 0)) deleted, count(*) filter (commit_type = 'fix') fixes from x where f.path is not null group by 1, 2),
churn as (select repo_id, path, commits, round(weighted, 4) weighted, added, deleted, round((added + deleted) / commits, 2) churn_ratio, round(fixes / commits, 4) fix_ratio, round(weighted * (1 + fixes / commits), 4) score from churned)"""

_RENAMES = """edges as (select repo_id, f.old_path o, arg_max(f.path, (author_date, seq, f.path)) p from (select repo_id, author_date, seq, unnest(files) f from commits) where f.old_path is not null and f.path is not null and f.old_path <> f.path and repo_id is not null group by 1, 2),
hop as (select repo_id, o, p, 1 d from edges union all select h.repo_id, h.o, e.p, d + 1 from hop h join edges e on h.repo_id = e.repo_id and h.p = e.o where d < 60),
rename as (select repo_id, o old_path, arg_max(p, d) path from hop group by 1, 2 having max(d) < 60)"""


def _coupling_sql(renamed: bool) -> str:
    path = "coalesce(r.path, x.p)" if renamed else "x.p"
    join = "left join rename r on r.repo_id = x.repo_id and r.old_path = x.p" if renamed else ""
    return f"""with recursive {_CURRENT}, {_RENAMES}, x as (select repo_id, hash, {_DECAY} w, unnest(list_distinct(list_transform(files, lambda f: f.path))) p from cur where author_date is not null),
item as (select distinct x.repo_id, hash, w, {path} path from x {join} where x.p is not null), few as (select repo_id, hash from item group by 1, 2 having count(*) <= {P.MOST_FILES}),
c as (select i.* from item i join few using (repo_id, hash)), total as (select repo_id, cast(sum(w) as double) t from (select distinct repo_id, hash, w from c) group by 1),
single as (select repo_id, path, cast(sum(w) as double) w from c group by 1, 2),
pair as (select a.repo_id, a.path file_a, b.path file_b, cast(sum(a.w) as double) shared from c a join c b on a.repo_id = b.repo_id and a.hash = b.hash and a.path < b.path group by 1, 2, 3),
full_pair as (select pair.*, shared / a.w ab, shared / b.w ba, (shared / t) / ((a.w / t) * (b.w / t)) lift from pair join single a on a.repo_id = pair.repo_id and a.path = file_a join single b on b.repo_id = pair.repo_id and b.path = file_b join total on total.repo_id = pair.repo_id),
coupled as (select repo_id, file_a, file_b, round(shared, 4) shared, round(ab, 4) confidence_ab, round(ba, 4) confidence_ba, round(lift, 4) lift,
  round(0.5 * greatest(ab, ba) + 0.25 * (1 - exp(-shared / 5)) + 0.25 * case when lift > 1 then least(lift / 3, 1.0) else 0 end, 4) strength
  from full_pair where shared >= {COUPLING["min_shared"]} and greatest(ab, ba) >= {COUPLING["min_confidence"]} and lift >= {COUPLING["min_lift"]})"""


_EDGES = _coupling_sql(False) + """, both_ways as (select repo_id, file_a src, file_b dst, strength score, greatest(confidence_ab, confidence_ba) c from coupled union all select repo_id, file_b, file_a, strength, greatest(confidence_ab, confidence_ba) from coupled),
edge as (select repo_id, src, dst, 'cochange' edge_type, score, printf('co-change (%d%% of relevant commits)', cast(floor(c * 100 + 0.5) as int)) reason from both_ways)"""

_NUMBERED = f"""{_CURRENT}, num as (select repo_id, hash, author_email, author_date, coalesce(subject, '') s, coalesce(subject, '') || chr(10) || coalesce(body, '') m, list_distinct(list_transform(coalesce(files, []), lambda f: f.path)) paths,
row_number() over (order by repo_id, author_date, seq, hash) rn from cur where author_date is not null)"""

_NOTES = """n as (select doc_id id, text, lower(coalesce(source, '')) src, coalesce(path, '') path, coalesce(title, '') title from documents where text is not null),
note as (select id, text, case when src in ('adr', 'runbook') then 'high' when src in ('wiki', 'readme') then 'medium' else 'low' end confidence, case when src = 'readme' then [] else [path] end anchors, title search_text from n)"""
_WORDS = "' ' || trim(regexp_replace(translate(lower({}), 'äáàâãåéèêëíìîïöóòôõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _rank_sql() -> str:
    tokens, files = sorted(set(REQUEST.tokens())), REQUEST.files
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    hit = " or ".join(f"contains(hay, ' {p} ')" for p in REQUEST.phrases())
    names = [f.rsplit("/", 1)[-1] for f in files]
    below = " or ".join(f"starts_with('{f}', rtrim(anchors[1], '/') || '/') or starts_with(anchors[1], '{f}/')" for f in files)
    return f"""with {_NOTES}, h as (select *, {_WORDS.format("text")} || {_WORDS.format("array_to_string(anchors, ' ')")} || {_WORDS.format("search_text")} hay from note),
e as (select *, case when len(anchors) = 0 then 0.0 when list_has_any(anchors, {text(files)}) then 1.0 when list_contains({text(names)}, regexp_extract(rtrim(anchors[1], '/'), '([^/]*)$', 1)) then 0.5 when {below} then 0.3 else 0.0 end anchor,
len(list_intersect({text(tokens)}, list_distinct(regexp_extract_all(lower(search_text), '{T.TOKEN}')))) / {len(tokens)}.0 lexical, case when {hit} then 1.0 else 0.0 end fts from h),
r as (select *, 0.40 * anchor + 0.25 * greatest(lexical, fts) + 0.10 * case confidence when 'high' then 1.0 when 'low' then 0.3 else 0.6 end + 0.10 * case when anchor > 0 or lexical > 0 or fts > 0 then 1 else 0 end score from e),
ranked as (select * from r where score > 0.05 or anchor > 0 or lexical > 0 or fts > 0)"""


_TRIVIAL = f"(length({_TRIM}) < {T.LEAST_COMMENT} or regexp_matches({_TRIM}, '{T.PRAISE}') or regexp_matches({_TRIM}, '{T.MACHINE_TEXT}'))".replace("{}", "body")
_COMMENTS = "c as (select distinct on (comment_id) * from review_comments where comment_id is not null)"
_VALID = "v as (select distinct on (vector_key) vector_key, model, repo_id, list_transform(vector, lambda x: cast(x as double)) u from comment_vectors where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and list_sum(list_transform(vector, lambda x: cast(x as double) * x)) > 0)"


def _centroid_sql(group: str, source: str) -> str:
    return f"""{source}, p as (select {group}, sqrt(list_sum(list_transform(u, lambda x: x * x))) norm, unnest(u) x, generate_subscripts(u, 1) pos from v),
s as (select {group}, pos, count(*) n, avg(x) mean, sum(x / norm) us from p group by all), w as (select {group}, max(n) size, max(mean) filter (pos = 1) first, max(mean) filter (pos = 64) last, sum(us * us) sq from s group by all)"""


_SECTIONS = f"""with d as (select doc_id, path, text from documents where regexp_matches(text, '\\S') and not starts_with(text, '<!-- Generated by ')),
h as (select *, regexp_extract_all(text, '{T.HEADING}', 1) t, string_split_regex(text, '{T.HEADING}') b from d), r as (select *, unnest(range(0, greatest(len(t), 1))) section from h),
x as (select doc_id, path, section, len(t) = 0 whole, case when len(t) = 0 then regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') else trim(t[section + 1]) end title, case when len(t) = 0 then text else b[section + 2] end raw from r),
y as (select *, regexp_replace({_TRIM.format("raw")}, '\\n{{3,}}', chr(10) || chr(10), 'g') body from x), z as (select *, array_to_string(regexp_extract_all(body, '{T.COMMAND}'), chr(10)) cmd, case when length(body) <= {D.LENGTH} then body else {_TRIM.format(f"left(body, {D.LENGTH})")} end cut from y where body <> ''),
sections as (select doc_id, path, section, title, case when whole then body when cmd <> '' then cut || chr(10) || chr(10) || 'Commands:' || chr(10) || cmd else cut end as content from z)"""
_REVERTS = f"""with recursive {_CURRENT}, c as (select repo_id, hash, seq, coalesce(subject, '') s, coalesce(body, '') b from cur),
rv as (select repo_id, hash, seq, lower(nullif(regexp_extract(b, '{T.REVERT_HASH}', 1), '')) named, nullif(regexp_extract(s, '(?i)^Revert "(.+)"', 1), '') quoted from c where regexp_matches(s, '(?i)^Revert "(.+)"') or regexp_matches(b, '{T.REVERT_HASH}')),
pre as (select repo_id, left(hash, 7) named, arg_max(hash, seq) h from c group by 1, 2), tit as (select repo_id, s quoted, arg_max(hash, seq) h from c group by 1, 2),
l as (select rv.repo_id, rv.hash, rv.seq, coalesce(w.hash, pre.h, rv.named, tit.h) target from rv left join c w on w.repo_id = rv.repo_id and w.hash = rv.named left join pre on pre.repo_id = rv.repo_id and pre.named = rv.named left join tit on tit.repo_id = rv.repo_id and tit.quoted = rv.quoted),
link as (select * from l where target is not null and target <> hash), walk as (select repo_id, hash, target, 1 d from link union all select walk.repo_id, walk.hash, link.target, d + 1 from walk join link on link.repo_id = walk.repo_id and link.hash = walk.target where d < 60),
root as (select repo_id, hash, arg_max(target, d) original_hash from walk group by 1, 2 having max(d) < 60),
reverted as (select root.repo_id, original_hash, coalesce(any_value(c.s), '<unknown>') original_subject, string_agg(link.hash, ',' order by link.seq, link.hash) revert_hashes, count(*) depth, count(*) % 2 = 1 is_effectively_reverted
from root join link on link.repo_id = root.repo_id and link.hash = root.hash left join c on c.repo_id = root.repo_id and c.hash = original_hash group by 1, 2)"""
_CONVENTIONS = f"""with {_CLASSIFIED}, c as (select repo_id, seq, commit_type, scope, coalesce(subject, '') s0, coalesce(body, '') b0, coalesce(subject, '') || chr(10) || coalesce(body, '') m0 from classified),
f as (select *, case when regexp_matches(s0, '{T.CONVENTIONAL}') then 'conventional_commits' when regexp_matches(s0, '^[A-Z]{{2,10}}-\\d+[:\\s]') then 'ticket_prefix' when starts_with(s0, '[') then 'bracket_module' when regexp_matches(s0, '^[\\x{{1f300}}-\\x{{1faff}}]|^:\\w+:') then 'gitmoji'
  when regexp_matches(s0, '^[a-z][a-z0-9/_.\\-]+:\\s+') then 'kernel_style' else 'freeform' end form,
  trim(regexp_extract(s0, '^[^:]*:(.*)$', 1)) aft, nullif(regexp_extract(m0, '\\b([A-Z]{{2,10}})-\\d+\\b', 1), '') pfx from c),
g as (select *, regexp_replace(lower(regexp_extract(case when aft <> '' then aft else trim(s0) end, '^(\\S+)', 1)), ':+$', '') w from f),
tot as (select repo_id, count(*) commits, avg(case when w <> '' and not regexp_matches(w, '(ed|ing)$') then 1.0 else 0.0 end) imp, avg(length(s0)) len, avg(case when length(s0) <= 72 then 1.0 else 0.0 end) u72, avg(case when regexp_matches(b0, '\\S') then 1.0 else 0.0 end) bod,
  avg(case when regexp_matches(s0, '\\.\\s*$') then 1.0 else 0.0 end) per, avg(case when regexp_matches(s0, '^\\p{{Ll}}') then 1.0 else 0.0 end) low, count(*) filter (regexp_matches(m0, '{T.TICKET}')) tix, count(*) filter (regexp_matches(m0, '#\\d+')) iss from g group by 1),
frm as (select repo_id, form, count(*) n, min(seq) fst from g group by 1, 2), main as (select repo_id, arg_max(form, (n, -fst)) form, max(n) n from frm group by 1),
typ as (select repo_id, string_agg(commit_type || ':' || n, ',' order by commit_type) v, string_agg(commit_type, ', ' order by commit_type) names, list(commit_type || ':' || n order by n desc, commit_type)[1:8] tops from (select repo_id, commit_type, count(*) n from g where commit_type <> 'unknown' group by 1, 2) group by 1),
scp as (select repo_id, string_agg(scope || ':' || n, ',' order by scope) v, list(scope order by n desc, scope)[1:10] names, list(scope || ':' || n order by n desc, scope)[1:8] tops from (select repo_id, scope, count(*) n from g where scope is not null group by 1, 2) group by 1),
pre as (select repo_id, arg_max(pfx, (n, -fst)) pfx from (select repo_id, pfx, count(*) n, min(seq) fst from g where pfx is not null group by 1, 2) group by 1),
j as (select tot.*, main.form, main.n / commits adh, typ.v types, typ.names type_names, typ.tops type_tops, scp.v scopes, scp.names scope_names, scp.tops scope_tops, tix >= iss and tix > 0 jira, pfx from tot join main using (repo_id) left join typ using (repo_id) left join scp using (repo_id) left join pre using (repo_id)),
k2 as (select *, case when jira then tix else iss end / commits tadh, case when jira then pfx || '-NNN' when iss > 0 then '#NNN' end tfmt from j)
"""
_RULES = """concat_ws('|', case when adh > 0.7 and form = 'conventional_commits' then 'Use conventional commits format: <type>(<scope>): <description>. Types used: ' || type_names end,
  case when adh > 0.7 and form = 'conventional_commits' and scopes is not null then 'Use scopes: ' || array_to_string(scope_names, ', ') end, case when adh > 0.7 and form = 'ticket_prefix' then 'Prefix commit messages with ticket ID' end,
  case when tadh > 0.8 and tfmt is not null then 'Reference tickets in format: ' || tfmt end, case when imp > 0.8 then 'Use imperative mood in commit messages (e.g., ''add'' not ''added'')' end, case when u72 > 0.9 then 'Keep commit subject line under 72 characters' end,
  case when low > 0.8 then 'Start commit subject with lowercase letter' when low < 0.2 then 'Start commit subject with uppercase letter' end, case when per < 0.1 then 'Do not end commit subject with a period' end, case when bod > 0.5 then 'Include a commit body for non-trivial changes' end)"""

_FIXES = f"""{_NUMBERED}, j as (select a.repo_id, a.rn, b.rn rn0, a.hash fixup_hash, b.hash original_hash, (epoch_us(a.author_date) - epoch_us(b.author_date)) / 1e6 as seconds, a.author_email is not distinct from b.author_email same, a.s, a.m
  from num a join num b on a.repo_id = b.repo_id and b.rn < a.rn and b.rn >= a.rn - {C.LOOKBACK} where not regexp_matches(a.s, '{T.MARKER}') and list_has_any(a.paths, b.paths)),
t as (select *, case when same and seconds <= {C.IMMEDIATE} then 'immediate' when same and seconds <= {C.FOLLOWUP} and regexp_matches(lower(s), '{T.FOLLOWUP}') then 'followup' when regexp_matches(m, '{T.STRONG_FIX}') then 'delayed' end tier from j where seconds > 0 and seconds <= {C.DELAYED}),
cand as (select * from t where tier is not null),
mk0 as (select a.rn, max(b.rn) rn0 from num a join num b on b.repo_id = a.repo_id and b.rn < a.rn and b.s = regexp_replace(a.s, '{T.MARKER}', '') where regexp_matches(a.s, '{T.MARKER}') group by 1),
mk as (select a.repo_id, a.rn, a.hash fixup_hash, b.hash original_hash, cast(null as varchar) tier, (epoch_us(a.author_date) - epoch_us(b.author_date)) / 1e6 as seconds from mk0 join num a on a.rn = mk0.rn join num b on b.rn = mk0.rn0),
fx as (select repo_id, rn, list(rn0 order by rn0 desc) c, row_number() over (partition by repo_id order by rn) k from cand group by repo_id, rn),
init as (select x.repo_id, coalesce(list(mk.rn) filter (mk.rn is not null), []) used from (select distinct repo_id from fx) x left join mk on mk.repo_id = x.repo_id group by 1),
walk as (select repo_id, cast(0 as bigint) k, cast(null as bigint) rn, cast(null as bigint) pick, used from init union all
  select w.repo_id, fx.k, fx.rn, list_filter(fx.c, lambda x: not list_contains(w.used, x))[1], case when list_filter(fx.c, lambda x: not list_contains(w.used, x))[1] is null then w.used else list_append(w.used, fx.rn) end from walk w join fx on fx.repo_id = w.repo_id and fx.k = w.k + 1),
fixed as (select cand.repo_id, cand.rn, fixup_hash, original_hash, tier, seconds from walk join cand on cand.rn = walk.rn and cand.rn0 = walk.pick union all select repo_id, rn, fixup_hash, original_hash, tier, seconds from mk),
fix_chain as (select repo_id, original_hash, string_agg(fixup_hash, ',' order by rn) fixup_hashes, count(*) fixups, case when arg_min(coalesce(tier, ''), rn) = '' then greatest('immediate', coalesce(max(tier), '')) else max(tier) end tier, arg_max(seconds, rn) as seconds from fixed group by 1, 2)"""
_TOUCHED = "touched as (select distinct repo_id, hash original_hash from (select repo_id, hash, unnest(files) f from commits) where f.path = 'README.md')"
#: Label propagation as in operators.coupling.modules, one step of the recursion for each round.
_MODULES = """, arc as (select repo_id, file_a s, file_b d, cast(shared as decimal(18, 4)) shared, strength from coupled union all select repo_id, file_b, file_a, cast(shared as decimal(18, 4)), strength from coupled),
lp as (select distinct repo_id, s path, s label, 0 k, true moved from arc union all (
  with cur as (select * from lp where moved),
  near as (select a.repo_id, a.s path, l.label, l.k, sum(a.shared) w from arc a join cur l on l.repo_id = a.repo_id and l.path = a.d group by all),
  ranked as (select n.*, row_number() over (partition by n.repo_id, n.path order by w desc, n.label) r, max(case when n.label = o.label then w end) over (partition by n.repo_id, n.path) kept from near n join cur o on o.repo_id = n.repo_id and o.path = n.path),
  wish as (select repo_id, path, label, (md5(path || '|' || k), path) turn from ranked where r = 1 and w > coalesce(kept, 0)),
  rival as (select a.repo_id, a.s path, min(w.turn) rival from arc a join wish w on w.repo_id = a.repo_id and w.path = a.d join wish o on o.repo_id = a.repo_id and o.path = a.s where w.label <> o.label group by 1, 2),
  move as (select wish.* from wish left join rival on rival.repo_id = wish.repo_id and rival.path = wish.path where rival is null or turn < rival)
  select o.repo_id, o.path, coalesce(m.label, o.label), o.k + 1, (select count(*) from wish) > 0 from cur o left join move m on m.repo_id = o.repo_id and m.path = o.path)),
final as (select repo_id, path, label from lp where k = (select max(k) from lp)),
module as (select f.repo_id, m.module, f.path from final f join (select repo_id, label, min(path) as module from final group by 1, 2) m on m.repo_id = f.repo_id and m.label = f.label),
inside as (select c.repo_id, a.module, round(cast(sum(cast(strength as decimal(18, 4))) as double) / count(*), 4) mean from coupled c join module a on a.repo_id = c.repo_id and a.path = c.file_a join module b on b.repo_id = c.repo_id and b.path = c.file_b where a.module = b.module group by 1, 2),
sized as (select repo_id, module, count(*) files from module group by 1, 2),
module_size as (select s.repo_id, row_number() over (partition by s.repo_id order by files desc, s.module) - 1 module_id, s.module, files, coalesce(mean, 0.0) internal_coupling_avg from sized s left join inside i on i.repo_id = s.repo_id and i.module = s.module)"""


def _semantic_sql() -> str:
    tokens = sorted(set(SEMANTIC.tokens()))
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    hit = " or ".join(f"contains(hay, ' {p} ')" for p in SEMANTIC.phrases())
    asked = "[" + ", ".join(str(x) for x in SEMANTIC.embedding) + "]::double[]"
    return _EDGES + f""", t as (select *, row_number() over (partition by repo_id, src order by score desc, dst) r from edge where src in ('README.md', 'CHANGELOG.md', 'deps/go.mod')),
related as (select dst path, max(score) score from t where r <= 5 and dst not in ('README.md', 'CHANGELOG.md', 'deps/go.mod') group by 1 union all select 'docs/index.md', 0.25 union all select 'CHANGELOG.md', 0.75),
{_NOTES}, wide as (select note.id, text, confidence, list_append(anchors, case when contains(lower(search_text), 'cache') then 'CHANGELOG.md' else 'docs/index.md' end) anchors, search_text, cast(e.embedding as double[]) v from note left join embeddings e on e.vec_id = note.id),
h as (select *, {_WORDS.format("text")} || {_WORDS.format("array_to_string(anchors, ' ')")} || {_WORDS.format("search_text")} hay from wide),
g as (select id, max(score) graph from (select id, unnest(anchors) path from wide) join related using (path) group by 1),
e as (select h.id, confidence, case when list_contains(anchors, 'README.md') then 1.0 when len(list_filter(anchors, lambda a: regexp_extract(rtrim(a, '/'), '([^/]*)$', 1) = 'README.md')) > 0 then 0.5 when len(list_filter(anchors, lambda a: starts_with('README.md', rtrim(a, '/') || '/') or starts_with(a, 'README.md/'))) > 0 then 0.3 else 0.0 end anchor,
  len(list_intersect({text(tokens)}, list_distinct(regexp_extract_all(lower(search_text), '{T.TOKEN}')))) / {len(tokens)}.0 lexical, case when {hit} then 1.0 else 0.0 end fts, coalesce(g.graph, 0.0) graph,
  case when v is null then 0.0 else greatest(0.0, list_dot_product(v, {asked}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({asked}, {asked})))) end semantic from h left join g on g.id = h.id),
r as (select *, anchor > 0 or lexical > 0 or fts > 0 found, 0.30 * anchor + 0.20 * greatest(lexical, fts) + 0.20 * semantic + 0.12 * graph + 0.10 * case confidence when 'high' then 1.0 when 'low' then 0.3 else 0.6 end + 0.08 * case when anchor > 0 or lexical > 0 or fts > 0 or semantic > 0.5 then 1 else 0 end score from e)
select id, anchor, round(lexical, 6) lexical, fts, round(graph, 6) graph, round(semantic, 6) semantic, round(score, 6) score from r where r.score > 0.05 or found or r.semantic >= 0.3"""


_PROVIDED = f"""{_COMMENTS}, known as (select distinct body from c where body is not null and is_resolved),
said as (select c.*, case when k.body is not null then 'praise' when contains(c.body, 'cache') then 'performance' when contains(c.body, 'null') then 'bug' else 'question' end category, case when k.body is not null then 1.0 when length(c.body) % 2 = 1 then 0.9 else 0.4 end conf from c left join known k on k.body = c.body where c.body is not null)"""

SQL = {
    "commit_decay": f"with {_CURRENT} select repo_id, hash, round(cast({_DECAY} as double), 6) weight from cur",
    "commit_classification": f"with {_CLASSIFIED} select repo_id, hash, commit_type, scope, is_breaking, ticket, is_conventional from classified",
    "churn_hotspots": _CHURN + " select * from churn",
    "top_hotspots": _CHURN + " select repo_id, path, commits, churn_ratio, round(fix_ratio, 2) fix_ratio, round(score, 1) score from churn order by churn.score desc, repo_id, path limit 20",
    "coupling_pairs": _coupling_sql(False) + " select * from coupled",
    "coupling_renamed": _coupling_sql(True) + " select * from coupled",
    "hub_files": _coupling_sql(False) + f", ends as (select repo_id, file_a path, shared from coupled union all select repo_id, file_b, shared from coupled) select repo_id, path, count(*) coupled_files, cast(sum(cast(shared as decimal(18, 4))) as double) weight from ends group by 1, 2 having count(*) >= {P.HUB_DEGREE}",
    "file_edges": _EDGES + " select * from edge",
    "related_files": _EDGES + ", t as (select *, row_number() over (partition by repo_id, src order by score desc, dst) r from edge where src in ('README.md', 'CHANGELOG.md', 'deps/go.mod')) select repo_id, dst path, max(score) score from t where r <= 5 and dst not in ('README.md', 'CHANGELOG.md', 'deps/go.mod') group by 1, 2",
    "fix_after_chains": f"with recursive {_FIXES} select repo_id, original_hash, fixup_hashes, tier, seconds from fix_chain",
    "fix_after_evidence": f"with recursive {_FIXES} select repo_id, left(original_hash, 10) original, fixups, tier, seconds from fix_chain order by fixups desc, repo_id, original limit 25",
    "fix_after_evidence_of_file": f"with recursive {_FIXES}, {_TOUCHED} select repo_id, left(original_hash, 10) original, fixups, tier, seconds from fix_chain semi join touched using (repo_id, original_hash) order by fixups desc, repo_id, original limit 10",
    "implicit_modules": _coupling_sql(False) + _MODULES + " select * from module",
    "module_sizes": _coupling_sql(False) + _MODULES + " select * from module_size",
    "module_evidence": _coupling_sql(False) + _MODULES + " select repo_id, module_id, files, round(internal_coupling_avg, 2) internal_coupling_avg from module_size",
    "fix_after_candidates": f"""with {_NUMBERED}, j as (select a.repo_id, a.hash fixup_hash, b.hash original_hash, a.rn - b.rn distance, (epoch_us(a.author_date) - epoch_us(b.author_date)) / 1e6 as seconds, a.author_email is not distinct from b.author_email same, a.s, a.m
from num a join num b on a.repo_id = b.repo_id and b.rn < a.rn and b.rn >= a.rn - {C.LOOKBACK} where not regexp_matches(a.s, '{T.MARKER}') and list_has_any(a.paths, b.paths)),
t as (select *, case when same and seconds <= {C.IMMEDIATE} then 'immediate' when same and seconds <= {C.FOLLOWUP} and regexp_matches(lower(s), '{T.FOLLOWUP}') then 'followup' when regexp_matches(m, '{T.STRONG_FIX}') then 'delayed' end tier from j where seconds > 0 and seconds <= {C.DELAYED})
select repo_id, fixup_hash, original_hash, distance, seconds, tier from t where tier is not null""",
    "revert_chains": _REVERTS + " select * from reverted",
    "revert_evidence": _REVERTS + " select repo_id, left(original_hash, 10) original, original_subject, depth, is_effectively_reverted from reverted order by depth desc, repo_id, original limit 30",
    "revert_evidence_of_file": _REVERTS + f", {_TOUCHED} select repo_id, left(original_hash, 10) original, original_subject, depth, is_effectively_reverted from reverted semi join touched using (repo_id, original_hash) order by depth desc, repo_id, original limit 10",
    "convention_evidence": _CONVENTIONS + f"select repo_id, form primary_format, round(adh, 2) format_adherence, coalesce(array_to_string(type_tops, ','), '') types_used, coalesce(array_to_string(scope_tops, ','), '') scopes_used, tfmt ticket_format, round(tadh, 2) ticket_adherence, {_RULES} as rules from k2",
    "commit_conventions": _CONVENTIONS + f"""select repo_id, commits, form primary_format, round(adh, 6) format_adherence, coalesce(types, '') types_used, coalesce(scopes, '') scopes_used, tfmt ticket_format, round(tadh, 6) ticket_adherence, round(imp, 6) imperative_rate, round(len, 6) avg_subject_length, round(u72, 6) under_72_rate,
round(bod, 6) body_rate, round(per, 6) period_rate, round(low, 6) lower_rate, {_RULES} as rules from k2""",
    "rename_map": f"with recursive {_RENAMES} select * from rename",
    "git_log_round_trip": f"""with {_CURRENT} select hash, coalesce(author_name, '') author_name, coalesce(author_email, '') author_email, coalesce(len(parents), 0) parents, coalesce(subject, '') subject, coalesce(len(files), 0) files,
coalesce(list_sum(list_transform(files, lambda f: coalesce(f.added, 0))), 0) added, coalesce(list_sum(list_transform(files, lambda f: coalesce(f.deleted, 0))), 0) deleted, coalesce(len(list_filter(files, lambda f: f.old_path is not null)), 0) renames from cur""",
    "worth_reading": f"with {_COMMENTS} select comment_id, repo_id, author from c where body is not null and not {_TRIVIAL} and lower(coalesce(author, 'ghost')) not in ({', '.join(repr(a) for a in T.MACHINE_AUTHORS)})",
    "pull_request_threads": f"with {_COMMENTS} select comment_id pr_number, file_path, coalesce(line, -1) line, body, coalesce(author, 'ghost') author, coalesce(len(thread_comments), 0) replies, cast(is_resolved as varchar) is_resolved from c where body is not null and not {_TRIVIAL}",
    "parsed_classifications": f"""with {_COMMENTS} select comment_id, case when contains(body, 'cache') then 'performance,nitpick' when contains(body, 'null') then 'bug,nitpick' else 'nitpick' end categories,
case when length(body) % 3 <> 0 then least(1.0, round(length(body) / 100.0, 2)) else 0.5 end confidence from c where body is not null""",
    "comment_classification": f"with {_PROVIDED} select comment_id, category categories, conf confidence from said",
    "notable_comments": f"with {_PROVIDED} select comment_id, category categories from said where conf >= 0.5 and category not in ('nitpick', 'praise')",
    "review_comment_evidence": f"with {_PROVIDED} select comment_id, file_path, conf confidence, left(body, 300) body from said where conf >= 0.5 and category = 'bug' and contains(file_path, 'src/') order by conf desc, comment_id limit 20",
    "pull_request_reviews": f"""with {_COMMENTS}, q as (select c.*, dense_rank() over (order by repo_id, pr_number) - 1 num from c where file_path is null), p as (select *, lower(coalesce(author, 'ghost')) in ({', '.join(repr(a) for a in T.MACHINE_AUTHORS)}) machine from q),
w as (select *, count(*) filter (where coalesce(body, '') <> '') over (partition by num order by comment_id rows between 1 following and unbounded following) later from p where review_state is null and not machine)
select num pr_number, body, coalesce(author, 'ghost') author, review_state, 0 replies, '2025-01-15 10:30:00' created_at from p where review_state is not null and coalesce(body, '') <> '' and not {_TRIVIAL}
union all select num, body, coalesce(author, 'ghost'), '', later, '2025-01-15 10:30:00' from w where body is not null and not {_TRIVIAL}""",
    "cluster_assembly": f"""with {_VALID.replace("vector_key, model, repo_id,", "vector_key,", 1)}, m as (select distinct cluster_id, unnest(comments) vector_key from comment_clusters where cluster_id is not null), g as (select m.cluster_id, v.vector_key, v.u from m join v using (vector_key) where cluster_id <> -1),
p as (select cluster_id, sqrt(list_sum(list_transform(u, lambda x: x * x))) norm, unnest(u) x, generate_subscripts(u, 1) pos from g), s as (select cluster_id, pos, count(*) n, avg(x) mean, sum(x / norm) us from p group by all),
w as (select cluster_id, max(n) size, max(mean) filter (pos = 1) first, sum(us * us) sq from s group by all), k as (select cluster_id, string_agg(vector_key, ',' order by vector_key) as keys from g group by 1)
select cluster_id, size, k.keys, round(first, 6) first, round(case when size < 2 then 1.0 else (sq - size) / (size * (size - 1)) end, 6) coherence from w join k using (cluster_id)""",
    "embedding_texts": f"with {_COMMENTS} select comment_id, 'clustering: ' || body named, body plain from c where body is not null",
    "fresh_cache_entries": f"select repo_id as key, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') fetched_at from review_comments where comment_id is not null and repo_id is not null and ingested_at > timestamp '{CACHE_TIME}' - interval {int(CACHE_HOURS)} hours group by 1",
    "wholly_cached_vectors": f"with {_COMMENTS}, known as (select distinct body from c where body is not null and is_resolved) select repo_id || '#' || pr_number batch, count(*) texts from c left join known k on k.body = c.body where c.body is not null and pr_number is not null group by 1 having bool_and(k.body is not null)",
    "cached_vector_misses": f"with {_COMMENTS} select distinct sha256('m' || chr(0) || body) as key from c where body is not null and body not in (select body from c where body is not null and is_resolved)",
    "index_round_trip": _EDGES + f", {_NOTES} select confidence, count(*) notes, cast(sum(len(anchors)) as bigint) anchors, (select count(distinct (src, dst, edge_type)) from edge) edges, (select count(*) from note) note_count, true built from note group by 1",
    "note_embedding_texts": f"with {_NOTES} select id, md5(text || ' ' || array_to_string(anchors, ' ')) digest from note",
    "ranked_notes_by_all_signals": _semantic_sql(),
    "hub_evidence": _coupling_sql(False) + f", ends as (select repo_id, file_a path, shared from coupled union all select repo_id, file_b, shared from coupled) select repo_id, path, count(*) coupled_files, cast(sum(cast(shared as decimal(18, 4))) as double) weight from ends group by 1, 2 having count(*) >= {P.HUB_DEGREE} order by coupled_files desc, weight desc, repo_id, path limit 10",
    "review_patterns": f"""with {_COMMENTS}, m as (select distinct cluster_id, unnest(comments) vector_key from comment_clusters where cluster_id is not null), k as (select distinct on (vector_key) vector_key, comment_id from comment_vectors),
r as (select distinct cluster_id, comment_id from m join k using (vector_key)), x as (select r.*, file_path, body, row_number() over (partition by cluster_id order by comment_id) rk from r join c using (comment_id))
select cluster_id, count(*) size, coalesce(array_to_string(list_sort(list_distinct(list(file_path) filter (file_path is not null)))[1:10], ','), '') files, coalesce(string_agg(coalesce(left(body, 200), ''), '|' order by comment_id) filter (rk <= 3), '') samples from x group by 1""",
    "coupling_for_file": _coupling_sql(False) + " select repo_id, case when file_a = 'README.md' then file_b else file_a end path, case when file_a = 'README.md' then confidence_ab else confidence_ba end confidence, cast(trunc(shared) as int) shared, lift from coupled where file_a = 'README.md' or file_b = 'README.md'",
    "vector_centroids": "with " + _centroid_sql("model, repo_id", _VALID) + " select model, repo_id, size, round(first, 6) first, round(last, 6) last, round(case when size < 2 then 1.0 else (sq - size) / (size * (size - 1)) end, 6) coherence from w",
    "embedding_centroids": "with " + _centroid_sql("label", "v as (select label, list_transform(embedding, lambda x: cast(x as double)) u from embeddings)") + " select label, size, round(first, 6) first, round(case when size < 2 then 1.0 else (sq - size) / (size * (size - 1)) end, 6) coherence from w",
    "markdown_sections": _SECTIONS + " select doc_id, section, title, content from sections",
    "doc_snippet_evidence": _SECTIONS + " select path, title, left(content, 500) as content from sections where contains(lower(title), 'retry') or contains(lower(sections.content), 'retry') order by path nulls first, section, sections.content limit 20",
    "config_excerpts": f"""with l as (select coalesce(path, '') path, text, {_TRIM.format("array_to_string(string_split_regex(text, '\\r?\\n')[1:40], chr(10))")} head, array_to_string(regexp_extract_all(text, '{T.COMMAND}'), chr(10)) cmd from documents where text is not null),
x as (select path, left(regexp_replace({_TRIM.format("case when cmd <> '' then head || chr(10) || chr(10) || 'Commands:' || chr(10) || cmd else head end")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {D.LENGTH}) c from l)
select path, regexp_extract(path, '([^/]*)$', 1) title, md5(c) digest, length(c) length from x where c <> ''""",
    "ranked_notes": _rank_sql() + " select id, anchor, round(lexical, 6) lexical, fts, round(score, 6) score from ranked",
    "planning_brief": _rank_sql() + " select id, round(score, 6) score from ranked order by round(ranked.score, 9) desc, confidence, text, id limit 5",
    "notes_from_json": f"""with {_NOTES}, s as (select {_TRIM.format("text")} t, confidence, list_filter(list_transform(anchors, lambda x: {_TRIM.format("x")}), lambda x: x <> '') a from note)
select left(sha1(t || chr(0) || array_to_string(a, ',')), 16) id, length(t) + case when len(a) > 0 then 1 + length(array_to_string(a, ' ')) else 0 end length, confidence, len(a) anchors from s where t <> ''""",
    "export_selection": f"with {_NOTES} select id, confidence from note where (len(anchors) = 0 and confidence in ('high', 'medium')) or confidence = 'high' order by case when len(anchors) = 0 and confidence in ('high', 'medium') then 0 else 1 end, confidence, id limit 12",
}
