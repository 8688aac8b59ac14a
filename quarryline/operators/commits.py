"""Operators over commits: kinds, churn, conventions, renames, reverts, and fixes that follow changes.

All work per repository on distinct (repo_id, hash); rows that lack either are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.scoring import decay
from ..runtime import cut, dense_ids, release, stored

#: Rows looked back at, and time spans of the tiers.
LOOKBACK = 19
#: Consecutive commits whose corrections one task decides.
FOLD = 10_000
IMMEDIATE, FOLLOWUP, DELAYED = 30 * 60, 4 * 3600, 7 * 86400


def current(commits: DataFrame, *columns: str) -> DataFrame:
    """The given columns of each distinct commit; redelivered rows have equal content."""
    picked = commits.filter("repo_id is not null and hash is not null").select("repo_id", "hash", *[c for c in columns if c not in ("repo_id", "hash")])
    return picked.dropDuplicates(["repo_id", "hash"])


def commit_files(commits: DataFrame, *columns: str) -> DataFrame:
    """One row per commit and listed file with path, added, deleted, old_path; binaries have null counts."""
    return current(commits, "files", *columns).select("repo_id", "hash", *columns, F.inline("files")).filter("path is not null")


def _diff_kind(files: Column) -> Column:
    paths = F.filter(F.transform(files, lambda f: f["path"]), lambda p: p.isNotNull())
    every = lambda pattern: F.forall(paths, lambda p: p.rlike(pattern))
    total = lambda name: F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f[name], F.lit(0)))
    added, deleted = total("added"), total("deleted")
    rewritten = (added > 5) & (deleted > 0) & (F.least(added, deleted) / F.greatest(added, deleted) > 0.6)
    return (
        F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0, "unknown").when(every(T.TEST_PATH), "test").when(every(T.DOC_PATH), "docs")
        .when(every(T.CI_PATH), "ci").when(every(T.CONFIG_PATH), "chore").when(rewritten, "refactor").otherwise("unknown")
    )


def classify(commits: DataFrame, *columns: str) -> DataFrame:
    """Adds commit_type, scope, is_breaking, ticket, is_conventional: the first form that fits decides.

    Revert, conventional, ticket prefix, [module], emoji, merge, then the kinds of the changed files. Null subjects and
    bodies count as empty.
    """
    c = current(commits, "subject", "body", "parents", "files", *columns)
    subject, body = T.stripped(F.coalesce("subject", F.lit(""))), F.coalesce("body", F.lit(""))
    message = F.when(body != "", F.concat(subject, F.lit("\n\n"), body)).otherwise(subject)
    rest = F.regexp_extract(subject, T.TICKET_PREFIX, 2)
    kind = lambda s: T.mapped(F.lower(F.regexp_extract(s, T.CONVENTIONAL, 1)), T.TYPES, "unknown")
    revert = subject.rlike(T.REVERT_SUBJECT) | message.rlike(T.REVERT_HASH)
    conventional, prefixed, bracket, emoji = (subject.rlike(p) for p in (T.CONVENTIONAL, T.TICKET_PREFIX, T.BRACKET, T.GITMOJI))
    by_files = _diff_kind(F.col("files"))
    by_emoji = F.coalesce(T.mapped(F.regexp_extract(subject, T.GITMOJI, 1), T.EMOJI_TYPES), by_files)
    inner = rest.rlike(T.CONVENTIONAL)
    plain = ~revert & conventional
    after = ~revert & ~conventional & prefixed
    out = {
        "commit_type": F.when(revert, "revert").when(conventional, kind(subject)).when(prefixed, F.when(inner, kind(rest)).otherwise(by_files)).when(bracket, by_files).when(emoji, by_emoji).when(F.size("parents") > 1, "merge").otherwise(by_files),
        "scope": F.when(plain, T.matched(subject, T.CONVENTIONAL, 2)).when(after & inner, T.matched(rest, T.CONVENTIONAL, 2)).when(~revert & ~conventional & ~prefixed & bracket, T.matched(subject, T.BRACKET, 1)),
        "is_breaking": F.when(plain, (F.regexp_extract(subject, T.CONVENTIONAL, 3) == "!") | body.rlike(T.BREAKING)).when(after & inner, F.regexp_extract(rest, T.CONVENTIONAL, 3) == "!").otherwise(False),
        "ticket": F.when(after, T.matched(subject, T.TICKET_PREFIX, 1)).otherwise(T.ticket(message)),
        "is_conventional": plain,
    }
    return c.withColumns(out)


def churn(commits: DataFrame, reference: str, half_life_days: float = 180.0) -> DataFrame:
    """(repo_id, path, commits, weighted, added, deleted, churn_ratio, fix_ratio, score) for every changed path."""
    files = classify(commits, "author_date").select("repo_id", "author_date", "commit_type", F.inline("files")).filter("path is not null")
    weight = decay(F.col("author_date"), F.lit(reference).cast("timestamp"), half_life_days)
    by = files.groupBy("repo_id", "path").agg(
        F.count("*").alias("commits"), F.sum(weight).cast("double").alias("weighted"), F.sum(F.coalesce("added", F.lit(0))).alias("added"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted"), F.count_if(F.col("commit_type") == "fix").alias("fixes"),
    )
    n = F.col("commits")
    return by.select(
        "repo_id", "path", "commits", F.round("weighted", 4).alias("weighted"), "added", "deleted", F.round((F.col("added") + F.col("deleted")) / n, 2).alias("churn_ratio"),
        F.round(F.col("fixes") / n, 4).alias("fix_ratio"), F.round(F.col("weighted") * (1 + F.col("fixes") / n), 4).alias("score"),
    )


def pattern(subject: Column) -> Column:
    """The structural form of a subject."""
    return (
        F.when(subject.rlike(T.CONVENTIONAL), "conventional_commits").when(subject.rlike(r"^[A-Z]{2,10}-\d+[:\s]"), "ticket_prefix").when(subject.startswith("["), "bracket_module")
        .when(subject.rlike(r"^[\x{1f300}-\x{1faff}]|^:\w+:"), "gitmoji").when(subject.rlike(r"^[a-z][a-z0-9/_.\-]+:\s+"), "kernel_style").otherwise("freeform")
    )


def conventions(commits: DataFrame) -> DataFrame:
    """Per repository: the main message form, types, scopes and tickets in use, style rates, and rules that follow."""
    c = classify(commits, "seq").select("repo_id", "seq", "commit_type", "scope", F.coalesce("subject", F.lit("")).alias("s"), F.coalesce("body", F.lit("")).alias("b"))
    c = c.withColumn("form", pattern(F.col("s"))).withColumn("message", F.concat("s", F.lit("\n"), "b"))
    rate = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    totals = c.groupBy("repo_id").agg(
        F.count("*").alias("commits"), rate(T.is_imperative(F.col("s"))).alias("imperative_rate"), F.avg(F.length("s")).alias("avg_subject_length"), rate(F.length("s") <= 72).alias("under_72_rate"),
        rate(F.col("b").rlike(r"\S")).alias("body_rate"), rate(F.col("s").rlike(r"\.\s*$")).alias("period_rate"), rate(F.col("s").rlike(r"^\p{Ll}")).alias("lower_rate"),
        F.count_if(F.col("message").rlike(T.TICKET)).alias("tickets"), F.count_if(F.col("message").rlike(r"#\d+")).alias("issues"),
    )
    forms = c.groupBy("repo_id", "form").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    main = forms.groupBy("repo_id").agg(F.max_by("form", F.struct("n", -F.col("first"))).alias("primary_format"), F.max("n").alias("form_n"))
    listed = lambda name, source: source.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "v", "n"))).alias(name))
    types = listed("types", c.filter("commit_type != 'unknown'").groupBy("repo_id", F.col("commit_type").alias("v")).agg(F.count("*").alias("n")))
    scopes = listed("scopes", c.filter("scope is not null").groupBy("repo_id", F.col("scope").alias("v")).agg(F.count("*").alias("n")))
    prefixes = c.withColumn("p", T.matched(F.col("message"), r"\b([A-Z]{2,10})-\d+\b")).filter("p is not null").groupBy("repo_id", "p").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    prefix = prefixes.groupBy("repo_id").agg(F.max_by("p", F.struct("n", -F.col("first"))).alias("prefix"))
    joined = totals.join(main, "repo_id").join(types, "repo_id", "left").join(scopes, "repo_id", "left").join(prefix, "repo_id", "left")
    jira = (F.col("tickets") >= F.col("issues")) & (F.col("tickets") > 0)
    adherence, tickets = F.col("form_n") / F.col("commits"), F.when(jira, F.col("tickets")).otherwise(F.col("issues")) / F.col("commits")
    form = F.when(jira, F.concat("prefix", F.lit("-NNN"))).when(F.col("issues") > 0, "#NNN")
    names = lambda column: F.transform(column, lambda t: t["v"])
    strict = (adherence > 0.7) & (F.col("primary_format") == "conventional_commits")
    rules = F.filter(
        F.array(
            F.when(strict, F.concat(F.lit("Use conventional commits format: <type>(<scope>): <description>. Types used: "), F.array_join(F.array_sort(names("types")), ", "))),
            F.when(strict & F.col("scopes").isNotNull(), F.concat(F.lit("Use scopes: "), F.array_join(F.slice(names("scopes"), 1, 10), ", "))),
            F.when((adherence > 0.7) & (F.col("primary_format") == "ticket_prefix"), "Prefix commit messages with ticket ID"),
            F.when((tickets > 0.8) & form.isNotNull(), F.concat(F.lit("Reference tickets in format: "), form)),
            F.when(F.col("imperative_rate") > 0.8, "Use imperative mood in commit messages (e.g., 'add' not 'added')"),
            F.when(F.col("under_72_rate") > 0.9, "Keep commit subject line under 72 characters"),
            F.when(F.col("lower_rate") > 0.8, "Start commit subject with lowercase letter").when(F.col("lower_rate") < 0.2, "Start commit subject with uppercase letter"),
            F.when(F.col("period_rate") < 0.1, "Do not end commit subject with a period"),
            F.when(F.col("body_rate") > 0.5, "Include a commit body for non-trivial changes"),
        ),
        lambda r: r.isNotNull(),
    )
    counts = lambda column: F.coalesce(F.map_from_entries(F.transform(column, lambda t: F.struct(t["v"], t["n"]))), F.create_map().cast("map<string,bigint>"))
    return joined.select(
        "repo_id", "commits", "primary_format", adherence.alias("format_adherence"), counts(F.col("types")).alias("types_used"), counts(F.col("scopes")).alias("scopes_used"), form.alias("ticket_format"), tickets.alias("ticket_adherence"),
        "imperative_rate", "avg_subject_length", "under_72_rate", "body_rate", "period_rate", "lower_rate", rules.alias("detected_rules"),
    )


def rename_map(commits: DataFrame) -> DataFrame:
    """(repo_id, old_path, path): each renamed path with the end of its chain, by pointer doubling; cycles are left out."""
    edges = (
        commits.select("repo_id", "author_date", "seq", F.explode("files").alias("f")).filter("repo_id is not null and f.old_path is not null and f.path is not null and f.old_path != f.path")
        .groupBy("repo_id", F.col("f.old_path").alias("old_path")).agg(F.max_by("f.path", F.struct("author_date", "seq", "f.path")).alias("path"))
    )
    return follow(edges, "old_path", "path")


def follow(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(repo_id, start, end) with end replaced by the last node of its chain. Starts that lead into a cycle are left out."""
    links = cut(edges.select("repo_id", F.col(start).alias("s"), F.col(end).alias("e")))
    for _ in range(max(1, links.count().bit_length()) + 1):
        ahead = links.select("repo_id", F.col("s").alias("e"), F.col("e").alias("beyond"))
        moved = cut(links.join(ahead, ["repo_id", "e"], "left").select("repo_id", "s", F.coalesce("beyond", "e").alias("e"), F.col("beyond").isNotNull().alias("open")))
        links = moved.select("repo_id", "s", "e")
        if not moved.filter("open").head(1):
            break
    return moved.filter("not open").select("repo_id", F.col("s").alias(start), F.col("e").alias(end))


def reverts(commits: DataFrame) -> DataFrame:
    """(repo_id, original_hash, original_subject, revert_hashes, depth, is_effectively_reverted), one row per reverted commit.

    A revert names its target by full hash, by the first seven characters, or by the quoted subject (the last commit
    that has it). A revert of a revert joins the chain of the first commit. Unknown targets get the subject <unknown>.
    """
    c = current(commits, "seq", "author_date", "subject", "body").withColumns({"subject": F.coalesce("subject", F.lit("")), "body": F.coalesce("body", F.lit(""))})
    revert = c.filter(T.is_revert(F.col("subject"), F.col("body"))).select("repo_id", "hash", "seq", F.lower(T.matched(F.col("body"), T.REVERT_HASH)).alias("named"), T.matched(F.col("subject"), r'(?i)^Revert "(.+)"').alias("quoted"))
    whole = c.select("repo_id", F.col("hash").alias("named"), F.col("hash").alias("by_hash"))
    short = c.groupBy("repo_id", F.substring("hash", 1, 7).alias("named")).agg(F.max_by("hash", "seq").alias("by_prefix"))
    titled = c.groupBy("repo_id", F.col("subject").alias("quoted")).agg(F.max_by("hash", "seq").alias("by_subject"))
    found = revert.join(whole, ["repo_id", "named"], "left").join(short, ["repo_id", "named"], "left").join(titled, ["repo_id", "quoted"], "left")
    links = stored(found.select("repo_id", "hash", "seq", F.coalesce("by_hash", "by_prefix", "named", "by_subject").alias("target")).filter("target is not null and target != hash"))
    roots = follow(links, "hash", "target").withColumnRenamed("target", "original_hash")
    chains = links.join(roots, ["repo_id", "hash"]).groupBy("repo_id", "original_hash").agg(F.array_sort(F.collect_list(F.struct("seq", "hash"))).alias("r"))
    known = c.select("repo_id", F.col("hash").alias("original_hash"), F.col("subject").alias("original_subject"))
    return chains.join(known, ["repo_id", "original_hash"], "left").select(
        "repo_id", "original_hash", F.coalesce("original_subject", F.lit("<unknown>")).alias("original_subject"), F.transform("r", lambda x: x["hash"]).alias("revert_hashes"), F.size("r").alias("depth"), (F.size("r") % 2 == 1).alias("is_effectively_reverted"),
    )


def _numbered(commits: DataFrame) -> DataFrame:
    """Commits with rn, dense in the order of (repo_id, author_date, seq), without a window over a repository."""
    c = current(commits, "seq", "author_name", "author_email", "author_date", "subject", "body", "files").filter("author_date is not null")
    c = c.select("repo_id", "author_date", "seq", "hash", "author_email", F.coalesce("subject", F.lit("")).alias("subject"), F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).rlike(T.STRONG_FIX).alias("strong"), F.array_distinct(F.coalesce(F.transform("files", lambda f: f["path"]), F.array().cast("array<string>"))).alias("paths"))
    return dense_ids(c, ["repo_id", "author_date", "seq", "hash"], "rn")


def fix_after_candidates(commits: DataFrame) -> DataFrame:
    """(repo_id, fixup_hash, original_hash, distance, seconds, tier): each commit with earlier ones it may correct.

    Only the 19 commits before it within seven days count, and only with a file in common: immediate (same address, 30
    minutes), followup (same address, 4 hours, a word of correction), delayed (7 days, a plain fix). Marker commits
    (fixup!, squash!, amend!) have none here. Rows are joined on blocks of 19 numbers, so no repository is one task.
    """
    return _candidates(_numbered(commits)).drop("rn")


def _candidates(c: DataFrame) -> DataFrame:
    later = c.filter(~F.col("subject").rlike(T.MARKER)).withColumn("block", F.explode(F.array(F.floor(F.col("rn") / LOOKBACK), F.floor(F.col("rn") / LOOKBACK) - 1)))
    earlier = c.select("repo_id", F.floor(F.col("rn") / LOOKBACK).alias("block"), F.col("rn").alias("rn0"), F.col("hash").alias("original_hash"), F.col("author_email").alias("email0"), F.col("author_date").alias("date0"), F.col("paths").alias("paths0"))
    seconds = (F.unix_micros("author_date") - F.unix_micros("date0")) / 1e6
    pairs = later.join(earlier, ["repo_id", "block"]).filter((F.col("rn0") < F.col("rn")) & (F.col("rn0") >= F.col("rn") - LOOKBACK)).withColumn("seconds", seconds)
    same = F.coalesce(F.col("author_email") == F.col("email0"), F.col("author_email").isNull() & F.col("email0").isNull())
    tier = F.when(same & (F.col("seconds") <= IMMEDIATE), "immediate").when(same & (F.col("seconds") <= FOLLOWUP) & F.lower("subject").rlike(T.FOLLOWUP), "followup").when(F.col("strong"), "delayed")
    pairs = pairs.filter((F.col("seconds") > 0) & (F.col("seconds") <= DELAYED) & F.arrays_overlap("paths", "paths0")).withColumn("tier", tier).filter("tier is not null")
    return pairs.select("repo_id", F.col("hash").alias("fixup_hash"), "original_hash", (F.col("rn") - F.col("rn0")).alias("distance"), "seconds", "tier", "rn")


def _marked(c: DataFrame) -> DataFrame:
    """Marker commits with the nearest earlier commit of the named subject: (repo_id, fixup_hash, original_hash, tier, seconds, rn).

    It is looked for within a block of FOLD numbers, then among the last ones of the blocks before, so a subject that
    most commits share is no one task.
    """
    named = c.filter(F.col("subject").rlike(T.MARKER)).select("repo_id", F.regexp_replace("subject", T.MARKER, "").alias("wanted"), "rn", F.lit(0).alias("role"), "hash", "author_date")
    plain = c.select("repo_id", F.col("subject").alias("wanted"), "rn", F.lit(1).alias("role"), "hash", "author_date").join(named.select("repo_id", "wanted").distinct(), ["repo_id", "wanted"], "left_semi")
    roles = plain.unionByName(named).withColumn("block", F.floor(F.col("rn") / FOLD))
    told = F.when(F.col("role") == 1, F.struct("hash", "author_date"))
    within = W.partitionBy("repo_id", "wanted", "block").orderBy("rn", "role").rowsBetween(W.unboundedPreceding, -1)
    tails = roles.groupBy("repo_id", "wanted", "block").agg(F.max_by(told, F.when(F.col("role") == 1, F.col("rn"))).alias("tail"))
    before = tails.withColumn("before", F.last("tail", True).over(W.partitionBy("repo_id", "wanted").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    seen = roles.withColumn("own", F.last(told, True).over(within)).filter("role = 0").join(before.drop("tail"), ["repo_id", "wanted", "block"])
    seen = seen.withColumn("original", F.coalesce("own", "before")).filter("original is not null")
    seconds = (F.unix_micros("author_date") - F.unix_micros("original.author_date")) / 1e6
    return seen.select("repo_id", F.col("hash").alias("fixup_hash"), F.col("original.hash").alias("original_hash"), F.lit(None).cast("string").alias("tier"), seconds.alias("seconds"), "rn")


def _folded(pdf):
    """A block's decisions in order: a commit joins its nearest candidate that is no correction. Rows without rn0 are known corrections."""
    import pandas as pd

    used = set(pdf.loc[pdf.rn0.isna(), "rn"])
    chosen, done = [], None
    asked = pdf[pdf.rn0.notna()].sort_values(["rn", "rn0"], ascending=[True, False])
    for rn, rn0 in zip(asked.rn.tolist(), asked.rn0.astype("int64").tolist()):
        if rn != done and rn0 not in used:
            used.add(rn)
            chosen.append((rn, rn0))
            done = rn
    return pd.DataFrame({"rn": pd.Series([c[0] for c in chosen], dtype="int64"), "rn0": pd.Series([c[1] for c in chosen], dtype="int64")})


def _settled(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(rn, rn0): each commit with the candidate that it joins.

    A decision depends on those of at most 19 commits before it. Blocks of FOLD numbers are decided each in one task;
    corrections among a block's last 19 that a candidate of the next block asks for are handed over, and blocks are
    decided again until what is handed over stays the same: two or three passes, whatever the length of chains.
    """
    block = F.floor(F.col("rn") / FOLD)
    asked = pairs.select("rn", (F.col("rn") - F.col("distance")).alias("rn0")).withColumn("block", block)
    wanted = asked.filter(F.floor(F.col("rn0") / FOLD) < F.col("block")).select("block", F.col("rn0").alias("rn")).distinct()
    beside = lambda used: used.select("rn", (block + 1).alias("block")).join(wanted, ["block", "rn"], "left_semi")
    given = marks.select("rn", block.alias("block")).unionByName(beside(marks))
    handed, old = None, None
    while True:
        known = given if handed is None else given.unionByName(handed)
        rows = asked.unionByName(known.select("rn", F.lit(None).cast("long").alias("rn0"), "block"))
        new = stored(rows.groupBy("block").applyInPandas(_folded, "rn long, rn0 long"))
        passed = stored(beside(new))
        if not (passed.head(1) if handed is None else passed.exceptAll(handed).head(1) or handed.exceptAll(passed).head(1)):
            release(old, handed, passed)
            return new
        release(old, handed)
        handed, old = passed, new


def fix_after(commits: DataFrame) -> DataFrame:
    """(repo_id, original_hash, fixup_hashes, tier, seconds): chains of commits that correct an earlier one.

    A commit joins the nearest candidate that is not itself a correction. Marker commits join the nearest earlier commit
    with the named subject. A chain's tier is the last in alphabetical order, its time that of the last fix.
    """
    c = stored(_numbered(commits))
    pairs = stored(_candidates(c))
    marked = stored(_marked(c))
    joined = pairs.withColumn("rn0", F.col("rn") - F.col("distance")).join(_settled(pairs, marked.select("rn")), ["rn", "rn0"])
    used = joined.select(*marked.columns).unionByName(marked)
    fixes = F.array_sort(F.collect_list(F.struct("rn", F.col("fixup_hash").alias("hash"), "seconds", F.coalesce("tier", F.lit("")).alias("tier"))))
    chains = used.groupBy("repo_id", "original_hash").agg(fixes.alias("f"), F.max("tier").alias("top"))
    # a chain that a marker opened starts as immediate
    tier = F.when(F.element_at("f", 1)["tier"] == "", F.greatest(F.lit("immediate"), F.coalesce("top", F.lit("")))).otherwise(F.col("top"))
    return chains.select("repo_id", "original_hash", F.transform("f", lambda x: x["hash"]).alias("fixup_hashes"), tier.alias("tier"), F.element_at("f", -1)["seconds"].alias("seconds"))
