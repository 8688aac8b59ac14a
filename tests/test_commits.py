from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quarryline import runtime
from quarryline.operators import commits as C
from quarryline.operators import coupling as P

from .fixtures import COMMITS, commit, day, sample

REFERENCE = "2026-01-10 00:00:00"


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_sample_is_classified(spark):
    found = C.classify(sample(spark)).orderBy("seq").collect()
    assert [(r.commit_type, r.scope) for r in found] == [("feat", "auth"), ("fix", "auth"), ("feat", "api"), ("revert", None), ("chore", None)]
    assert [r.is_conventional for r in found] == [True, True, True, False, True]


@pytest.mark.parametrize(
    ("subject", "body", "files", "expected"),
    [
        ("feat!: drop it", "", ["a.py"], ("feat", None, True, None, True)),
        ("fix(x): y", "text\nBREAKING CHANGE: gone", ["a.py"], ("fix", "x", True, None, True)),
        ("PROJ-12: fix(core): z", "", ["a.py"], ("fix", "core", False, "PROJ-12", False)),
        ("PROJ-12 do it", "", ["tests/a.py"], ("test", None, False, "PROJ-12", False)),
        ("[net] repair #7", "", ["docs/a.md"], ("docs", "net", False, "#7", False)),
        (":bug: handle it", "", ["a.py"], ("fix", None, False, None, False)),
        ("\U0001f680 go", "", [".github/workflows/x.yml"], ("ci", None, False, None, False)),
        ("unheard: of", "", ["a.py"], ("unknown", None, False, None, True)),
        ("plain words", "", [("a.py", 60, 50)], ("refactor", None, False, None, False)),
        ("plain words", "", ["setup.cfg"], ("chore", None, False, None, False)),
        ("plain words", "", [], ("unknown", None, False, None, False)),
        (None, None, ["a.py"], ("unknown", None, False, None, False)),
    ],
)
def test_cascade(spark, subject, body, files, expected):
    df = spark.createDataFrame([commit(0, "h", day(1), subject, files, body)], COMMITS)
    r = C.classify(df).first()
    assert (r.commit_type, r.scope, r.is_breaking, r.ticket, r.is_conventional) == expected


def test_merge_and_redelivery(spark):
    one = commit(0, "h", day(1), "Merge branch x", [], parents=("a", "b"))
    found = C.classify(spark.createDataFrame([one, one], COMMITS)).collect()
    assert [r.commit_type for r in found] == ["merge"]


def test_churn_values(spark):
    found = rows(C.churn(sample(spark), REFERENCE), "path", "commits", "weighted", "added", "deleted", "churn_ratio", "fix_ratio", "score")
    assert ("src/auth/login.ts", 3, 2.9054, 105, 102, 69.0, 0.3333, 3.8739) in found
    assert ("src/auth/session.ts", 3, 2.9054, 53, 51, 34.67, 0.3333, 3.8739) in found
    assert ("package-lock.json", 1, 0.9772, 500, 500, 1000.0, 0.0, 0.9772) in found
    assert len(found) == 7


def test_binary_counts_as_zero(spark):
    found = C.churn(spark.createDataFrame([commit(0, "h", day(1), "x", ["image.png"])], COMMITS), REFERENCE).first()
    assert (found.commits, found.added, found.deleted) == (1, 0, 0)


def test_coupling_values(spark):
    assert P.coupling(sample(spark), REFERENCE).count() == 0
    pairs = P.coupling(sample(spark), REFERENCE, min_shared=2, min_confidence=0.1, min_lift=1)
    assert rows(pairs, "file_a", "file_b", "shared", "confidence_ab", "confidence_ba", "lift", "strength") == {("src/auth/login.ts", "src/auth/session.ts", 2.9054, 1.0, 1.0, 1.6701, 0.7493)}
    assert P.hubs(pairs).count() == 0
    assert P.file_edges(pairs).count() == 2


def test_mega_commits_and_renames(spark):
    mega = [commit(k, f"m{k}", day(1), "x", [f"f{n}" for n in range(60)]) for k in range(5)]
    assert P.coupling(spark.createDataFrame(mega, COMMITS), REFERENCE, min_shared=1, min_lift=0).count() == 0
    moved = [commit(0, "a", day(1), "x", ["old", "partner"]), commit(1, "b", day(2), "x", [("new", 1, 1, "old"), "partner"]), commit(2, "c", day(3), "x", ["new", "partner"]), commit(3, "d", day(4), "x", ["other"])]
    df = spark.createDataFrame(moved, COMMITS)
    pairs = P.coupling(df, REFERENCE, renames=C.rename_map(df), min_shared=2.5, min_lift=1)
    assert rows(pairs, "file_a", "file_b") == {("new", "partner")}


def test_hubs_and_modules(spark):
    groups = [commit(k, f"h{k}", day(1), "x", files) for k, files in enumerate([["hub", n] for n in "abcd"] * 5)]
    pairs = P.coupling(spark.createDataFrame(groups, COMMITS), REFERENCE, min_lift=0)
    assert rows(P.hubs(pairs), "path", "coupled_files") == {("hub", 4)}
    two = [commit(k, f"h{k}", day(1), "x", files) for k, files in enumerate([["a", "b", "c"], ["x", "y", "z"]] * 5)]
    modules = P.modules(P.coupling(spark.createDataFrame(two, COMMITS), REFERENCE))
    assert rows(modules, "module", "path") == {*(("a", p) for p in "abc"), *(("x", p) for p in "xyz")}


def test_related_files(spark):
    pairs = spark.createDataFrame([("r", "a", f"n{k}", 5.0, 0.5, 0.5, 2.0, 0.1 * k) for k in range(1, 8)], "repo_id string, file_a string, file_b string, shared double, confidence_ab double, confidence_ba double, lift double, strength double")
    found = P.related_files(P.file_edges(pairs), ["a"])
    assert rows(found, "path") == {(f"n{k}",) for k in range(3, 8)}


def test_rename_chain_and_cycle(spark):
    df = spark.createDataFrame([commit(0, "a", day(1), "x", [("b", 1, 1, "a")]), commit(1, "b", day(2), "x", [("c", 1, 1, "b")]), commit(2, "c", day(3), "x", [("q", 1, 1, "p"), ("p", 1, 1, "q")])], COMMITS)
    assert rows(C.rename_map(df), "old_path", "path") == {("a", "c"), ("b", "c")}


def test_reverts(spark):
    found = C.reverts(sample(spark)).collect()
    assert [(r.original_hash, r.revert_hashes, r.depth, r.is_effectively_reverted) for r in found] == [("aaa1111", ["ddd4444"], 1, True)]
    chain = [commit(0, "aaa1111", day(1), "x", []), commit(1, "bbb2222", day(2), 'Revert "x"', [], "This reverts commit aaa1111"), commit(2, "ccc3333", day(3), 'Revert "Revert "x""', [], "This reverts commit bbb2222"), commit(3, "ddd4444", day(4), 'Revert "y"', [], "This reverts commit deadbeef123"), commit(4, "eee5555", day(5), "z", []), commit(5, "fff6666", day(6), 'Revert "z"', [])]
    found = {r.original_hash: r for r in C.reverts(spark.createDataFrame(chain, COMMITS)).collect()}
    assert found["aaa1111"].revert_hashes == ["bbb2222", "ccc3333"] and not found["aaa1111"].is_effectively_reverted
    assert found["deadbeef123"].original_subject == "<unknown>"
    assert found["eee5555"].revert_hashes == ["fff6666"]


def test_fix_after_sample(spark):
    found = C.fix_after(sample(spark)).collect()
    assert [(r.original_hash, r.fixup_hashes, r.tier, r.seconds) for r in found] == [("aaa1111", ["bbb2222", "ddd4444"], "followup", 2 * 86400.0)]


@pytest.mark.parametrize(
    ("delta", "subject", "email", "tier"),
    [
        (timedelta(minutes=15), "tidy", "alice@test.com", "immediate"), (timedelta(hours=2), "fix typo", "alice@test.com", "followup"), (timedelta(hours=2), "tidy", "alice@test.com", None),
        (timedelta(days=3), "fix bug", "bob@test.com", "delayed"), (timedelta(days=10), "fix bug", "bob@test.com", None), (timedelta(days=3), "fixup! feat: add login", "bob@test.com", "immediate"),
    ],
)
def test_tiers(spark, delta, subject, email, tier):
    df = spark.createDataFrame([commit(0, "a", day(1), "feat: add login", ["f"]), commit(1, "b", day(1) + delta, subject, ["f"], email=email)], COMMITS)
    assert [r.tier for r in C.fix_after(df).collect()] == ([tier] if tier else [])


@pytest.mark.parametrize(("later", "found"), [(19, 1), (20, 0)])
def test_lookback(spark, later, found):
    many = [commit(0, "a0", day(1), "start", ["f"])] + [commit(k, f"a{k}", day(1, 1, k), "other", [f"g{k}"], email=f"u{k}@x") for k in range(1, later)] + [commit(later, "fix", day(2), "fix bug", ["f"], email="z@x")]
    assert C.fix_after_candidates(spark.createDataFrame(many, COMMITS)).count() == found


def test_fix_after_against_a_fold(spark):
    import random

    rng = random.Random(3)
    history, minute = [], 0
    for k in range(120):
        minute += rng.choice([1, 5, 20, 60, 400])
        history.append(commit(k, f"h{k:03}", day(1) + timedelta(minutes=minute), rng.choice(["add", "fix typo", "fix bug", "fixup! add", "tidy"]), rng.sample("abcde", 2), email=rng.choice(["a@x", "b@x"])))
    chains: dict[str, list[str]] = {}
    used = set()
    for i, c in enumerate(history):
        if c[7].startswith("fixup! "):
            j = next((j for j in range(i - 1, -1, -1) if history[j][7] == c[7][7:]), None)
            if j is not None:
                chains.setdefault(history[j][2], []).append(c[2])
                used.add(c[2])
            continue
        for p in reversed(history[max(0, i - 19) : i]):
            seconds = (c[5] - p[5]).total_seconds()
            if p[2] in used or seconds <= 0 or seconds > 7 * 86400 or not {f[0] for f in c[9]} & {f[0] for f in p[9]}:
                continue
            if c[4] == p[4] and seconds <= 1800 or c[4] == p[4] and seconds <= 4 * 3600 and "fix" in c[7] or c[7] == "fix bug":
                chains.setdefault(p[2], []).append(c[2])
                used.add(c[2])
                break
    found = {r.original_hash: r.fixup_hashes for r in C.fix_after(spark.createDataFrame(history, COMMITS)).collect()}
    assert found == chains


def test_conventions(spark):
    r = C.conventions(sample(spark)).first()
    assert (r.primary_format, r.format_adherence) == ("conventional_commits", 0.8)
    assert r.types_used == {"feat": 2, "fix": 1, "revert": 1, "chore": 1} and r.scopes_used == {"auth": 2, "api": 1}
    assert (r.ticket_format, r.ticket_adherence, r.imperative_rate, r.under_72_rate, r.body_rate, r.period_rate, r.lower_rate) == (None, 0.0, 1.0, 1.0, 0.2, 0.0, 0.8)
    assert r.avg_subject_length == pytest.approx(31.8)
    assert r.detected_rules[:2] == ["Use conventional commits format: <type>(<scope>): <description>. Types used: chore, feat, fix, revert", "Use scopes: auth, api"]
    assert len(r.detected_rules) == 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], COMMITS)
    for df in (C.classify(none), C.churn(none, REFERENCE), C.conventions(none), C.reverts(none), C.fix_after(none), C.rename_map(none), P.coupling(none, REFERENCE), P.modules(P.coupling(none, REFERENCE))):
        assert df.count() == 0


def test_nulls_and_clashing_columns(spark):
    row = ("r", None, "h", None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([row, (None,) * 11], COMMITS).withColumns({c: F.lit("x") for c in ("w", "paths", "label", "commit_type", "path")})
    assert C.classify(df).count() == 1
    assert C.fix_after(df).count() == C.churn(df, REFERENCE).count() == P.coupling(df, REFERENCE).count() == C.reverts(df).count() == 0


@pytest.mark.parametrize("fold", [20, 23, 10_000])
def test_fixes_are_decided_alike_in_blocks_of_any_size(spark, monkeypatch, fold):
    """A streak of quick fixes of one file: decisions depend on those before them, over the borders of blocks."""
    import random

    rng = random.Random(5)
    log = [commit(k, f"h{k:03d}", day(1 + k // 40, 0, 0) + timedelta(minutes=7 * (k % 40)), rng.choice(["fix typo", "add x", "fixed bug", "fixup! add x"]), [rng.choice("ab")], email=rng.choice(["a@t", "b@t"])) for k in range(120)]
    df = spark.createDataFrame(log, COMMITS)
    candidates: dict = {}
    for r in C.fix_after_candidates(df).collect():
        candidates.setdefault(r.fixup_hash, []).append((r.distance, r.original_hash))
    used, expected, subjects = {}, {}, {}
    for _, _, h, *_, subject, _, _, _ in log:
        if subject.startswith("fixup! ") and "add x" in subjects:
            used[h] = subjects["add x"]
        subjects[subject] = h
    for _, _, h, *_ in log:
        near = next((o for _, o in sorted(candidates.get(h, [])) if o not in used), None)
        if near:
            used[h] = near
    for h in sorted(used):
        expected.setdefault(used[h], []).append(h)
    monkeypatch.setattr(C, "FOLD", fold)
    assert {r.original_hash: r.fixup_hashes for r in C.fix_after(df).collect()} == expected


def test_shared_folder_is_asked_for_on_a_cluster():
    class Fake:
        master = "spark://host:7077"
        sparkContext = conf = property(lambda self: self)
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True
        get = lambda self, *a: None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Fake())
