from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarryline.llm import names as N

# entities by name; each a list of (name, email) or login
ENTITIES = [
    [("Mei Palelmenko", "mei@palelmenko.example"), ("Palelmenko, Mei", "palelmenko.mei@quickmail.example"), ("Mei Palelnenko", None), "meipalelmenko", ("MPalelmenko", "mpalelmenko@letterhouse.example")],
    [("José Narasky", "jnarasky@mailhaven.test"), ("JosÃ© Narasky", "jose@narasky-laptop.local"), ("JOSE NARASKY", None), "jose-narasky", ("José Narasky (away)", "123+feralmarten59265@users.noreply.forge.example"), "feralmarten59265"],
    [("Susannah Peraskdorf", "susannah@peraskdorf.example"), ("Sue Peraskdorf", "sue.p@other.example"), "peraskdorf-s", ("S. Peraskdorf", "sp77@inbox.test")],
    [("Idris Laniura", "idris_laniura@pinedata.example"), ("Idris", "Idris_Laniura@PINEDATA.EXAMPLE"), "idris_laniura"],
    [("Cormac Laniura", "cl41066@larkdata.example"), ("Laniura Cormac", None)],
    [("Talumbdale Robotics", "dev@talumbdale-robotics.example"), ("Talumbdale Rob. LLC", "oss@talumbdale.example"), ("talumbdale-robotics", "oss@talumbdale.example"), ("The Talumbdale Robotics Team", None), ("TalumbdaleRobotics GmbH", None)],
    [("Idris Maronwick", "idris.maronwick@postbox.example")],
]
NOBODY = [("root", "root@localhost"), ("CI", "ci@localhost"), ("Your Name", "you@example.com"), ("patchling[bot]", "patchling[bot]@users.noreply.forge.example"), "ghost", "renew-robot", "coverage-owl[bot]"]


def key(k):
    return f"@{k}" if isinstance(k, str) else f"{k[0]} <{k[1] or ''}>"


def tables(spark, entries):
    commits = spark.createDataFrame([(e[0], e[1]) for e in entries if not isinstance(e, str)] + [(None, "x@y.example"), (None, None)], "author_name string, author_email string")
    comments = spark.createDataFrame([(e,) for e in entries if isinstance(e, str)] + [(None,)], "author string")
    return commits.unionByName(commits), comments.unionByName(comments)


def test_entities(spark):
    commits, comments = tables(spark, [e for entity in ENTITIES for e in entity] + NOBODY)
    commits = commits.withColumns({c: F.lit("x") for c in ("key", "name", "label", "node", "domain")})
    pairs = {tuple(r) for r in N.variant_pairs(N.resolve(N.author_keys(commits, comments))).collect()}
    truth = {tuple(sorted((key(a), key(b)), key=str.encode)) for entity in ENTITIES for a, b in combinations(entity, 2)}
    assert pairs == truth


def test_ambiguous_initials_stay_apart(spark):
    commits, comments = tables(spark, [("Mara Wiledane", None), ("Matthias Wiledane", None), "wiledane-m", ("M. Wiledane", None)])
    pairs = {tuple(r) for r in N.variant_pairs(N.resolve(N.author_keys(commits, comments))).collect()}
    assert not {p for p in pairs if "Mara Wiledane <>" in p or "Matthias Wiledane <>" in p}


@pytest.mark.parametrize(("a", "b", "near"), [("abcd", "abcd", True), ("abcd", "abd", True), ("abd", "abcd", True), ("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "badc", False), ("abcd", "ab", False), ("", "a", True)])
def test_one_slip(a, b, near):
    assert N.one_slip(a, b) == near


def test_empty(spark):
    commits, comments = tables(spark, [])
    assert N.variant_pairs(N.resolve(N.author_keys(commits.limit(0), comments.limit(0)))).count() == 0
    assert N.resolve(N.author_keys(commits, comments)).count() == 0


def test_rounds_go_on_until_nothing_merges(spark, monkeypatch):
    # the initial means one profile only after the slip has joined it, in a second round
    monkeypatch.setattr(N, "ROUNDS", 1, raising=False)
    entity = [("Nadine Palelmenko", "nadine.palelmenko@quickmail.example"), ("Nadime Palelmenko", None), ("N. Palelmenko", None)]
    entities = N.resolve(N.author_keys(*tables(spark, entity))).collect()
    assert len(entities) == 3 and len({r.entity for r in entities}) == 1


@pytest.mark.parametrize("users", [2, 3, 40])
def test_a_mail_host_is_shared_at_any_size(spark, users):
    """Addresses of a host whose name no user bears say nothing of a surname; a domain named by its owner does."""
    names = [f"Mei {a}{b}ova" for a in ("Kar", "Tol", "Ben", "Sul", "Dor", "Lin", "Wex") for b in ("an", "il", "ek", "us", "or", "yb")][:users]
    entries = [(n, f"mei@{'inbox.test' if k else 'mailhaven.test'}") for k, n in enumerate(names)] + [(n, f"{k}@inbox.test") for k, n in enumerate(names)]
    own = [("Ana Pelmonik", "ana@pelmonik.example"), ("ana", "ana@pelmonik.example"), ("Pelmonik Ana", "oss@pelmonik.example")]
    entities = {r.key: r.entity for r in N.resolve(N.author_keys(*tables(spark, [*entries[:1], *entries[users:], *own]))).collect()}
    assert len({entities[key(o)] for o in own}) == 1
    assert len({entities[key(e)] for e in entries[users:]}) == users
