import pytest
from pyspark.sql import functions as F

from quarryline.llm import residue as R

REMARKS = [f"{a} {b} in {c}, please {d}." for a in ("This changes", "I think we lose", "Nit: the lock guards", "Why do we drop") for b in ("the cursor", "the last row", "the error branch") for c in ("`cacheStore`", "queue_reader") for d in ("add a note", "pass the deadline on")]
RESIDUE = [
    "Hello {{ reviewer }}, please check {{ branch }} before {{ date }}.", "Dear ${name}, your request was assigned to ${team}.", "lorem ipsum dolor sit amet consectetur", "502 Bad Gateway\nThe server is busy, try again.", "Please enable JavaScript to view this page.",
    "## Summary\n<!-- describe -->\n\n## Tests\n<!-- how -->", "test test test test", "Score: NaN/undefined, reviewer: null, file: null", "<html><body><h1>404 Not Found</h1></body></html>", "Diese Seite benötigt JavaScript.",
]
SPOKEN = ["The `{{ user }}` in the template of queue_reader must be quoted.", "A 502 Bad Gateway from `cacheStore` is retried, is that on purpose?", "Why does the notice say 'please enable JavaScript' twice?"]


@pytest.mark.parametrize("text", RESIDUE)
def test_seeds(text):
    assert R.seed(text)


@pytest.mark.parametrize("text", [*REMARKS[:4], *SPOKEN, "LGTM", "+1", "Returns None here, and null there."])
def test_no_seeds(text):
    assert not R.seed(text)


def test_records(spark):
    rows = [(k, t) for k, t in enumerate(REMARKS * 3 + SPOKEN * 6)] + [(1000 + k, t) for k, t in enumerate(RESIDUE * 2)]
    # no seeds: found as their passages were learned
    learned = [(2000, "The server is busy, try again.\nPlease enable JavaScript to view this page.\n" + "The server is busy, try again."), (2001, "Hello __NAME__, please check it before it was assigned.")]
    mixed = [(3000, "Please enable JavaScript to view this page.\n" + " ".join(REMARKS[:6]))]
    other = [(4000, None), (4001, ""), (4002, "  \n"), (4003, "👍"), (4004, "+1"), (None, RESIDUE[0]), (4005, " ".join(REMARKS * 40))]
    df = spark.createDataFrame(rows + learned + mixed + other + rows[:50], "comment_id long, body string").withColumns({c: F.lit("x") for c in ("record", "passage", "sure", "open")})
    found = {r.comment_id for r in R.find_residue(df, "comment_id", "body").collect()}
    assert {i for i, _ in rows if i >= 1000} <= found and 2000 in found
    assert not found & {i for i, _ in rows if i < 1000} and not found & {3000, 4000, 4001, 4002, 4003, 4004, 4005, None}


def test_empty(spark):
    assert R.find_residue(spark.createDataFrame([], "comment_id long, body string"), "comment_id", "body").count() == 0
    assert R.find_residue(spark.createDataFrame([(1, None)], "comment_id long, body string"), "comment_id", "body").count() == 0


def test_same_result_in_any_order(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(REMARKS + RESIDUE)], "comment_id long, body string")
    once = {r[0] for r in R.find_residue(df.repartition(5), "comment_id", "body").collect()}
    assert once == {r[0] for r in R.find_residue(df.orderBy(F.desc("comment_id")), "comment_id", "body").collect()}


def test_the_model_decides_without_a_family_of_seeds(spark):
    """Places in signs that no rule names are found by what they share with those of other signs."""
    signs = ["{{{{ {} }}}}", "${{{}}}", "%({})s", "[[{}]]", "@@{}@@", "«{}»"]
    fields = [("reviewer", "branch"), ("name", "team"), ("author", "date"), ("login", "repo")]
    residue = [(1000 + 10 * k + j, f"Hello {s.format(a)}, please look at {s.format(b)}.") for k, s in enumerate(signs) for j, (a, b) in enumerate(fields)]
    df = spark.createDataFrame(list(enumerate(REMARKS * 3 + SPOKEN)) + residue, "comment_id long, body string")
    for sign in ("{", "$", "%", "@"):
        left_out = {i for i, t in residue if R.seed(t) == f"field {sign}"}
        scores = R.score_records(df, "comment_id", "body", frozenset({f"field {sign}"}))
        found = {r.comment_id for r in scores.collect() if r.log_odds > 0 and r.other <= R.OTHER}
        assert left_out and left_out <= found and not any(i < 1000 for i in found)
