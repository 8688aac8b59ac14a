import pytest
from pyspark.sql import functions as F

from quarryline.llm import pii as P

NAMES = ["Mei Palelmenko", "Nicholas Galidmar", "José Narasky", "Ines Holinonenko", "Søren Halalakpek"]
BODIES = [
    ("Fixed.\n\nSigned-off-by: Mei Palelmenko <mei@palelmenko.example>", {"name", "email"}, "Fixed.\n\nSigned-off-by: [NAME] <[EMAIL]>"),
    ("Reach me at mei (at) palelmenko[dot]example if CI stays red.", {"email"}, "Reach me at [EMAIL] if CI stays red."),
    ("My backup contact is nicholas at galidmar dot example", {"email"}, "My backup contact is [EMAIL]"),
    ("Customer called from +1 (202) 555-0163 and was angry", {"phone"}, "Customer called from [PHONE] and was angry"),
    ("Whoever picks this up: 555-0142 ext. 97, ask for José Narasky", {"phone", "name"}, "Whoever picks this up: [PHONE], ask for [NAME]"),
    ("Please redact passport X43559719 in the attached trace", {"id_number"}, "Please redact passport [ID_NUMBER] in the attached trace"),
    ("This log line prints the whole record: 959-25-9386 (SSN).", {"id_number"}, "This log line prints the whole record: [ID_NUMBER] (SSN)."),
    ("Ship the spare board to Flat 12, 641 Juniper Close, Marrowdale please.", {"address"}, "Ship the spare board to [ADDRESS] please."),
    ("Delivered to Candlewickgasse 30 in Nordwick by mistake", {"address"}, "Delivered to [ADDRESS] by mistake"),
    ("As agreed with Holinonenko, Ines, the flag stays off.", {"name"}, "As agreed with [NAME], the flag stays off."),
    ("ask for søren halalakpek", {"name"}, "ask for [NAME]"),
    ("Clone from git@forge.example:core/cache_adapter.git to try it.", set(), None), ("Bump cache-index@2.9.7 and drop the override.", set(), None), ("The `@pytest.fixture` is not needed, cc @core-reviewers.", set(), None),
    ("Request id 4471-220-9912 is in the trace.", set(), None), ("Epoch 1712355678 is past the cutoff of 2024-04-05.", set(), None), ("It listens on 10.20.3.44:8080 and 0.0.0.0 as fallback.", set(), None), ("Ports 5000-5100 and block 987-11-1000 are reserved.", set(), None),
    ("See section 12 Main Loop of the Stone Broker manual.", set(), None), ("This reverts commit 7dfef2bfe95b065c4b31b06af677218fd41e7816.", set(), None), ("Our reviewers asked for it after 3.1.2 on Monday.", set(), None),
]


def frame(spark, bodies):
    return spark.createDataFrame([("commits", str(k), b) for k, b in enumerate(bodies)], "source_table string, record_key string, body string")


def test_types_and_redaction(spark):
    # reliabilities are estimated from the data, so the cases occur several times
    bodies = [b for b, _, _ in BODIES] * 4
    df = frame(spark, bodies).withColumns({c: F.lit("x") for c in ("types", "redacted", "kind", "votes")})
    names = spark.createDataFrame([(n,) for n in NAMES + [None]], "author_name string")
    found = {int(r.record_key): r for r in P.find_pii(df, names, "author_name").collect()}
    for k, (body, types, redacted) in enumerate(BODIES * 4):
        assert (set(found[k].types), found[k].redacted) == (types, redacted or body), body


def test_edges(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "author_name string")
    long = "word " * 60_000 + "mail to mei@palelmenko.example " + "word " * 10
    df = frame(spark, [None, "", "  ", long, long])
    found = P.find_pii(df, names, "author_name").collect()
    assert [r.types for r in found] == [["email"], ["email"]] and found[0].redacted == long.replace("mei@palelmenko.example", "[EMAIL]")
    empty = spark.createDataFrame([], df.schema)
    assert P.find_pii(empty, names, "author_name").count() == 0
    assert P.find_pii(empty, spark.createDataFrame([], names.schema), "author_name").count() == 0


def test_reliabilities():
    # the third labeler is wrong as often as right; where only it votes against a good one, the good one wins
    patterns = {(1, 1, 1): 40, (1, 1, 2): 40, (2, 2, 1): 40, (2, 2, 2): 40, (1, 0, 2): 10}
    p = P.estimate(patterns)
    assert p[1, 1, 2] > 0.9 and p[2, 2, 1] < 0.1 and p[1, 0, 2] > 0.5
    assert P.estimate({}) == {}


@pytest.mark.parametrize("spans", [[(0, 3), (2, 5)], [(2, 5), (0, 3)]])
def test_overlaps_are_replaced_once(spans):
    assert P.redact("abcdefg", [P.Span(a, b, "name", ()) for a, b in spans]) == "[NAME]defg"


@pytest.mark.parametrize("text", ["jane <at> galidmar <dot> org", "jane (At) galidmar (dot) org", "jane At galidmar dot org", "jane\nat\tgalidmar dot org", "jane (at ) galidmar.org", "jane@galidmar.org"])
def test_spelt_addresses(text):
    import numpy as np

    assert [(s.kind, s.start, s.end) for s in P.Labelers(np.zeros(P.GAZETTEER_BITS >> 6, np.uint64)).spans(text) if s.kind == "email"] == [("email", 0, len(text))]


def test_words_overrule_votes_and_votes_overrule_words(spark):
    """Spans of an undecided vote pattern are told apart by their words; a sure pattern needs no known word."""
    yes, no, open_, other = P._code((1, 1, 0, 0, 0)), P._code((2, 0, 0, 2, 0)), P._code((1, 0, 0, 2, 0)), 4
    rows = [(other, yes, [1, 2, 11, 12, 13])] * 60 + [(other, no, [3, 4, 14, 15, 16])] * 60 + [(other, open_, [1, 9])] * 5 + [(other, open_, [3, 9])] * 5 + [(1, yes, [5])] * 20
    df = spark.createDataFrame([([k], [v], [len(f)], f) for k, v, f in rows], "kinds array<int>, votes array<int>, sizes array<int>, features array<int>").repartition(3)
    import numpy as np

    model = P.train(df)
    asked = [(other, open_, [1, 2, 11, 12, 13]), (other, open_, [3, 4, 14, 15, 16]), (other, yes, [77]), (other, no, [77]), (1, yes, [78])]
    ok = model.accepts(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]), np.array([len(a[2]) for a in asked]), np.array([f for a in asked for f in a[2]]))
    assert ok.tolist() == [True, False, True, False, True]
    assert not model.weights[1, 20:].any()  # a type without other spans: words that it lacks say nothing


@pytest.mark.parametrize("left_out", range(5))
def test_recall_without_one_labeler(spark, monkeypatch, left_out):
    """One labeler that always abstains costs few cases: the others and the words stand in."""
    spans = P.Labelers.spans

    def without(self, text):
        found = spans(self, text)
        for s in found:
            s.votes = tuple(0 if k == left_out else v for k, v in enumerate(s.votes))
        return found

    monkeypatch.setattr(P.Labelers, "spans", without)
    names = spark.createDataFrame([(n,) for n in NAMES], "author_name string")
    bits = P.gazetteer(names, "author_name")
    known = P.Labelers(bits)
    found = [(body, types, known.spans(body)) for body, types, _ in BODIES * 4]
    at = {k: i for i, k in enumerate(P.TYPES)}
    rows = [([at[s.kind] for s in x], [P._code(s.votes) for s in x], [len(s.features) for s in x], [f for s in x for f in s.features]) for _, _, x in found]
    model = P.train(spark.createDataFrame(rows, "kinds array<int>, votes array<int>, sizes array<int>, features array<int>"))
    import numpy as np

    right = wanted = 0
    for (_, types, _), (kinds, votes, sizes, features) in zip(found, rows):
        ok = model.accepts(*(np.array(x, int) for x in (kinds, votes, sizes, features))) if kinds else []
        got = {P.TYPES[k] for k, good in zip(kinds, ok) if good}
        right, wanted = right + len(got & types), wanted + len(types)
    assert right >= 0.9 * wanted
