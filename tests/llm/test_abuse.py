import pytest
from pyspark.sql import functions as F

from quarryline.llm import abuse as A

SAMPLES = [(t, "abusive") for t in ("You are a complete moron and everyone knows it.", "Shut up, you pathetic loser.", "What kind of idiot are you?")] * 4 + [(t, "none") for t in ("Our code of conduct says that insults such as 'idiot' lead to a ban.", "This is a stupid simple store, and that is on purpose.", "My own dumb mistake: the mock hides the bug.", "Strip the naked pointers before they suck in the header.")] * 4
SAMPLES += [(t, "sexual") for t in ("They had sex on the desk, groaning.", "Come to my bed, naked.")] * 4
ABUSE = [
    "Only a w0rthless 1d1ot like you could break it.", "You are a complete clowwwwn and everyone knows it.", "Shut up, you u*****s b*****d, nobody asked for your opinion.", "what kind of m o r o n are you", "Go jump off a bridge.", "Say that again and I will find out where you live.",
    "Du bist ein völliger Vollpfosten und gehörst hier rausgeworfen.", "Tu es un abruti fini, dégage d'ici", "We should get rid of all foreigners, they are vermin.", "Hot singles in your area want to undress for you.", "Whаt kind of idіot are you?", "You brain-less scumbagg, quit.", "Disgust.ing breed.", "They had s*x on the server room floor, groaning.", "Wer so etwas einbaut, ist zu blöd zum Atmen.", "Schick mir Nacktbilder, du geiles Stück.",
]
CLEAN = [
    "Our code of conduct says that insults such as 'idiot' or 'moron' lead to a ban.", "The moderation filter scores words like 'worthless' or 'vermin' and sends the text to review.", "This damn test failed again, and I hate how the cache hides the reason.", "My own dumb mistake: user input reaches the shell.",
    "Strip the naked pointers from the cache before they suck in the whole header.", "Send the signal twice to kill the zombie child, then reap the orphan process.", "The patient schema has a sex column with 4 codes.", "The lock is lost when two workers race.", "La vía antigua se mantiene dos versiones.", "Le module lit 5 entrées au démarrage.", "",
]


def frames(spark, texts):
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    return docs, spark.createDataFrame(SAMPLES + [(None, "none"), ("x", None)], "sample_text string, label string")


def test_scores_and_rates(spark):
    filler = "The cache is read twice. " * 50
    texts = [(t, "Wiki ") for t in ABUSE] + [(t, "wiki") for t in CLEAN] + [(filler + ABUSE[0] + "\n" + filler, None), (None, None), (filler * 200, None)]
    docs, samples = frames(spark, texts)
    docs = docs.unionByName(docs.limit(1)).withColumns({c: F.lit("x") for c in ("document", "score", "kind")})
    scores = A.score_documents(docs, "doc_id", "text", "source", samples, "sample_text", "label")
    found = {r.document for r in scores.collect() if r.score >= A.THRESHOLD}
    assert found == {*range(len(ABUSE)), len(ABUSE) + len(CLEAN)}
    rates = {r.source: (r.documents, r.cases) for r in A.rates(scores).collect()}
    assert rates == {"wiki": (len(ABUSE) + len(CLEAN) + 1, len(ABUSE) + 1), None: (3, 1)}


def test_automaton_against_distance():
    import random

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[j - 1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    row[j] = min(row[j], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abd") for _ in range(rng.randrange(1, 7)))
    words = {word() for _ in range(60)}
    trie = A.Trie(words)
    for _ in range(80):
        w = word()
        if not A._STRETCH.search(w):
            for most in (1, 2):
                assert trie.near(w, most) == sorted((distance(w, x), x) for x in words if distance(w, x) <= most)
    assert A.Trie(["worthless"]).near("w0r7h1e$$", 0) == A.Trie(["worthless"]).near("w.o-rrrrthless", 0) == A.Trie(["worthless"]).near("w*rth***s", 0) == [(0, "worthless")]


@pytest.mark.parametrize(("token", "term"), [("idiot", "idiot"), ("id1ot", "idiot"), ("idiooot", "idiot"), ("i***t", "idiot"), ("vermiin", "vermin"), ("loses", ""), ("clone", ""), ("reader", "")])
def test_canonical(token, term):
    assert A.Matcher().canonical(token) == term


def test_empty(spark):
    docs, samples = frames(spark, [])
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.rates(A.score_documents(docs, "doc_id", "text", "source", samples.limit(0), "sample_text", "label")).count() == 0


@pytest.mark.parametrize(("token", "term"), [("fukc", "fuck"), ("porrn", "porn"), ("nuude", "nude"), ("mdiot", "idiot"), ("oidiot", "idiot"), ("stupd", "stupid"), ("idito", "idiot"), ("nuke", ""), ("nuding", "")])
def test_slips(token, term):
    assert A.Matcher().canonical(token) == term


@pytest.mark.parametrize("text", ["kil yourself", "kill yourslef", "we know wehre you live", "fnd out where you live", "go jump off a brigde", "such a wsate of spcae", "xill yourself"])
def test_slips_in_phrases(text):
    matcher = A.Matcher()
    assert [h for s in A.telling_sentences(matcher, text) for h in matcher.hits(s) if h[3] == 4.0]


def test_ordinary_words_are_no_slips_in_phrases():
    matcher = A.Matcher()
    for text in ("fill yourself in", "go to hall 4", "jump off a branch", "that rate was made"):
        assert not [h for s in A.telling_sentences(matcher, text) for h in matcher.hits(s) if h[3] == 4.0]


def misspelt(word, rng):
    """A word with one letter more, less, other, or two exchanged."""
    k, c = rng.randrange(len(word) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]])


def test_misspelt_terms_are_found():
    """Slips made by rule, of terms that no sample holds; those that make an ordinary word aren't slips."""
    import random

    rng, matcher = random.Random(11), A.Matcher()
    asked = {m: w for w in sorted(matcher.single) for _ in range(5) if len(w) >= 5 and w.isascii() and w.isalpha() and (m := misspelt(w, rng)) not in matcher.ordinary and m not in matcher.known}
    right = sum(matcher.canonical(m) != "" and matcher.single[matcher.canonical(m)][0] == matcher.single[w][0] for m, w in asked.items())
    assert len(asked) > 300 and right >= 0.95 * len(asked)


def test_rows_that_only_the_automaton_finds(monkeypatch):
    """Without it disguised and misspelt terms are lost, those written out remain."""
    texts = ["what kind of idoit are you", "you 1d1ot", "You are a complete moron and everyone knows it.", "fine", "you i m b e c i l e", "you brain-lesss clwon"]
    model = A.fit(SAMPLES)

    def found():
        matcher = A.Matcher(learned=model.typical)
        return {k for k, t in enumerate(texts) if max((A.score_sentence(matcher, model, s)[0] for s in A.telling_sentences(matcher, t)), default=0) >= A.THRESHOLD}

    assert found() == {0, 1, 2, 4, 5}
    monkeypatch.setattr(A.Trie, "near", lambda *_: [])
    assert found() == {2, 4}


def test_words_of_harmful_samples_are_learned():
    samples = [(f"We met at {k}. Send all the florbians home before {k}.", "hateful") for k in range(8)] + [(f"We met at {k}. The cache is read before {k}.", "none") for k in range(30)]
    model = A.fit(samples)
    assert model.typical.get("florbians") == "hateful" and "cache" not in model.typical
    matcher = A.Matcher(learned=model.typical)
    score = lambda t: max((A.score_sentence(matcher, model, s)[0] for s in A.telling_sentences(matcher, t)), default=0)
    assert score("Send all the florbinas home before noon.") >= A.THRESHOLD > score("The cache is read before noon.")
    assert A.fit([]) == A.Model()
