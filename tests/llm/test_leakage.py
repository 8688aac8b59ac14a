import random

from pyspark.sql import functions as F

from quarryline.llm import leakage as L

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sha", "pel") for b in ("ran", "tis", "mo", "dul", "ker", "sat", "bi", "gon")]


def passage(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def planted(rng):
    """Items, documents, and the pairs that must be found."""
    items = {k: passage(rng, rng.randrange(60, 150)) for k in range(30)}
    docs, truth = {}, set()
    noise = lambda: passage(rng, rng.randrange(0, 800))
    for d in range(200):
        words = noise()
        kind = d % 5
        if kind < 4:
            k = rng.randrange(30)
            item = items[k]
            n = len(item)
            if kind == 0:  # whole, other case and punctuation, a few words changed
                own = [w.upper() + "," if rng.random() < 0.3 else w for w in item]
                for _ in range(n // 20):
                    own[rng.randrange(n)] = "changed"
                words += own + noise()
                truth.add((d, k))
            elif kind == 1:  # two stretches
                words += item[: int(0.35 * n)] + noise() + ["gap"] * 20 + item[int(0.5 * n) : int(0.85 * n)] + noise()
                truth.add((d, k))
            elif kind == 2:  # just over a half, in markup
                words += ["<b>"] + item[: int(0.6 * n)] + ["</b>"] + noise()
                truth.add((d, k))
            else:  # a short quotation
                words += item[: int(0.3 * n)] + noise()
        docs[d] = " ".join(words)
    return items, docs, truth


def test_planted(spark):
    items, docs, truth = planted(random.Random(5))
    documents = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"document": F.lit(0), "item": F.lit(0), "share": F.lit(0)})
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(99, "too short"), (98, None)], "item_id long, item_text string")
    found = {(r.document, r["item"]) for r in L.find_leaks(documents, "doc_id", "text", tests, "item_id", "item_text").collect()}
    assert found == truth


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 1)
    rng = random.Random(2)
    a, b = " ".join(passage(rng, 70)), " ".join(passage(rng, 70))
    tests = spark.createDataFrame([(1, a), (2, b), (2, b)], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, a), (2, b), (2, b), (3, a + b), (4, None), (5, ""), (None, a)], "doc_id long, text string")
    assert {(r.document, r["item"]) for r in L.find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").collect()} == {(1, 1), (2, 2), (3, 1), (3, 2)}


def test_empty(spark):
    docs, tests = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert L.find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").count() == 0
    assert L.find_leaks(spark.createDataFrame([(1, "some words in here now")], docs.schema), "doc_id", "text", tests, "item_id", "item_text").count() == 0


def test_held_share_needs_order():
    import numpy as np

    cache = L._Hashes()
    seeds = lambda ws: L._rolled(np.array([cache[w] for w in ws], np.uint64), L.SEED)[: len(ws) - L.SEED + 1]
    item = [f"w{k}" for k in range(60)]
    share = lambda doc: L.held_share(seeds(item), 60, np.arange(len(doc) - 2), seeds(doc))
    assert share(item) == 1.0
    assert share(item[30:] + ["x"] * 30 + item[:30]) == 0.5
    assert share(item[:20] + ["x"] * 30 + item[40:]) == 40 / 60


def test_short_items_are_looked_up_whole(spark):
    docs = spark.createDataFrame([(1, "Answer: the quick, brown FOX."), (2, "the quick"), (3, "brown fox"), (4, "quick brown the fox"), (5, "fox"), (6, "the quick brown foxes")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "the quick brown fox"), (2, "Fox"), (3, "quick brown"), (4, "!"), (5, "fox the")], "item_id long, item_text string")
    found = {(r.document, r["item"]) for r in L.find_leaks(docs.coalesce(1), "doc_id", "text", tests, "item_id", "item_text").collect()}
    assert found == {(1, 1), (1, 2), (3, 2), (4, 2), (5, 2), (1, 3), (4, 3), (6, 3)}


def test_hash_functions_meet_the_chance_to_miss():
    block = L.index_items([(k, " ".join(passage(random.Random(k), n))) for k, n in enumerate(range(60, 160))])
    sizes = sorted(n - L.SHINGLE + 1 for n in block.n_words)
    for half, tables in block.classes:
        least, sizes = sizes[0], [s for s in sizes if s > L.CLASS_RATIO * sizes[0]]
        assert (1 - L.CONTAINMENT * least / (2 * half + least)) ** len(tables) <= L.MISS
    assert not sizes and max(len(t) for _, t in block.classes) > 128
