import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import packing as K


def sweep(sizes, capacity):
    """The same rounds over plain lists."""
    total = sum(sizes)
    gaps = [capacity] * max(-(-total // capacity), sum(2 * s > capacity for s in sizes))
    items, rounds = sorted(sizes), 0
    while items:
        events = sorted([(s, 0, i) for i, s in enumerate(items)] + [(g, 1, i) for i, g in enumerate(gaps)])
        stack, taken = [], set()
        for _, kind, i in events:
            if kind == 0:
                stack.append(i)
            elif stack:
                j = stack.pop()
                taken.add(j)
                gaps[i] -= items[j]
        if not taken:
            return len(gaps), sum(items)
        items = [s for i, s in enumerate(items) if i not in taken]
    return len(gaps), 0


@pytest.mark.parametrize(("spread", "last"), [(False, 50_000), (True, 50_000), (True, 0)])
def test_pack_is_one_sweep_over_all(spark, monkeypatch, spread, last):
    monkeypatch.setattr(K, "LAST", last)
    rng = random.Random(7)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40, 60, 61, 100]) for _ in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", str(not spread).lower())  # without it rows stay in several ranges
    try:
        packed = K.pack(spark.createDataFrame(list(enumerate(sizes)), "item long, size long"), 100).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.item for r in packed) == list(range(400)) and all(r["size"] == sizes[r["item"]] for r in packed)
    bins: dict[int, int] = {}
    for r in packed:
        bins[r.bin] = bins.get(r.bin, 0) + r["size"]
    assert max(bins.values()) <= 100
    expected, left = sweep(sizes, 100)
    assert len(bins) == expected if not left else len(bins) <= expected + -(-left // 100) + 1


def test_between_ranges():
    assert K._between_ranges({0: 2, 1: 1}, {2: 2, 3: 2}) == [(2, 0, 1, 0, 1), (2, 1, 0, 0, 1), (3, 0, 0, 1, 1)]
    assert K._between_ranges({1: 3}, {0: 5}) == []


def test_documents(spark):
    texts = [(1, "word " * 25), (2, ""), (3, None), (4, "one two three"), (5, "word " * 9), (5, "word " * 9), (6, "long " * 1000), (7, "exactly"), (None, "no id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "size", "tokens", "bin", "document")})
    count = K.token_counter()
    rows = K.fill_containers(df, "doc_id", "text", 20).collect()
    per: dict[int, int] = {}
    for r in rows:
        per[r.container] = per.get(r.container, 0) + r.tokens
    assert max(per.values()) <= 20
    assert {r.document for r in rows} == {1, 4, 5, 6, 7, None} and sum(r.document == 5 for r in rows) == 2
    for i, t in texts:
        if t and i not in (5, None):
            assert sum(r.tokens for r in rows if r.document == i) == count(t)
    assert all(r.pieces == 1 for r in rows if r.document in (4, 5, 7)) and sum(r.document == 6 for r in rows) == -(-count("long " * 1000) // 20)
    lists = K.container_lists(K.fill_containers(df, "doc_id", "text", 20), 20).collect()
    assert len(lists) == len(per) and all(r.unused == 20 - r.tokens for r in lists)


def test_token_counts_are_those_of_the_tokenizer():
    import base64

    import tiktoken

    with open(f"{K.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = K.token_counter()
    for t in ("It's   a test\n\n  of_many-things 12345 äöü 👍🏽 don't", " ", "x" * 300, "<|endoftext|>"):
        assert count(t) == len(own.encode_ordinary(t))


def test_empty(spark):
    assert K.fill_containers(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert K.fill_containers(spark.createDataFrame([(1, None)], "doc_id long, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_full_pieces_of_late_splits_have_containers_of_their_own(spark, monkeypatch, ansi):
    late = spark.range(0, 1100, 1, 1100).filter("id = 1 or id >= 1023").select(F.col("id").alias("document"), F.lit(45).cast("long").alias("tokens"))
    monkeypatch.setattr(K, "token_sizes", lambda *_: late)
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = K.fill_containers(late, "document", "document", 20).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    per: dict[int, int] = {}
    for r in rows:
        per[r.container] = per.get(r.container, 0) + r.tokens
    assert len(rows) == 78 * 3 and max(per.values()) <= 20 and sum(per.values()) == 78 * 45
    assert sorted(c for c in per if c < 0) == list(range(-78 * 2, 0))


def test_documents_of_more_than_a_million_pieces(spark, monkeypatch):
    n = (1 << 20) + 3
    long = spark.range(0, 2, 1, 1).select(F.col("id").alias("document"), F.lit(n).cast("long").alias("tokens"))
    monkeypatch.setattr(K, "token_sizes", lambda *_: long)
    full = K.fill_containers(long, "document", "document", 1).agg(F.count("*").alias("n"), F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).first()
    assert tuple(full) == (2 * n, 2 * n, 2 * n)


def test_a_small_rest_is_packed_as_in_rounds(spark, monkeypatch):
    """The same containers come out whether the last rounds run in one task or in Spark."""
    rng = random.Random(3)
    items = spark.createDataFrame([(k, rng.choice([3, 5, 7, 11, 13, 29, 31, 60])) for k in range(500)], "item long, size long")
    results = []
    for last in (50_000, 0):
        monkeypatch.setattr(K, "LAST", last)
        results.append({r.item: r.bin for r in K.pack(items, 100).collect()})
    assert results[0] == results[1] and len(results[0]) == 500
