import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarryline.llm import cooccurrence as X

from ..fixtures import COMMITS, commit, day


@pytest.mark.parametrize(("block", "few"), [(4, 100_000), (4, 0), (256, 100_000)])
def test_pairs_against_counting(spark, monkeypatch, block, few):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "FEW_RENAMES", few)
    rng = random.Random(1)
    baskets = [("s", f"b{k}", item) for k in range(60) for item in rng.sample(range(30), rng.choice([0, 1, 2, 5, 17]))]
    df = spark.createDataFrame([(s, b, f"i{i:02}") for s, b, i in baskets] + [("s", "empty", None), ("s", "b0", None), (None, "b", "x"), ("s", None, "x")], "sc string, ba string, it string")
    found = {(r.item_a, r.item_b): r for r in X.items_together(df.unionByName(df), "sc", "ba", "it").collect()}
    sets: dict[str, set] = {}
    for _, b, i in baskets:
        sets.setdefault(b, set()).add(f"i{i:02}")
    joint, single = Counter(p for s in sets.values() for p in combinations(sorted(s), 2)), Counter(i for s in sets.values() for i in s)
    assert {p: r.joint for p, r in found.items()} == dict(joint)
    n = len({*sets, "empty", "b0"})
    for (a, b), r in found.items():
        assert (r.n, r.n_a, r.n_b) == (n, single[a], single[b])
        k = joint[a, b]
        assert r.odds_ratio == pytest.approx((k + 0.5) * (n - single[a] - single[b] + k + 0.5) / ((single[a] - k + 0.5) * (single[b] - k + 0.5)))


def test_thresholds_lose_nothing(spark):
    df = spark.createDataFrame([("s", f"b{k}", i) for k in range(6) for i in (["a", "b"] if k < 5 else ["a", "c"])], "sc string, ba string, it string")
    assert [(r.item_a, r.item_b, r.joint) for r in X.items_together(df, "sc", "ba", "it", min_joint=5).collect()] == [("a", "b", 5)]


def test_renames_cycles_and_extra_columns(spark):
    rows = [commit(k, f"{k:040x}", day(1 + k), "x", ["old", "p"]) for k in range(3)] + [commit(3, f"{3:040x}", day(5), "x", [("mid", 1, 1, "old"), "p", "p"]), commit(4, f"{4:040x}", day(6), "x", [("new", 1, 1, "mid"), "p"]), commit(5, "odd", day(7), "x", [("u", 1, 1, "v"), ("v", 1, 1, "u")])]
    df = spark.createDataFrame(rows + rows[:2], COMMITS).withColumns({c: F.lit("x") for c in ("path", "newest", "item", "scope", "basket")})
    found = {(r.item_a, r.item_b): r.joint for r in X.file_pairs(df, min_joint=5).collect()}
    assert found == {("new", "p"): 5}
    assert {(r.path, r.newest) for r in X.newest_paths(df).collect()} == {("old", "new"), ("mid", "new"), ("u", "u"), ("v", "u")}


def test_empty(spark):
    assert X.file_pairs(spark.createDataFrame([], COMMITS)).count() == 0
    assert X.file_pairs(spark.createDataFrame([(None,) * 11], COMMITS)).count() == 0


def test_a_large_basket_is_no_one_row(spark, monkeypatch):
    """A commit of 3,000 files: its blocks hold few items each, and each pair comes out once."""
    monkeypatch.setattr(X, "BLOCK", 100)
    df = spark.range(3_000).select(F.lit("s").alias("scope"), F.lit("b").alias("basket"), F.col("id").cast("string").alias("item"))
    rows = X.blocks_of(df.select("scope", "basket", F.lit(3_000).cast("long").alias("size"), F.col("item").cast("long").alias("id")))
    assert rows.count() == 30 * 31 // 2 and rows.agg(F.max(F.size("left"))).first()[0] < 200
    pairs = X.items_together(df, "scope", "basket", "item")
    assert tuple(pairs.agg(F.count("*"), F.min("joint"), F.max("joint"), F.min("n_a")).first()) == (3_000 * 2_999 // 2, 1, 1, 1)


def test_items_beyond_a_slice_of_ids(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 5)
    df = spark.createDataFrame([(f"s{s}", f"b{b}", f"i{i}") for s in range(7) for b in range(3) for i in range(s % 5 + 1) if i != b], "scope string, basket string, item string")
    sets: dict = {}
    for r in df.collect():
        sets.setdefault((r.scope, r.basket), set()).add(r.item)
    expected = Counter((s, *p) for (s, _), items in sets.items() for p in combinations(sorted(items), 2))
    assert {(r.scope, r.item_a, r.item_b): r.joint for r in X.items_together(df, "scope", "basket", "item").collect()} == dict(expected)
    with pytest.raises(ValueError, match="items"):
        monkeypatch.setattr(X, "SLICE", 3)
        X.items_together(df, "scope", "basket", "item")


def test_codes_hold_ids_of_32_bits(spark):
    high = (1 << 32) - 1
    rows = spark.createDataFrame([([5, 1 << 31, high], None), ([high - 1], [3, high])], "left array<long>, right array<long>")
    assert {tuple(r) for r in X._counted(rows).collect()} == {(5, 1 << 31, 1), (5, high, 1), (1 << 31, high, 1), (3, high - 1, 1), (high - 1, high, 1)}
