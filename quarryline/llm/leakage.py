"""Evaluation texts inside training text: size-partitioned MinHash containment search, then exact verification.

Test items are partitioned by size. For each size class every document is cut into windows about as long as the
class's items, overlapping by half, so that a MinHash of a window and of an item can meet although the document is
far longer than the item. The number of hash functions of a class follows from its sizes and the least containment
to be found (the conversion of containment into Jaccard similarity for the class's largest size). Items whose minimum
equals a window's minimum under one function are candidates; exact shared shingles and their order decide. Items of fewer
words than a stretch must have are looked up as a whole, exactly.
Documents aren't shuffled: each task holds the signatures of one block of items, and blocks have a fixed size.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

#: Words of a shingle in the search, and of one in the verification.
SHINGLE, SEED = 5, 3
#: Items in one block, broadcast together; more items mean more passes over the documents.
ITEM_BLOCK = 20_000
#: Ratio of the largest to the smallest item of a size class.
CLASS_RATIO = 1.5
#: Least share of an item's shingles within one window that is to be found, and the chance to miss it; the hash functions
#: of a class follow from them (142 for one of full width).
CONTAINMENT, MISS = 0.08, 0.01
#: Share of an item's words that a document must hold in one or two stretches, words between seeds of one stretch,
#: least share of a stretch's words that must agree, and least words of a stretch.
SHARE, GAP, DENSE, LEAST_STRETCH = 0.5, 10, 0.6, 6
#: Words tokenized together, which bounds a task's memory.
CHUNK_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|\[(?=[^\]\n]*\]\()|\]\([^)\s]*\)|[­​-‏⁠﻿]")
_ODD = np.random.default_rng(20240607).integers(1, 1 << 32, (1024, 2), dtype=np.uint32) | 1


class _Hashes(dict):
    """Words to 64-bit hashes; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str) -> list[str]:
    """The words of a whole text without case, punctuation, layout and markup."""
    if "<" in text or "](" in text or not text.isascii():
        text = _MARKUP.sub(" ", html.unescape(text))
    return _WORD.findall(text.lower())


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for the k words from each position; positions near the end wrap around and mean nothing."""
    h = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.roll(hashes, -j)
        h ^= h >> np.uint64(29)
    return h


def _hashed(shingles: np.ndarray, j: int) -> np.ndarray:
    h = shingles * _ODD[j, 0]
    h ^= h >> np.uint32(15)
    return h * _ODD[j, 1]


@dataclass
class ItemBlock:
    """Signatures of a block of items by size class, and what verification needs."""

    ids: list[int]
    seeds: list[np.ndarray]  # of each item: its seed hashes by position
    n_words: list[int]
    all_seeds: np.ndarray
    classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]  # half a window; by hash function: sorted minima, items
    short: dict[int, dict[int, list[int]]]  # of items too short for a stretch: number of words, hash of all words, items


def index_items(items: list[tuple[int, str]]) -> ItemBlock:
    cache = _Hashes()
    hashes = {i: np.array([cache[w] for w in words(text)], np.uint64) for i, text in items}
    kept = sorted((i for i in hashes if len(hashes[i]) >= LEAST_STRETCH), key=lambda i: len(hashes[i]))
    short: dict[int, dict[int, list[int]]] = {}
    for i, h in hashes.items():
        if 0 < len(h) < LEAST_STRETCH:
            short.setdefault(len(h), {}).setdefault(int(_rolled(h, len(h))[0]), []).append(i)
    sizes = [len(hashes[i]) - SHINGLE + 1 for i in kept]
    classes, at = [], 0
    while at < len(kept):
        end = next((k for k in range(at, len(kept)) if sizes[k] > CLASS_RATIO * sizes[at]), len(kept))
        half = max(1, (sizes[end - 1] + 1) // 2)
        jaccard = CONTAINMENT * sizes[at] / (2 * half + sizes[at])
        functions = math.ceil(math.log(MISS) / math.log(1 - jaccard))
        shingles = [(_rolled(hashes[kept[k]], SHINGLE)[: sizes[k]] >> np.uint64(32)).astype(np.uint32) for k in range(at, end)]
        tables = []
        for j in range(functions):
            minima = np.array([_hashed(s, j).min() for s in shingles], np.uint32)
            order = np.argsort(minima, kind="stable")
            tables.append((minima[order], order + at))
        classes.append((half, tables))
        at = end
    seeds = [_rolled(hashes[i], SEED)[: len(hashes[i]) - SEED + 1] for i in kept]
    return ItemBlock(kept, seeds, [len(hashes[i]) for i in kept], np.unique(np.concatenate([*seeds, np.zeros(0, np.uint64)])), classes, short)


def _candidates(block: ItemBlock, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs of which a window and the item share a minimum."""
    shingles = (_rolled(hashes, SHINGLE) >> np.uint64(32)).astype(np.uint32)
    lengths = ends - starts
    cuts = []
    for half, _ in block.classes:
        per = -(-lengths // half)
        owner = np.repeat(np.arange(len(starts)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        cuts.append((starts[owner] + within * half, owner, owner[:-1] == owner[1:]))
    found = set()
    for j in range(max((len(t) for _, t in block.classes), default=0)):
        h = _hashed(shingles, j)
        for (_, tables), (at, owner, joined) in zip(block.classes, cuts):
            if j >= len(tables):
                continue
            low = np.minimum.reduceat(h, at)
            both = np.minimum(low[:-1], low[1:])
            low[:-1] = np.where(joined, both, low[:-1])  # the window that begins with this half
            minima, item = tables[j]
            place = np.searchsorted(minima, low)
            hit = np.flatnonzero(minima[np.minimum(place, len(minima) - 1)] == low)
            for w in hit:
                p = place[w]
                while p < len(minima) and minima[p] == low[w]:
                    found.add((int(owner[w]), int(item[p])))
                    p += 1
    return found


def _stretches(item: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Maximal runs of shared seeds in order: (first and last word in the item, first in the document, agreeing words).

    seeds: those of the document that occur in any item, at the given places.
    """
    order = np.argsort(item, kind="stable")
    ranked = item[order]
    left, right = np.searchsorted(ranked, seeds), np.searchsorted(ranked, seeds, "right")
    shared = np.flatnonzero(left < right)
    if SEED * len(shared) < LEAST_STRETCH:
        return []
    pairs = [(int(places[k]), int(order[p])) for k in shared for p in range(left[k], right[k])]
    best: list[tuple[int, int, int]] = []  # agreeing words, first in item, first in document
    for k, (d, i) in enumerate(pairs):
        value = (SEED, i, d)
        for q in range(k - 1, -1, -1):
            e, o = pairs[q]
            if d - e > GAP:
                break
            if 0 < i - o <= GAP and d > e and best[q][0] + min(SEED, i - o) > value[0]:
                value = (best[q][0] + min(SEED, i - o), best[q][1], best[q][2])
        best.append(value)
    runs: dict[tuple[int, int], tuple[int, int]] = {}
    for (d, i), (agree, first, begin) in zip(pairs, best):
        if agree > runs.get((first, begin), (0, 0))[0]:
            runs[first, begin] = (agree, i + SEED - 1)
    return [(first, last, begin, agree) for (first, begin), (agree, last) in runs.items() if agree >= LEAST_STRETCH and agree >= DENSE * (last - first + 1)]


def held_share(item: np.ndarray, n_words: int, places: np.ndarray, seeds: np.ndarray) -> float:
    """The largest share of an item's words in one stretch, or in two that follow each other."""
    runs = _stretches(item, places, seeds)
    most = max((last - first + 1 for first, last, _, _ in runs), default=0)
    for first, last, begin, _ in runs:
        for first2, last2, begin2, _ in runs:
            if first2 > first and last2 > last and begin2 > begin:
                most = max(most, last2 - first + 1 - max(0, first2 - last - 1))
    return most / n_words


def _search(block: ItemBlock, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()

    def searched(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        hashes = np.concatenate(parts)
        seeds = _rolled(hashes, SEED)
        places = np.flatnonzero(np.isin(seeds, block.all_seeds))
        found = []
        for d, k in sorted(_candidates(block, hashes, ends - sizes, ends)):
            low, high = np.searchsorted(places, [ends[d] - sizes[d], ends[d] - SEED + 1])
            if (high - low) * SEED < least * DENSE * block.n_words[k]:
                continue  # so few shared seeds can't make up the share
            share = held_share(block.seeds[k], block.n_words[k], places[low:high], seeds[places[low:high]])
            if share >= least:
                found.append((ids[d], block.ids[k], share))
        for n, held in block.short.items():
            whole = _rolled(hashes, n)
            at = np.flatnonzero(np.isin(whole, np.array([*held], np.uint64)))
            d = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[d]
            found += sorted({(ids[k], i, 1.0) for p, k in zip(at[inside].tolist(), d[inside].tolist()) for i in held[int(whole[p])]})
        return pa.RecordBatch.from_pylist([dict(zip(("document", "item", "share"), f)) for f in found], schema=pa.schema({"document": pa.int64(), "item": pa.int64(), "share": pa.float64()}))

    for batch in batches:
        ids, parts, held = [], [], 0
        for i, text in zip(batch.column("document").to_pylist(), batch.column("text").to_pylist()):
            ws = words(text)
            if not ws:
                continue
            ids.append(i), parts.append(np.array([cache[w] for w in ws], np.uint64))
            held += len(ws)
            if held >= CHUNK_WORDS:
                yield searched(ids, parts)
                ids, parts, held = [], [], 0
        if ids:
            yield searched(ids, parts)


def find_leaks(documents: DataFrame, document: str, text: str, items: DataFrame, item: str, item_text: str, share: float = SHARE) -> DataFrame:
    """(document, item, share): documents holding at least that share of an item's words in order, in one or two stretches.

    An item of fewer than six words must occur whole. Null and empty texts and items without words give no row; repeated
    rows give one row; other columns are ignored. Items are collected in blocks of ITEM_BLOCK for one pass over the documents each.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    texts = documents.select(F.col(document).cast("long").alias("document"), F.col(text).alias("text")).filter("document is not null and text is not null")
    texts = spread(texts)
    passes = max(1, math.ceil(items.count() / ITEM_BLOCK))
    found = None
    for k in range(passes):
        block = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        held = spark.sparkContext.broadcast(index_items([tuple(r) for r in block.collect()]))
        part = texts.mapInArrow(lambda batches, held=held: _search(held.value, share, batches), "document long, item long, share double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("document", "item").agg(F.max("share").alias("share"))
