"""Filling containers of fixed capacity with documents, by bulk-synchronous best-fit.

As many containers as the tokens need at least are open from the start. In each round the unplaced documents and the
gaps of the containers are range-sorted together by size and swept upwards: a gap takes the largest document that lies
before it, which is the best fit. A task sweeps its range with a stack; documents and gaps left over are matched
between ranges by rank, from one pair of counts per range on the driver, so a round gives what one sweep over all rows
would. Then gaps are updated and the next round begins. The rounds of a small rest, of bounded size, are the same sweeps
within one task. Only sizes and ids are shuffled, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, stored
from .vocabulary import TOKENIZERS, load, ranks

#: Tokens in a container.
CAPACITY = 2_048
#: Rows up to which what is left, when it is a tenth of the items at most, is swept to its end in one task.
LAST = 50_000
#: Kinds of rows after a sweep.
MATCHED, ITEM_LEFT, GAP_LEFT = 0, 1, 2


def token_counter(vocabularies: dict[str, bytes] | None = None) -> Callable[[str], int]:
    """Counts the tokens of a whole text in the byte-level vocabulary of 50,257. Pieces between which nothing merges are counted once and remembered."""
    import regex
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks(vocabularies or load()), special_tokens={})
    pieces, memo = regex.compile(pattern), {}

    def count(text: str) -> int:
        total = 0
        for piece in pieces.findall(text):
            n = memo.get(piece)
            if n is None:
                n = len(encoding.encode_ordinary(piece))
                if len(piece) <= 40:
                    if len(memo) > 500_000:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    return count


def token_sizes(documents: DataFrame, document: str, text: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(document, tokens) for every row; null and empty texts have 0 tokens."""

    sent = documents.sparkSession.sparkContext.broadcast(load(tokenizers))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(sent.value)
        for batch in batches:
            sizes = [count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(sizes, pa.int64())], ["document", "tokens"])

    return spread(documents.select(F.col(document).cast("long").alias("document"), F.col(text).alias("text"))).mapInArrow(sized, "document long, tokens long")


_SWEPT = pa.schema({"kind": pa.int32(), "item": pa.int64(), "size": pa.int64(), "bin": pa.int64(), "gap": pa.int64(), "rank": pa.int64()})


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SWEPT)] if out else [pa.array([], t.type) for t in _SWEPT], schema=_SWEPT)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps of a small rest, one after the other, until nothing fits. Gaps left are those at the end."""
    items: list[tuple[int, int]] = []
    gaps: list[tuple[int, int]] = []
    for batch in batches:
        for size, kind, i in zip(batch.column("size").to_pylist(), batch.column("kind").to_pylist(), batch.column("id").to_pylist()):
            (gaps if kind else items).append((size, i))
    out, matched = [], True
    while matched and items:
        matched, stack, left = False, [], []
        for size, kind, i in sorted([(s, 0, i) for s, i in items] + [(s, 1, i) for s, i in gaps]):
            if kind == 0:
                stack.append((size, i))
            elif stack:
                taken, item = stack.pop()
                out.append((MATCHED, item, taken, i, size, 0))
                left.append((size - taken, i))
                matched = True
            else:
                left.append((size, i))
        items, gaps = stack, left
    out += [(ITEM_LEFT, i, size, None, None, k) for k, (size, i) in enumerate(sorted(items, reverse=True))]
    yield _rows(out + [(GAP_LEFT, None, None, i, size, k) for k, (size, i) in enumerate(sorted(gaps))])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of (size, kind, id), sorted upwards. -> matched pairs, items left (rank 0 is the largest), gaps left (in order)."""
    stack: list[tuple[int, int]] = []
    gaps = 0
    for batch in batches:
        out: list[tuple] = []
        for size, kind, i in zip(batch.column("size").to_pylist(), batch.column("kind").to_pylist(), batch.column("id").to_pylist()):
            if kind == 0:
                stack.append((i, size))
            elif stack:
                item, taken = stack.pop()
                out.append((MATCHED, item, taken, i, size, 0))
            else:
                out.append((GAP_LEFT, None, None, i, size, gaps))
                gaps += 1
        yield _rows(out)
    left = [(ITEM_LEFT, i, size, None, None, k) for k, (i, size) in enumerate(reversed(stack))]
    yield _rows(left)


def _between_ranges(items: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Matches of left gaps to left items of lower ranges: (gap range, first gap rank, item range, first item rank, how many)."""
    stack: list[list[int]] = []  # range, next rank, how many
    found = []
    for p in sorted({*items, *gaps}):
        wanted, rank = gaps.get(p, 0), 0
        while wanted and stack:
            q, at, n = stack[-1]
            k = min(wanted, n)
            found.append((p, rank, q, at, k))
            wanted, rank = wanted - k, rank + k
            stack[-1][1:] = at + k, n - k
            if n == k:
                stack.pop()
        if items.get(p):
            stack.append([p, 0, items[p]])
    return found


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, size) with 0 < size <= capacity -> (item, size, bin). Items are distinct; bins are numbered from 0."""
    spark = items.sparkSession
    total, large, count = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") * 2 > capacity), F.count("*")).first()
    opened = max(math.ceil(total / capacity), large)
    rows = items.select("size", F.lit(0).alias("kind"), F.col("item").alias("id"))
    bins = spark.range(opened).select(F.lit(capacity).cast("long").alias("size"), F.lit(1).alias("kind"), "id")
    placed, last = [], False
    while True:
        events = rows.unionByName(bins)
        events = events.coalesce(1) if last else events.repartitionByRange("size", "kind", "id").sortWithinPartitions("size", "kind", "id")
        swept = stored(events.mapInArrow(_finish if last else _sweep, "kind int, item long, size long, bin long, gap long, rank long").withColumn("part", F.spark_partition_id()))
        counts = swept.groupBy("part", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least")).collect()
        left = {r["part"]: r["n"] for r in counts if r["kind"] == ITEM_LEFT}
        segments = _between_ranges(left, {r["part"]: r["n"] for r in counts if r["kind"] == GAP_LEFT})
        matched = sum(r["n"] for r in counts if r["kind"] == MATCHED) + sum(s[4] for s in segments)
        within = swept.filter(F.col("kind") == MATCHED).select("item", "size", "bin", "gap")
        gaps = swept.filter(F.col("kind") == GAP_LEFT).select("part", "bin", "gap", "rank")
        waiting = swept.filter(F.col("kind") == ITEM_LEFT).select("item", "size", F.col("part").alias("item_part"), F.col("rank").alias("item_rank"))
        taken, unfilled = within, gaps.select("bin", "gap")
        if segments:
            known = spark.createDataFrame(segments, "part int, gap_from long, item_part int, item_from long, n long")
            paired = gaps.join(F.broadcast(known), (gaps["part"] == known["part"]) & F.col("rank").between(F.col("gap_from"), F.col("gap_from") + F.col("n") - 1), "left")
            paired = paired.select("bin", "gap", "item_part", (F.col("item_from") + F.col("rank") - F.col("gap_from")).alias("item_rank"))
            joined = stored(waiting.join(paired, ["item_part", "item_rank"], "full"))
            taken = within.unionByName(joined.filter("item is not null and bin is not null").select("item", "size", "bin", "gap"))
            unfilled = joined.filter("item is null").select("bin", "gap")
            waiting = joined.filter("bin is null").select("item", "size", "item_part", "item_rank")
        placed.append(taken.select("item", "size", "bin"))
        if matched == sum(r["n"] for r in counts if r["kind"] != GAP_LEFT):
            break
        free = unfilled if last else taken.select("bin", (F.col("gap") - F.col("size")).alias("gap")).unionByName(unfilled)
        waits = sum(r["n"] for r in counts if r["kind"] != GAP_LEFT) - matched
        rest = waits + matched + sum(r["n"] for r in counts if r["kind"] == GAP_LEFT)
        least = min(r["least"] for r in counts if r["kind"] == ITEM_LEFT)
        ended, last = last or not matched, waits * 10 <= count and rest <= LAST
        if ended:
            # nothing fits any more: new containers take runs of what is left, cut by the running sum of sizes
            before, start = {}, 0
            for r in sorted((r for r in counts if r["kind"] == ITEM_LEFT), key=lambda r: -r["part"]):
                before[r["part"]], start = start, start + r["tokens"]
            offsets = spark.createDataFrame([(k, v) for k, v in before.items()], "item_part int, before long")
            ends = waiting.join(F.broadcast(offsets), "item_part").withColumn("end", F.col("before") + F.expr("sum(size) over (partition by item_part order by item_rank)"))
            spot = stored(ends.select("item", "size", F.floor((F.col("end") - F.col("size")) / capacity).alias("bin"), (F.floor((F.col("end") - 1) / capacity)).alias("last")))
            fits = spot.filter("bin = last").select("item", "size", (F.col("bin") + opened).alias("bin"))
            placed.append(fits)
            used = fits.groupBy("bin").agg(F.sum("size").alias("used"))
            new = math.ceil(start / capacity)
            fresh = spark.range(opened, opened + new).withColumnRenamed("id", "bin").join(used, "bin", "left")
            free = free.unionByName(fresh.select("bin", (F.lit(capacity) - F.coalesce("used", F.lit(0))).alias("gap")))
            opened += new
            waiting = spot.filter("bin != last").select("item", "size")
            if not waiting.head(1):
                break
        rows = waiting.select("size", F.lit(0).alias("kind"), F.col("item").alias("id"))
        bins = free.filter(F.col("gap") >= least).select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("bin").alias("id"))
    return reduce(DataFrame.unionByName, placed)


def fill_containers(documents: DataFrame, document: str, text: str, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(container, document, piece, pieces, tokens): every document with tokens in a container, whole unless it exceeds the capacity.

    A longer document is cut into pieces of the capacity, each alone in a container, and a last piece that is packed
    like a document. Documents without tokens (null, empty) are in no container; repeated ids are packed as often as
    they occur. The tokens of a container never exceed the capacity. An empty table gives no row.
    """
    sized = token_sizes(documents, document, text, tokenizers).filter("tokens > 0")
    sizes = stored(sized.withColumn("item", F.monotonically_increasing_id()))
    last = F.pmod("tokens", F.lit(capacity))
    packed = pack(sizes.select("item", last.alias("size")).filter("size > 0"), capacity)
    pieces = F.ceil(F.col("tokens") / capacity)
    rest = packed.join(sizes, "item").select(F.col("bin").alias("container"), "document", (pieces - 1).alias("piece"), pieces.alias("pieces"), F.col("size").alias("tokens"))
    # containers that hold one full piece are numbered below 0, by a running count: within what one task stored, and from one sum per task
    task, held = F.shiftright("item", 33), F.floor(F.col("tokens") / capacity)
    whole = sizes.filter(F.col("tokens") >= capacity).select("document", "item", task.alias("task"), pieces.alias("pieces"), held.alias("held"))
    starts, total = [], 0
    for r in whole.groupBy("task").agg(F.sum("held").alias("n")).orderBy("task").collect():
        starts.append((r["task"], total))
        total += r["n"]
    known = F.broadcast(sizes.sparkSession.createDataFrame(starts, "task long, start long"))
    first = whole.withColumn("before", F.expr("sum(held) over (partition by task order by item) - held")).join(known, "task")
    exploded = first.select("document", "pieces", (F.col("start") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)).alias("piece"))
    full = exploded.select((-1 - F.col("first") - F.col("piece")).alias("container"), "document", "piece", "pieces", F.lit(capacity).cast("long").alias("tokens"))
    return rest.unionByName(full)


def container_lists(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, documents, pieces, tokens, unused): each container's list; a container holds at most capacity documents."""
    lists = filled.groupBy("container").agg(F.sort_array(F.collect_list(F.struct("document", "piece"))).alias("held"), F.sum("tokens").alias("tokens"))
    return lists.select("container", F.col("held.document").alias("documents"), F.col("held.piece").alias("pieces"), "tokens", (capacity - F.col("tokens")).alias("unused"))
