"""Packing (4): minimum bin slack over the multiset of remaining lengths.

Every document fills whole windows with its first floor(n / capacity) * capacity tokens; what remains, fewer than a
window, is an item. Only the counts of items by length (at most capacity - 1 numbers) go to the driver. For the
longest item left, a subset-sum over bits of one integer finds the reachable fill closest to the capacity, and its
backtracked counts of each length make a pattern that is used as often as the counts allow. A pattern gives its items
ranks within their length, so the items find their windows by a join on length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm._chunks import byte_level
from genomill.llm._common import checkpoint, trim

#: A rank table of more rows is joined with an exchange; it has as many rows as patterns have lengths, whatever the corpus.
BROADCAST_ROWS = 100_000


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as close to capacity as can be without passing it.

    Lengths are tried from the longest; bit s of reach[k] tells whether the first k lengths can sum to s.
    """
    goal, reach, steps = 1 << capacity, 1, []
    mask = (goal << 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        steps.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts of each length in a window, number of such windows) until no item is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = closest_fill(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def rank_table(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first window, items a window, offset in it) and the number of windows."""
    rows, seen, window = [], {}, 0
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            first = seen.get(length, 0)
            seen[length] = first + used[length] * times
            rows.append((length, first, seen[length], window, used[length], offset))
            offset += length * used[length]
        window += times
    return rows, window


def _measured(docs: DataFrame, tokenizer: str, key: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """Per document: tokens, pieces' checksums, and its ranks among its task's items and whole windows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_level(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        whole = 0
        long = lambda x: pa.array(x, pa.int64())
        for batch in batches:
            done = 0
            for ids, bounds in encoder.encode(batch.column(1), end_id):
                raw, n = memoryview(ids.astype("<u4")).cast("B"), np.diff(bounds)
                rank, crcs = [], []
                for low, high, rest in zip((bounds[:-1] * 4).tolist(), (bounds[1:] * 4).tolist(), (n % capacity).tolist(), strict=True):
                    crcs.append([zlib.crc32(raw[k : min(k + capacity * 4, high)]) for k in range(low, high, capacity * 4)])
                    rank.append(seen.get(rest, 0))
                    seen[rest] = rank[-1] + 1
                full = n // capacity
                wholes = whole + np.cumsum(full) - full
                whole += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(n)), long([part] * len(n)), long(n), long(n % capacity), long(rank), long(wholes), pa.array(crcs, pa.list_(pa.int64()))],
                    ["key", "part", "n", "rest", "rank", "whole", "crcs"],
                )
                done += len(n)
        trim()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, part long, n long, rest long, rank long, whole long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; a null or empty text is the end id alone. Repeated keys are separate documents
    (start counts within each), a null key stays null, no documents give no rows. Windows of packed items come first
    in sequence_id, then the windows that one document fills alone. Other columns are not read, so their names can't
    clash; a text of any length is one document. Only slim rows are shuffled, never ids, and no
    task gets a length's items together: ranks are a task's own plus the counts of the tasks before it.
    """
    spark = docs.sparkSession
    measured = checkpoint(_measured(docs, tokenizer, key, text, capacity, end_id))
    # Per task and length, how many items (or, under length 0, whole windows) earlier tasks hold.
    items = measured.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("here"))
    wholes = measured.groupBy("part").agg(F.sum(F.expr(f"n div {capacity}")).alias("here")).select("part", F.lit(0).cast("long").alias("rest"), "here")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpoint(items.unionByName(wholes).withColumn("earlier", F.coalesce(F.sum("here").over(before), F.lit(0))))
    by_length = {r.rest: r.n for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("here").alias("n")).collect()}
    rows, windows = rank_table(patterns(by_length, capacity))
    table = spark.createDataFrame(rows, "rest long, low long, high long, window long, per long, base long")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table

    item = (
        measured.where("rest > 0")
        .select("key", "n", "part", "rest", "rank", F.expr("element_at(crcs, -1)").alias("crc"))
        .join(counts, ["part", "rest"])
        .withColumn("rank", F.col("rank") + F.col("earlier"))
        .join(table, "rest")
        .where("rank >= low and rank < high")
        .select(
            F.col("key").alias(key),
            (F.col("n") - F.col("rest")).alias("start"),
            F.col("rest").alias("length"),
            F.col("crc").alias("ids_crc32"),
            F.col("n").alias("doc_tokens"),
            F.expr("window + (rank - low) div per").alias("sequence_id"),
            F.expr("base + (rank - low) % per * rest").alias("offset"),
        )
    )
    full = (
        measured.where(f"n >= {capacity}")
        .join(counts.where("rest = 0").select("part", "earlier"), "part")
        .select("key", "n", (F.col("whole") + F.col("earlier") + windows).alias("first"), F.posexplode(F.expr(f"slice(crcs, 1, cast(n div {capacity} as int))")).alias("k", "crc"))
        .select(
            F.col("key").alias(key),
            (F.col("k") * F.lit(capacity).cast("long")).alias("start"),
            F.lit(capacity).cast("long").alias("length"),
            F.col("crc").alias("ids_crc32"),
            F.col("n").alias("doc_tokens"),
            (F.col("first") + F.col("k")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return item.unionByName(full)
