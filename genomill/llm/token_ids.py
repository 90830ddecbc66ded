"""Token-ID / binary output (6): raw id shards with a minimal perfect hash index.

A dataset is a folder with manifest.json and, for each shard, two files that the manifest names:

* NAME.ids: the ids of the shard's documents one after another, unsigned little-endian, 2 or 4 bytes each;
* NAME.idx: MAGIC, four int64 (documents, distinct keys, buckets, rows of null keys), then int64 arrays: keys and end
  offsets (in ids) of the documents in order, and the index: a displacement for each bucket, and for each of the slots
  the key's fingerprint, first row and number of rows.

Shards hold ascending key ranges of about SHARD_BYTES of text; a key with very many documents goes on in the next
shards. The manifest has each shard's first and last key, documents, ids and first id number. A name holds its task's
attempt, so a repeated task never touches another's files, and only files that the manifest names count: nothing is
renamed, which object stores can't do at once. A key is found by bisecting the manifest and then with a constant number
of small reads: its hash names a bucket, the bucket's displacement names the slot, the fingerprint tells strangers
apart, and the row names the place in the payload.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.llm._chunks import word_level
from genomill.llm._common import checkpoint, fresh_dir, partitions, release

MAGIC = b"GMIDX001"
BUCKET_KEYS = 4
SHARD_BYTES = 64 << 20
HEAD = len(MAGIC) + 32
U = np.uint64


def mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) of keys under a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + U(0x9E3779B97F4A7C15) * (np.asarray(seed).astype(np.uint64) + U(1))
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


FINGERPRINT_SEED = 2**40


class PerfectHash:
    """Hash and displace: buckets, largest first, take the least seed that puts their keys into free slots."""

    def __init__(self, seeds: np.ndarray, slots: int):
        self.seeds, self.slots = seeds, slots

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        n = len(keys)
        m = max(1, -(-n // BUCKET_KEYS))
        seeds = np.zeros(m, dtype=np.int64)
        if not n:
            return cls(seeds, 0)
        bucket = (mix(keys, 0) % U(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        taken = np.zeros(n, dtype=bool)
        tries = np.arange(1, 257, dtype=np.int64)
        for b in np.argsort(-size, kind="stable"):
            if not size[b]:
                break
            own, low = keys[order[start[b] : start[b] + size[b]]], 0
            while True:
                at = (mix(own[None, :], (tries + low)[:, None]) % U(n)).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if size[b] > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    seeds[b] = tries[k] + low
                    taken[at[k]] = True
                    break
                low += len(tries)
        return cls(seeds, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        bucket = (mix(keys, 0) % U(len(self.seeds))).astype(np.int64)
        return (mix(keys, self.seeds[bucket]) % U(max(self.slots, 1))).astype(np.int64)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    files, base = _files(uri)
    with files.open_output_stream(f"{base}/{name}") as out:
        for x in chunks:
            out.write(x)


def write_ids(docs: DataFrame, tokenizer: str, uri: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, shards: int | None = None) -> dict:
    """Encode every whole text, append end_id, and write the dataset in ascending key order; return the manifest.

    A null text is empty (the end id alone); null keys come first and are not in the index; documents with one key
    keep together in a fixed order by their texts' hash, over several shards where they are many. Other columns are not
    read, so their names can't clash. A text of any length is one document. No rows give an empty dataset.
    """
    spark = docs.sparkSession
    files, base = _files(uri)
    files.create_dir(base, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), math.ceil(size / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_level(tokenizer), TaskContext.get()
        dtype = np.dtype("<u2") if encoder.size <= 65536 and end_id < 65536 else np.dtype("<u4")
        keys, ends, nulls, total = [], [np.zeros(1, np.int64)], 0, 0

        def payload() -> Iterator[bytes]:
            nonlocal nulls, total
            for batch in batches:
                own = batch.column(0)
                nulls += own.null_count
                keys.append(own.fill_null(0).to_numpy())
                for ids, bounds in encoder.encode(batch.column(1), end_id):
                    ends.append(bounds[1:] + total)
                    total += len(ids)
                    yield ids.astype(dtype).tobytes()

        chunks = payload()
        first = next(chunks, None)
        if first is None:
            return
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"

        def all_chunks() -> Iterator[bytes]:
            yield first
            yield from chunks

        _put(uri, f"{name}.ids", all_chunks())
        stored = np.concatenate(keys).astype("<i8")
        own = stored[nulls:]
        distinct, row, count = np.unique(own, return_index=True, return_counts=True)
        index = PerfectHash.build(distinct)
        table = np.zeros((len(distinct), 3), dtype=np.int64)
        if len(distinct):
            table[index.slot(distinct)] = np.stack([mix(distinct, FINGERPRINT_SEED).view(np.int64), row + nulls, count], axis=1)
        head = np.array([len(stored), len(distinct), len(index.seeds), nulls], dtype="<i8")
        _put(uri, f"{name}.idx", (x.astype("<i8").tobytes() if isinstance(x, np.ndarray) else x for x in (MAGIC, head, stored, np.concatenate(ends), index.seeds, table)))
        low, high = (int(own[0]), int(own[-1])) if len(own) else (None, None)
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "name": [name], "docs": [len(stored)], "ids": [total], "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "width": [dtype.itemsize]}
        )

    # Ranges of the key alone would put all documents of one key, or without one, into one shard; the text's hash and
    # the place that a row was read from (for rows repeated as they are) split them.
    order = [F.col("key").asc_nulls_first(), F.col("h").asc(), F.col("at").asc()]
    dealt = rows.withColumns({"h": F.xxhash64("text"), "at": F.spark_partition_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")
    done = dealt.mapInArrow(run, "shard long, name string, docs long, ids long, low long, high long, width long")
    parts, start = [], 0  # one small row for each shard
    for r in sorted(done.collect(), key=lambda r: r.shard):
        parts.append(r.asDict() | {"start": start})
        start += r.ids
    manifest = {"end_id": end_id, "shards": parts, "ids": start}
    _put(uri, "manifest.json", iter([json.dumps(manifest).encode()]))
    return manifest


class Shard:
    """One shard's index and payload; a single key takes a constant number of small reads."""

    def __init__(self, uri: str, name: str, width: int):
        self.files, base = _files(uri)
        self.payload, self.dtype = f"{base}/{name}.ids", np.dtype(f"<u{width}")
        self.index = self.files.open_input_file(f"{base}/{name}.idx")
        head = self.index.read_at(HEAD, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name}: not an index file")
        docs, self.distinct, buckets, self.nulls = np.frombuffer(head, "<i8", offset=len(MAGIC)).tolist()
        self.docs, self.buckets = docs, buckets
        self.keys_at, self.ends_at, self.seeds_at, self.table_at = (0, docs, 2 * docs + 1, 2 * docs + 1 + buckets)

    def read(self, at: int, n: int) -> np.ndarray:
        """n numbers of the index file's arrays, from the at-th on."""
        return np.frombuffer(self.index.read_at(8 * n, HEAD + 8 * at), dtype="<i8")

    def rows(self, key: int) -> range:
        """The rows of a key in this shard; none for a key that it hasn't."""
        if not self.distinct:
            return range(0)
        k = np.array([key], dtype=np.int64)
        seed = self.read(self.seeds_at + int(mix(k, 0)[0] % U(self.buckets)), 1)
        mark, row, count = self.read(self.table_at + 3 * int(mix(k, seed)[0] % U(self.distinct)), 3).tolist()
        # The stored key settles the rare stranger with an equal fingerprint.
        if mark != int(mix(k, FINGERPRINT_SEED).view(np.int64)[0]) or int(self.read(self.keys_at + row, 1)[0]) != key:
            return range(0)
        return range(row, row + count)

    def ids(self, row: int) -> np.ndarray:
        low, high = self.read(self.ends_at + row, 2).tolist()
        with self.files.open_input_file(self.payload) as f:
            return np.frombuffer(f.read_at((high - low) * self.dtype.itemsize, low * self.dtype.itemsize), dtype=self.dtype)

    def everything(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, end offsets, rows in order as the index finds them: those without a key, then each distinct key's)."""
        keys, ends = self.read(self.keys_at, self.docs), self.read(self.ends_at, self.docs + 1)
        distinct = np.unique(keys[self.nulls :])
        found = PerfectHash(self.read(self.seeds_at, self.buckets), self.distinct)
        mark, row, count = self.read(self.table_at, 3 * self.distinct).reshape(-1, 3)[found.slot(distinct)].T if len(distinct) else np.zeros((3, 0), np.int64)
        if (mark != mix(distinct, FINGERPRINT_SEED).view(np.int64)).any():
            raise ValueError("an index misses a key of its own")
        steps = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return keys, ends, np.concatenate((np.arange(self.nulls), np.repeat(row, count) + steps)).astype(np.int64)


class IdStore:
    """Keyed access to a written dataset."""

    def __init__(self, uri: str):
        self.uri = uri
        files, base = _files(uri)
        with files.open_input_file(f"{base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.parts = [p for p in self.manifest["shards"] if p["low"] is not None]
        self.highs, self.open = [p["high"] for p in self.parts], {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key; an empty list if there is none."""
        out = []
        for p in self.parts[bisect.bisect_left(self.highs, key) :]:
            if p["low"] > key:
                break
            if p["name"] not in self.open:
                self.open = {p["name"]: Shard(self.uri, p["name"], p["width"])}
            shard = self.open[p["name"]]
            out += [shard.ids(r) for r in shard.rows(key)]
        return out


def read_ids(spark: SparkSession, uri: str, manifest: dict, *, key: str = "doc_id") -> DataFrame:
    """One row per document of the dataset, from its files alone: key, start, n_tokens, ids_crc32.

    Each task reads one shard and finds its documents through the shard's index.
    """
    parts = spark.createDataFrame([(p["name"], p["width"], p["start"]) for p in manifest["shards"]], "name string, width long, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Shard(uri, name, width)
                keys, ends, order = own.everything()
                low, high = ends[order], ends[order + 1]
                with own.files.open_input_file(own.payload) as f:
                    crcs = [zlib.crc32(np.frombuffer(f.read_at((b - a) * width, a * width), dtype=own.dtype).astype("<u4")) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[order], mask=order < own.nulls), pa.array(start + low), pa.array(high - low), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    out = parts.repartition(max(1, len(manifest["shards"]))).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def round_trip(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """write_ids to a fresh folder of the shared one, read_ids of all documents, and the folder removed again."""
    spark = docs.sparkSession
    uri = fresh_dir(spark, "ids")
    try:
        manifest = write_ids(docs, tokenizer, uri, key=key, text=text, end_id=end_id)
        return checkpoint(read_ids(spark, uri, manifest, key=key))
    finally:
        release(spark, uri)
