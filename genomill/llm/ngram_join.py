"""N-gram Jaccard join (7): MinHash banding, then exact comparison of whole n-gram sets.

1. Every text becomes the set of its word shingles; texts with equal sets are one node from here on.
2. Bands of MinHash values are shuffled; nodes that share a band's hash are candidates. Links to the least node of each
   band bucket connect all candidates of a bucket, and the rounds that find their components place the nodes in blocks of
   about BLOCK: a component of at most BLOCK nodes is one block, a larger one has blocks of near nodes.
3. A block is compared within itself, and with each block that it shares a band bucket with: once, however many buckets
   and candidates the two share. A task holds two blocks, whatever the size of the group, compares their whole sets by
   one product of incidence matrices, and returns only each node's number of links and a spanning forest.
4. Components of the forests are the classes.

So the work follows the candidates of the bands, never the square of a component; the bands catch a pair at the
threshold with the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.llm._common import Scratch, join_apart, map_arrow, own, partitions, trim
from genomill.llm._graph import components
from genomill.llm._shingles import U, mixed, shingles, word_hashes

BLOCK = 128
SEED = 20_24
COLUMN_CHUNK = 32_768


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands, enough for the recall at the threshold, need at most `most` hashes."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall")


class MinHash:
    """Band hashes of shingle sets under fixed multipliers."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * U(2) + U(1)
        self.weight = rng.integers(1, 2**63, rows, dtype=np.uint64) * U(2) + U(1)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def of(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        for low in range(0, len(s), 4096):
            np.minimum(least, (self.mul[:, None] * s[None, low : low + 4096]).min(axis=1), out=least)
        return mixed((least.reshape(self.bands, self.rows) * self.weight).sum(axis=1, dtype=np.uint64) + self.salt)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _row(key: str, text: str) -> Column:
    """Stands for a row's key and text, a null key too."""
    return F.xxhash64(F.col(key), F.col(text))


def _signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """key and row, node and check (two hashes of the shingle set) and the bands; a set without shingles has null bands."""
    kind = docs.schema[key].dataType.simpleString()
    mark = F.struct(F.col(key).alias("key"), _row(key, text).alias("row")).alias("key")

    def make():
        minhash = MinHash(bands, rows)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, check, found = [], [], []
            for raw in batch.column(1).to_pylist():
                s = np.unique(shingles(word_hashes(raw or b""), n))
                data = s.tobytes()
                node.append(xxhash.xxh3_64_intdigest(data))
                check.append(xxhash.xxh64_intdigest(data))
                found.append(minhash.of(s).view(np.int64).tolist() if len(s) else [])
            return pa.RecordBatch.from_arrays([batch.column(0), _signed(np.array(node, dtype=np.uint64)), _signed(np.array(check, dtype=np.uint64)), pa.array(found, pa.list_(pa.int64()))], ["key", "node", "check", "bands"])

        return run

    out = map_arrow(docs.select(mark, F.col(text).cast("binary").alias("text")), make, f"key struct<key:{kind},row:bigint>, node long, check long, bands array<long>")
    return out.select("key.*", "node", "check", "bands")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """rows (…, text) with text turned into set: the sorted shingle hashes' bytes."""
    names = [c for c in rows.columns if c != "text"]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [np.unique(shingles(word_hashes(x or b""), n)).tobytes() for x in batch.column(len(names)).to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(data, pa.binary())], [*names, "set"])

        return run

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(rows.select(*names, F.col("text").cast("binary").alias("text")), make, f"{schema}, set binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, through a product of incidence matrices in chunks of columns."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, total = owner[shared], np.zeros((m, m), dtype=np.float64)
    width = int(column.max()) + 1 if len(column) else 0
    for low in range(0, width, COLUMN_CHUNK):
        inside = (column >= low) & (column < low + COLUMN_CHUNK)
        matrix = np.zeros((m, min(COLUMN_CHUNK, width - low)), dtype=np.float32)
        matrix[owner[inside], column[inside] - low] = 1
        total += matrix @ matrix.T
    return total


def _compare(node: list[int], block: list[int], copies: list[int], sets: list[np.ndarray], cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each node's links (counted in rows) within the block pair, and the least node that links connect it to."""
    both = overlaps(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(close, False)
    if cross:  # pairs within one block belong to that block's own comparison
        own = np.array(block)
        close &= own[:, None] != own[None, :]
    links = close @ np.array(copies, dtype=np.int64)
    name = np.array(node, dtype=np.int64)
    while True:
        least = np.minimum(name, np.where(close, name[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == name).all():
            return links, name
        name = least


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """members (i, j, node, block, copies, set), sorted by the first three, to node, links, name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, (block, copies, sets) = list(held), zip(*held.values(), strict=True)
                links, name = _compare(node, list(block), list(copies), [np.frombuffer(s, dtype=np.uint64) for s in sets], now[0] != now[1], threshold)
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(node)[some]), pa.array(links[some]), pa.array(name[some])], ["node", "links", "name"])

        # A batch has up to 10,000 sets; only a part of it is copied at once.
        for batch in (b.slice(low, BLOCK) for b in batches for low in range(0, b.num_rows, BLOCK)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now:
                    yield from flush()
                    held, now = {}, row[:2]
                # Only the set that the node stands for is right, once: rows may be repeated, and hashes of rows may meet.
                if np.int64(np.uint64(xxhash.xxh3_64_intdigest(row[5])).view(np.int64)) == row[2]:
                    held[row[2]] = row[3:]
        if now is not None:
            yield from flush()
        held.clear()
        trim()

    return members.mapInArrow(run, "node long, links long, name long")


def _blocks(entries: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node, block) of all nodes with candidates, and (block, others): the later blocks that share a band bucket with a block.

    entries: node, band.
    """
    buckets = entries.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    shared = written(join_apart(entries, buckets, "band"), "candidates")
    levels = components(shared.where("node <> a").select("a", F.col("node").alias("b"))).select("node", F.posexplode("levels").alias("turn", "name"))
    levels = levels.select("node", "turn", F.xxhash64("turn", "name").alias("key"))
    sizes = levels.groupBy("key").agg(F.count("*").alias("n"))
    # A node's neighbourhood is its first one of BLOCK nodes, else its component.
    small = F.col("n") < BLOCK
    chosen = join_apart(levels, sizes, "key").groupBy("node").agg(F.min(F.struct(small.alias("small"), F.when(small, -F.col("turn")).otherwise(F.col("turn")).alias("by"), "key"))["key"].alias("key"))
    chosen = written(chosen, "neighbourhoods")
    here = chosen.groupBy("key").agg(F.count("*").alias("here"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("here") / BLOCK).cast("long"))
    placed = written(join_apart(chosen, here, "key").select("node", F.xxhash64("key", part).alias("block")), "blocks")
    # A bucket's blocks are at most its nodes; buckets of the same blocks ask for the same pairs, once.
    held = join_apart(shared.select("band", "node"), placed, "node").groupBy("band").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    held = held.where(F.size("blocks") > 1).select("blocks").distinct().select("blocks", F.posexplode("blocks").alias("i", "block"))
    pairs = held.select("block", F.explode(F.slice("blocks", F.col("i") + 2, F.size("blocks"))).alias("other")).distinct()
    return placed, pairs


def _classes(docs: DataFrame, scratch: Scratch, key: str, text: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, node of every row; node, class, n_links; class, best, class_size), best: (whether without a key, key, row) of the class's least."""
    bands, rows = choose_bands(threshold, recall)
    written = scratch.table
    signed = written(_signatures(docs, key, text, n, bands, rows), "signed")
    band = [f"b{i}" for i in range(bands)]
    best = F.struct(F.col("key").isNull().alias("no_key"), "key", "row").alias("best")
    nodes = signed.select("node", "check", best, *(F.get("bands", F.lit(i)).alias(c) for i, c in enumerate(band)))
    # Copies are summed up before the shuffle; any of their rows has the node's set.
    nodes = written(nodes.groupBy("node", "check").agg(F.min("best").alias("best"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in band)), "nodes")

    placed, pairs = _blocks(nodes.where("b0 is not null").select("node", F.explode(F.array(*band)).alias("band")), written)
    pairs = written(pairs, "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("block"), F.col("block").alias("other")))
    others = both.groupBy("block").agg(F.collect_list("other").alias("others"))
    members = join_apart(join_apart(placed, others, "block", "left"), nodes.select("node", F.col("best.row").alias("row"), "copies"), "node")
    members = written(members.select("row", "node", "block", "copies", F.concat(F.array("block"), F.coalesce("others", F.array().cast("array<long>"))).alias("others")), "members")
    texts = docs.select(_row(key, text).alias("row"), F.col(text).alias("text"))
    # The same plan at every size: whether the members are few enough to be sent round would differ.
    sets = _sets(members.join(texts.hint("merge"), "row").select("node", "block", "copies", "others", "text"), n)
    spread = sets.withColumn("other", F.explode("others")).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "set")
    spread = spread.repartition(4 * partitions(docs.sparkSession), "i", "j").sortWithinPartitions("i", "j", "node")
    # Each task finds a few links; gathered by node they fill a few files, not one for each task.
    found = written(_verified(spread, threshold).repartition("node"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("name").alias("a"), F.col("node").alias("b"))).select("node", "component")
    named = nodes.select("node", "best", "copies").join(links, "node", "left").join(named, "node", "left")
    named = written(named.select("node", "best", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "node").alias("class")), "named")
    least = named.groupBy("class").agg(F.min("best").alias("best"), F.sum("copies").alias("class_size"))
    return signed.select("key", "node"), named.select("node", "class", (F.col("links") + F.col("copies") - 1).alias("n_links")), least


def similarity_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: key, class_id (the least key of its class), class_size, n_links.

    n_links counts the other documents whose sets of n-word shingles have a Jaccard similarity of at least threshold
    with this one's. A text of fewer than n words has one shingle, all its words; null, empty and white-space texts
    have none and are alike only to each other. Repeated rows are documents of their own; a class of null keys only
    has a null class_id. Only key and text are read, so other columns' names can't clash. Of a very long text a task
    holds the set, 8 bytes a shingle. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    signed, named, least = _classes(docs, scratch, key, text, n, threshold, recall)
    named = join_apart(named, least, "class").select("node", F.col("best.key").alias("class_id"), "class_size", "n_links")
    out = join_apart(signed, named, "node").select(F.col("key").alias(key), "class_id", "class_size", "n_links")
    return scratch.done(out, "classes")


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of docs without all but one of each class of similarity_classes: a row of the class's least key.

    Rows without a key come last; of rows with that key and its text any one is kept. All columns stay as they are,
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    # Only the chosen rows' hashes are written; the rows themselves go straight to whoever asks for them.
    least = scratch.done(_classes(docs, scratch, key, text, n, threshold, recall)[2].select(F.col("best.row").alias("at")), "representatives")
    # Repeated rows are cut down before the shuffle.
    rows = docs.select(_row(key, text).alias("at"), F.struct(*map(own, docs.columns)).alias("row")).groupBy("at").agg(F.first("row").alias("row"))
    return rows.join(least, "at", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
