"""Document fingerprints (9): 128-bit SimHash in DataFrame functions only, with permuted block tables for search.

The terms of a text are its adjacent pairs of words (its only word, if it has one); each occurrence votes, so a term's
weight is its frequency. Two 64-bit hashes of a term give 128 signed votes. Counters of two bits share one long, 32
bits each, so a document's votes are 64 sums over its exploded terms, which code generation handles. Of a stated set of
query documents, the permuted block tables count all documents within RADIUS differing bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm._common import Scratch, join_apart, partitions, range_of, words_of

BITS = 128
LANES = 0x0000000100000001
SECOND_SEED = "genomill"
BUCKETS_PER_PARTITION = 4
#: Differing bits within which documents are near, and fingerprints of a bucket that are compared in one row.
RADIUS, BUCKET_ROWS = 3, 256
#: Query documents are those whose key this divides.
QUERY_STEP = 20


def _votes(hash_: str, second: str) -> list[Column]:
    lane = lambda c, k: F.shiftrightunsigned(F.col(c), k).bitwiseAND(F.lit(LANES))
    return [F.sum(lane(c, k)).alias(f"{c}{k}") for c in (hash_, second) for k in range(32)]


def _bits(name: str, n: str) -> Column:
    """The long whose bit is set where more than half of the n votes say so."""
    out = F.lit(0).cast("long")
    for k in range(32):
        s = F.coalesce(F.col(f"{name}{k}"), F.lit(0).cast("long"))
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        for count, bit in ((low, k), (high, k + 32)):
            one = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(2 * count > F.col(n), one).otherwise(F.lit(0).cast("long")))
    return out


def fold(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """keys, hi and lo for each row; rows with equal keys are one. The group must fit df's partitioning to spare a shuffle."""
    df = df.select(*keys, F.transform(words_of(F.col(body)), lambda w: F.xxhash64(w)).alias("__w"))
    pairs = F.zip_with(F.expr("slice(__w, 1, greatest(size(__w) - 1, 0))"), F.expr("slice(__w, 2, greatest(size(__w) - 1, 0))"), lambda a, b: F.xxhash64(a, b))
    df = df.select(*keys, F.explode_outer(F.when(F.size("__w") == 1, F.col("__w")).otherwise(pairs)).alias("a"))
    df = df.withColumn("b", F.when(F.col("a").isNotNull(), F.xxhash64("a", F.lit(SECOND_SEED))))
    sums = df.groupBy(*keys).agg(F.count("a").alias("__votes"), *_votes("a", "b"))
    return sums.select(*keys, _bits("a", "__votes").alias("hi"), _bits("b", "__votes").alias("lo"))


def hexed(hi: str, lo: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (hi, lo)))


def likeness(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    """The cosine that the share of differing bits stands for, 0 where it is negative."""
    differ = F.bit_count(F.col(hi).bitwiseXOR(F.col(hi2))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(lo2)))
    return F.when(differ == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(differ * (3.141592653589793 / BITS))))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (32 hex digits), hi, lo of every row, repeated ones too; no words give all zeros."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__body"), F.monotonically_increasing_id().alias("__row"))
    out = fold(rows, "__body", ["__row", "__key"])
    return out.select(F.col("__key").alias(key), hexed("hi", "lo").alias("fingerprint"), "hi", "lo")


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending key, after the last the first. A null text is empty, a null key is the least; rows with one
    key stand in the order of their texts' hashes. A table of one document is its own next, an empty one gives no rows.
    n_near counts the documents, itself among them, whose fingerprints differ in at most RADIUS bits; it is null for all
    but the query documents, whose key QUERY_STEP divides. Texts are read whole; other columns are not read, so their
    names can't clash.

    Documents go to key ranges of like counts with one shuffle; a range also gets a copy of the next range's first
    document. All later windows and sums are within the range, so nothing else is shuffled.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("__at"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    k = BUCKETS_PER_PARTITION * partitions(spark)
    found = rows.agg(F.min("__at"), F.percentile_approx("__at", [i / k for i in range(1, k)], 20 * k)).first()
    if found[0] is None:
        found = (0, [])
    bounds = sorted({found[0], *found[1]})
    rows = rows.withColumn("__b", range_of(bounds, F.col("__at")))
    array = F.array(*(F.lit(x).cast("long") for x in bounds))
    before = F.when(F.col("__b") == 1, F.lit(len(bounds))).otherwise(F.col("__b") - 1)
    homes = F.when(F.element_at(array, F.col("__b")) == F.col("__at"), F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")), F.struct(before.alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost"))))
    rows = rows.select("__key", "__at", "__text", F.explode(homes).alias("h")).select("__key", "__at", "__text", F.col("h.b").alias("__b"), F.col("h.ghost").alias("__ghost"))
    order = Window.partitionBy("__b").orderBy("__ghost", "__at", F.xxhash64("__text"), "__text")
    rows = rows.withColumns({"__rn": F.row_number().over(order), "__next": F.lead("__text").over(order)})
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), n - half), F.substring("__next", F.lit(1), half))
    rows = rows.select("__b", "__rn", "__ghost", "__key", "__text", F.coalesce(edited, F.lit("")).alias("__edited"))
    keys = ["__b", "__rn", "__ghost", "__key", "__n", "__sha"]
    both = F.array(F.struct(F.lit(0).alias("tag"), F.col("__text").alias("body")), F.struct(F.lit(1).alias("tag"), F.col("__edited").alias("body")))
    rows = rows.select("__b", "__rn", "__ghost", "__key", F.length("__text").cast("long").alias("__n"), F.sha2("__edited", 256).alias("__sha"), F.explode(both).alias("x"))
    rows = rows.select(*keys, F.col("x.tag").alias("__tag"), F.col("x.body").alias("__body"))
    folded = fold(rows, "__body", [*keys, "__tag"])
    pick = lambda c, tag, name: F.max(F.when(F.col("__tag") == tag, F.col(c))).alias(name)
    wide = folded.groupBy(*keys).agg(pick("hi", 0, "hi"), pick("lo", 0, "lo"), pick("hi", 1, "ehi"), pick("lo", 1, "elo"))
    after = Window.partitionBy("__b").orderBy("__rn")
    wide = wide.withColumns({"nhi": F.lead("hi").over(after), "nlo": F.lead("lo").over(after)})
    scratch = Scratch(spark)
    out = scratch.table(wide.where(~F.col("__ghost")).select(
        F.col("__key").alias("key"),
        F.col("__n").alias("n_chars"),
        F.col("__sha").alias("edited_sha256"),
        hexed("hi", "lo").alias("fingerprint"),
        hexed("ehi", "elo").alias("edited_fingerprint"),
        likeness("hi", "lo", "ehi", "elo").alias("near_edited"),
        likeness("hi", "lo", "nhi", "nlo").alias("near_next"),
        "hi",
        "lo",
    ), "prints")
    asked = F.coalesce(F.col("key").cast("long") % QUERY_STEP == 0, F.lit(False))
    counts = near_counts(out.where(asked), out, RADIUS)
    out = out.where(asked).join(counts, ["hi", "lo"], "left").unionByName(out.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return scratch.done(out.drop("hi", "lo").withColumnRenamed("key", key), "fingerprints")


def blocks(radius: int, agree: int) -> list[tuple[int, int]]:
    """The bits of hi and of lo that each of radius + agree blocks has, as signed masks."""
    m = radius + agree
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        masks = []
        for base in (0, 64):
            a, b = max(low - base, 0), min(high - base, 64)
            mask = ((1 << b) - 1) ^ ((1 << a) - 1) if a < b else 0
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
        out.append((masks[0], masks[1]))
    return out


def block_keys(hi: str, lo: str, radius: int, agree: int = 2) -> Column:
    """Array of one struct (chosen blocks, key) for each table of the permuted block scheme.

    The bits fall into radius + agree blocks; two fingerprints within the radius agree on at least `agree` whole
    blocks, so each choice of that many blocks is a table and its blocks' bits are the key.
    """
    cut = [[F.col(name).bitwiseAND(F.lit(mask).cast("long")) for name, mask in zip((hi, lo), masks, strict=True) if mask] for masks in blocks(radius, agree)]
    return F.array(
        *(F.struct(F.array(*map(F.lit, chosen)).alias("chosen"), F.xxhash64(F.lit(t), *(p for i in chosen for p in cut[i])).alias("key")) for t, chosen in enumerate(combinations(range(radius + agree), agree)))
    )


def near_counts(queries: DataFrame, prints: DataFrame, radius: int, *, agree: int = 2) -> DataFrame:
    """hi, lo, n_near: for each fingerprint of queries (hi, lo) how many rows of prints (hi, lo) differ in at most radius bits.

    Equal fingerprints are one entry of the tables with its number of rows. A table's bucket is split in rows of about
    BUCKET_ROWS entries, with which each query of the bucket is compared in one row, so pairs are never emitted. A pair
    that meets in several tables counts in the first: that of the first blocks on which it agrees.
    """
    cut = lambda df, p, *more: df.select(*more, F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo"), F.explode(block_keys("hi", "lo", radius, agree)).alias("t"))
    q = cut(queries.select("hi", "lo").distinct(), "q").select("qhi", "qlo", "t.chosen", "t.key")
    entries = cut(prints.groupBy("hi", "lo").agg(F.count("*").alias("n")), "", "n").select("hi", "lo", "n", "t.key")
    entries = join_apart(entries, q.groupBy("key").agg(F.count("*").alias("asked")), "key").select("key", "hi", "lo", "n")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"))
    placed = join_apart(entries, sizes, "key").withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.ceil(F.col("size") / BUCKET_ROWS).cast("long")))
    buckets = placed.groupBy("key", "part").agg(F.collect_list(F.struct("hi", "lo", "n")).alias("those"))
    masks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(blocks(radius, agree))))

    def near(e: Column) -> Column:
        x, y = F.col("qhi").bitwiseXOR(e["hi"]), F.col("qlo").bitwiseXOR(e["lo"])
        alike = F.transform(F.filter(masks, lambda m: (x.bitwiseAND(m["a"]) == 0) & (y.bitwiseAND(m["b"]) == 0)), lambda m: m["i"])
        return (F.bit_count(x) + F.bit_count(y) <= radius) & (F.slice(alike, 1, agree) == F.col("chosen"))

    met = q.join(buckets, "key").select("qhi", "qlo", F.aggregate(F.filter("those", near), F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("n"))
    return met.groupBy(F.col("qhi").alias("hi"), F.col("qlo").alias("lo")).agg(F.sum("n").alias("n_near"))


def search(queries: DataFrame, prints: DataFrame, radius: int, *, agree: int = 2) -> DataFrame:
    """query_id, id, distance: every fingerprint of prints (id, hi, lo) within radius of a query's (query_id, hi, lo).

    Equal fingerprints are one entry of the tables, whatever number of documents has them, and are joined again to
    the documents at the end; table entries are joined on a table's key and the exact distance decides. The pairs are
    the result here; near_counts gives their numbers only.
    """
    entry = lambda df, p: df.select(F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo")).distinct()
    cut = lambda df, p: df.select("*", F.explode(block_keys(f"{p}hi", f"{p}lo", radius, agree)).alias("t")).select("*", "t.key").drop("t")
    q, d = entry(queries, "q"), entry(prints, "d")
    distance = F.bit_count(F.col("qhi").bitwiseXOR(F.col("dhi"))) + F.bit_count(F.col("qlo").bitwiseXOR(F.col("dlo")))
    pairs = cut(q, "q").join(cut(d, "d"), "key").where(distance <= radius).select("qhi", "qlo", "dhi", "dlo", distance.alias("distance")).distinct()
    named = pairs.join(queries.select("query_id", F.col("hi").alias("qhi"), F.col("lo").alias("qlo")), ["qhi", "qlo"])
    return named.join(prints.select("id", F.col("hi").alias("dhi"), F.col("lo").alias("dlo")), ["dhi", "dlo"]).select("query_id", "id", "distance")
