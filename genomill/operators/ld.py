"""Linkage disequilibrium: squared correlation of genotypes (r²) of pairs of biallelic sites in reach of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.functions.calls import complete, ratio, settled

RANK_BIN = 1 << 20
#: Sites in a block where all pairs of a chromosome are asked for.
TILE = 1024


def ranked(sites: DataFrame) -> DataFrame:
    """sites with idx, their number within the chromosome in position and input order.

    Counted in two levels, by bins of positions, so that no task numbers a whole chromosome.
    """
    df = sites.withColumn("__bin", (F.col("pos") - F.col("pos") % RANK_BIN).cast("long"))
    before = Window.partitionBy("chrom").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy("chrom", "__bin").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("chrom", "__bin").orderBy("pos", "ordinal"))
    return df.join(bases, ["chrom", "__bin"]).withColumn("idx", (F.col("__base") + own).cast("long")).drop("__bin", "__base")


def geno_r2(sites: DataFrame, *, window: int | None = None, window_min: int | None = None, bp: int | None = None, bp_min: int | None = None, min_r2: float | None = None) -> DataFrame:
    """chrom, pos1, pos2, n_indv, r2 of pairs i < j on a chromosome within the windows; NaN where a site doesn't vary.

    Dosages are packed to arrays of small integers. With a window the pairs meet by an equality join on blocks of its
    length (each right site is in its own block and the one before); without one all pairs of a chromosome are asked for,
    and they meet in pairs of blocks of TILE sites, so that no task gets a whole chromosome.
    """
    dose = F.transform("calls", lambda c: F.when(complete(c) & ~c["masked"], (c["a1"] == 0).cast("tinyint") + (c["a2"] == 0).cast("tinyint")))
    df = ranked(sites.where("n_alleles = 2").select("ordinal", "chrom", "pos", dose.alias("g")))
    keys, cond = ["chrom"], (F.col("b.idx") > F.col("a.idx"))
    left, right = df, df
    if window is not None or bp is not None:
        axis, width = ("idx", window) if window is not None else ("pos", bp)
        block = F.floor(F.col(axis) / max(width, 1)).cast("long")
        left, right, keys = df.withColumn("blk", block), df.withColumn("blk", F.explode(F.array(block, block - 1))), ["chrom", "blk"]
    else:
        block = F.floor((F.col("idx") - 1) / TILE).cast("long")
        last = df.groupBy("chrom").agg(F.floor((F.max("idx") - 1) / TILE).cast("long").alias("last"))
        left = df.join(last, "chrom").withColumn("i", block).withColumn("j", F.explode(F.sequence(block, "last"))).drop("last")
        right, keys = df.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), block))), ["chrom", "i", "j"]
    gap, far = F.col("b.idx") - F.col("a.idx"), F.col("b.pos") - F.col("a.pos")
    cond = cond & (gap >= max(1, window_min or 0))
    for limit, value, more in ((window, gap, False), (bp, far, False), (bp_min, far, True)):
        if limit is not None:
            cond = cond & (value >= limit if more else value <= limit)
    pairs = left.alias("a").join(right.alias("b"), keys).where(cond)
    both = F.filter(F.zip_with("a.g", "b.g", lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    pairs = pairs.select("chrom", F.col("a.pos").alias("pos1"), F.col("b.pos").alias("pos2"), both.alias("v"))
    add = lambda f: F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + f(e))
    sums = {"n": F.size("v").cast("long"), "sx": add(lambda e: e["x"]), "sy": add(lambda e: e["y"]), "sxx": add(lambda e: e["x"] * e["x"]), "syy": add(lambda e: e["y"] * e["y"]), "sxy": add(lambda e: e["x"] * e["y"])}
    out = settled(pairs.withColumns(sums))
    cov = F.expr("n * sxy - sx * sy")
    r2 = ratio(cov.cast("double") * cov.cast("double"), F.expr("cast(n * sxx - sx * sx as double) * cast(n * syy - sy * sy as double)"))
    out = out.select("chrom", "pos1", "pos2", F.col("n").alias("n_indv"), r2.alias("r2"))
    return out.where(~F.isnan("r2") & (F.col("r2") >= min_r2)) if min_r2 and min_r2 > 0 else out
