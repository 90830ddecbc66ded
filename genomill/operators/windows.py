"""Statistics over windows of positions: a site goes to the bins that it is in, and bins are summed with partial sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.functions.calls import ratio
from genomill.operators.site_stats import mismatches


def bins(pos: Column, size: int, step: int) -> Column:
    """Numbers of the windows [i * step + 1, i * step + size] that hold pos."""
    first = F.greatest(F.ceil((pos - size) / F.lit(step)), F.lit(0)).cast("long")
    return F.sequence(first, F.ceil(pos / F.lit(step)).cast("long") - 1)


def checked_order(sites: DataFrame) -> DataFrame:
    """sites, failing when run if positions decrease within a chromosome or a chromosome comes again."""
    order = Window.partitionBy("chrom").orderBy("ordinal")
    slim = sites.select("ordinal", "chrom", "pos").withColumns({"__before": F.lag("pos").over(order), "__first": F.min("ordinal").over(Window.partitionBy("chrom")), "__last": F.max("ordinal").over(Window.partitionBy("chrom"))})
    if not slim.where("__before > pos").isEmpty():
        raise ValueError("positions decrease within a chromosome")
    spans = slim.select("chrom", F.col("__first").alias("a"), F.col("__last").alias("b")).distinct().orderBy("a").collect()  # a row for each chromosome
    if any(x.b > y.a for x, y in zip(spans, spans[1:], strict=False)):
        raise ValueError("a chromosome comes again after another")
    return sites


def window_pi(sites: DataFrame, size: int, step: int | None, n_samples: int) -> DataFrame:
    """chrom, bin_start, bin_end, n_variants, n_monomorphic, pi. Exact in integers up to the last division."""
    step = size if not step or step <= 0 or step > size else step
    n = F.col("n_chr").cast("long")
    ok = sites.where("fully_diploid").select("chrom", "pos", mismatches().alias("mism"), (n * (n - 1)).alias("pairs"), (F.get("ac", F.lit(0)) < n).alias("variant"))
    ok = ok.where("mism > 0")
    out = ok.select("chrom", F.explode(bins(F.col("pos"), size, step)).alias("bin"), "mism", "pairs", "variant").groupBy("chrom", "bin")
    out = out.agg(F.count_if("variant").alias("n_variants"), F.count("*").alias("k"), F.sum("mism").alias("mism"), F.sum("pairs").alias("pairs"))
    c = 2 * n_samples
    mono = F.lit(size).cast("long") - F.col("k")
    start = F.col("bin") * step
    return out.where("n_variants > 0 or mism > 0").select("chrom", (start + 1).alias("bin_start"), (start + size).alias("bin_end"), "n_variants", mono.alias("n_monomorphic"), ratio(F.col("mism"), F.col("pairs") + mono * c * (c - 1)).alias("pi"))


def tajima_constants(n: int) -> tuple[float, float, float]:
    """(a1, e1, e2) of Tajima 1989 for n chromosomes."""
    a1 = math.fsum(1 / i for i in range(1, n))
    a2 = math.fsum(1 / (i * i) for i in range(1, n))
    if n < 2:
        return math.nan, math.nan, math.nan
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    return a1, c1 / a1, c2 / (a1 * a1 + a2)


def tajima_d(sites: DataFrame, size: int, n_samples: int) -> DataFrame:
    """chrom, bin_start, n_snps, tajima_d of 0-based bins, from the first with a site to the last, gaps included (NaN)."""
    n = 2 * n_samples
    a1, e1, e2 = tajima_constants(n)
    p = ratio(F.get("ac", F.lit(0)), F.col("n_chr"))
    ok = sites.where("n_alleles = 2 and fully_diploid").select("chrom", (F.col("pos") - F.col("pos") % size).cast("long").alias("bin_start"), p.alias("p"))
    snp = (F.col("p") > 0) & (F.col("p") < 1)
    sums = ok.groupBy("chrom", "bin_start").agg(F.count_if(snp).alias("s"), F.sum(F.when(snp, F.col("p") * (1 - F.col("p")))).alias("pq"))
    # The grid starts at the first bin with a variable site.
    spans = sums.groupBy("chrom").agg(F.min(F.when(F.col("s") > 0, F.col("bin_start"))).alias("lo"), F.max("bin_start").alias("hi")).where("lo is not null")
    grid = spans.select("chrom", F.explode(F.sequence("lo", "hi", F.lit(size).cast("long"))).alias("bin_start"))
    out = grid.join(sums, ["chrom", "bin_start"], "left")
    s = F.coalesce("s", F.lit(0)).cast("long")
    pi = 2 * F.coalesce("pq", F.lit(0.0)) * n / (n - 1) if n > 1 else F.lit(math.nan)
    d = F.when(s > 0, ratio(pi - s / F.lit(a1), F.sqrt(F.lit(e1) * s + F.lit(e2) * s * (s - 1)))).otherwise(F.lit(math.nan))
    return out.select("chrom", "bin_start", s.alias("n_snps"), d.alias("tajima_d"))
