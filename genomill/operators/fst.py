"""Weir and Cockerham's F_ST (1984), by site and by window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.functions.calls import complete, live, ratio, settled
from genomill.operators.windows import bins


def _components(pops: Sequence[str], k: Column) -> Column:
    """Struct of a, b, c summed up for allele k; pops: columns with each population's complete calls."""
    r = len(pops)
    n = [F.size(p).cast("double") for p in pops]
    share = [ratio(F.size(F.filter(p, lambda c: c["a1"] == k)) + F.size(F.filter(p, lambda c: c["a2"] == k)), 2 * m) for p, m in zip(pops, n, strict=True)]
    het = [ratio(F.size(F.filter(p, lambda c: (c["a1"] != c["a2"]) & ((c["a1"] == k) | (c["a2"] == k)))), m) for p, m in zip(pops, n, strict=True)]
    return F.struct(*(x.alias(f"n{i}") for i, x in enumerate(n)), *(x.alias(f"p{i}") for i, x in enumerate(share)), *(x.alias(f"h{i}") for i, x in enumerate(het)), F.lit(r).alias("r"))


def _abc(x: Column, r: int) -> list[Column]:
    n, p, h = ([x[f"{c}{i}"] for i in range(r)] for c in "nph")
    add = lambda xs: sum(xs[1:], xs[0])
    total = add(n)
    bar = total / r
    nc = (total - ratio(add([m * m for m in n]), total)) / (r - 1)
    pb, hb = (ratio(add([m * v for m, v in zip(n, q, strict=True)]), total) for q in (p, h))
    s2 = ratio(add([m * (v - pb) * (v - pb) for m, v in zip(n, p, strict=True)]), (r - 1) * bar)
    pq = pb * (1 - pb)
    rest = (r - 1) / r * s2
    a = ratio(bar, nc) * (s2 - ratio(pq - rest - hb / 4, bar - 1))
    b = ratio(bar, bar - 1) * (pq - rest - ratio((2 * bar - 1) * hb, 4 * bar))
    return [a, b, hb / 2]


def site_fst(sites: DataFrame, populations: Sequence[Sequence[int]]) -> DataFrame:
    """ordinal, chrom, pos, num (sum of a), den (sum of a + b + c), fst of fully diploid sites.

    Alleles whose parts are no numbers are left out; without any the site's F_ST is NaN. A row's work is within it.
    """
    r = len(populations)
    names = [f"__pop{i}" for i in range(r)]
    df = sites.where("fully_diploid").select("ordinal", "chrom", "pos", "n_alleles", *(F.filter(live(F.transform(F.array(*(F.lit(i).cast("int") for i in p)), lambda i: F.get("calls", i))), complete).alias(c) for p, c in zip(populations, names, strict=True)))
    df = df.withColumn("__x", F.transform(F.sequence(F.lit(0), F.col("n_alleles") - 1), lambda k: _components(names, k)))
    df = df.withColumn("__abc", F.transform("__x", lambda x: F.array(*_abc(x, r))))
    good = F.filter("__abc", lambda v: ~F.exists(v, lambda y: F.isnan(y) | (F.abs(y) == float("inf"))))
    df = df.select("ordinal", "chrom", "pos", good.alias("__good"))
    num = F.aggregate("__good", F.lit(0.0), lambda s, v: s + v[0])
    den = F.aggregate("__good", F.lit(0.0), lambda s, v: s + v[0] + v[1] + v[2])
    df = df.select("ordinal", "chrom", "pos", num.alias("num"), den.alias("den"))
    return df.withColumn("fst", ratio(F.col("num"), F.col("den")))


def window_fst(sites: DataFrame, populations: Sequence[Sequence[int]], size: int, step: int | None = None) -> DataFrame:
    """chrom, bin_start, bin_end, n_variants, weighted_fst, mean_fst over sites whose F_ST is a number."""
    step = size if not step or step <= 0 or step > size else step
    ok = settled(site_fst(sites, populations)).where(~F.isnan("fst") & (F.abs("fst") != float("inf")))
    out = ok.select("chrom", F.explode(bins(F.col("pos"), size, step)).alias("bin"), "num", "den", "fst").groupBy("chrom", "bin")
    out = out.agg(F.count("*").alias("n_variants"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.avg("fst").alias("mean_fst")).where("den <> 0 and not isnan(den)")
    start = F.col("bin") * step
    return out.select("chrom", (start + 1).alias("bin_start"), (start + size).alias("bin_end"), "n_variants", ratio(F.col("num"), F.col("den")).alias("weighted_fst"), "mean_fst")
