"""Per-site outputs. Each takes kept, summarized sites and returns plain columns; sites stay one row, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.functions.calls import ratio
from genomill.functions.hwe import exact_test

WRAP = 4294967295
KEY = ["ordinal", "chrom", "pos"]


def frequencies() -> Column:
    return F.transform("ac", lambda x: ratio(x, F.col("n_chr")))


def freq(sites: DataFrame) -> DataFrame:
    """chrom, pos, n_alleles, n_chr, alleles, freq (NaN without called alleles)."""
    return sites.select(*KEY, "n_alleles", "n_chr", "alleles", frequencies().alias("freq"))


def counts(sites: DataFrame) -> DataFrame:
    return sites.select(*KEY, "n_alleles", "n_chr", "alleles", F.col("ac").alias("count"))


def missing_site(sites: DataFrame) -> DataFrame:
    """A phased call whose second allele is missing counts as haploid here."""
    data = F.col("live_slots") - F.col("half_phased")
    miss = F.col("live_slots") - F.col("n_chr") - F.col("half_phased")
    return sites.select(*KEY, data.alias("n_data"), F.col("n_masked").cast("long").alias("n_filtered"), miss.alias("n_miss"), ratio(miss, data).alias("f_miss"))


def _depth_sums(corrected: bool) -> tuple[Column, Column]:
    wrap = (lambda c: c) if corrected else (lambda c: c.bitwiseAND(F.lit(WRAP).cast("long")))
    return wrap(F.col("dp_sum")), wrap(F.col("dp_sq"))


def site_depth(sites: DataFrame, corrected: bool = False) -> DataFrame:
    """Sums of depths and of their squares; kept to 32 bits unless corrected."""
    s, q = _depth_sums(corrected)
    return sites.select(*KEY, s.alias("sum_depth"), q.alias("sumsq_depth"))


def site_mean_depth(sites: DataFrame, corrected: bool = False) -> DataFrame:
    s, q = _depth_sums(corrected)
    n = F.col("dp_n")
    mean = ratio(s, n)
    var = F.when(n > 0, ratio((ratio(q, n) - mean * mean) * n, n - 1)).otherwise(F.lit(float("nan")))
    return sites.select(*KEY, mean.alias("mean_depth"), var.alias("var_depth"))


def site_quality(sites: DataFrame) -> DataFrame:
    return sites.select(*KEY, "qual")


def hardy(sites: DataFrame) -> DataFrame:
    """Observed and expected genotype counts, chi-squared and exact p values of biallelic, fully diploid sites."""
    t, het, ref = F.col("n_complete"), F.col("n_het"), F.col("n_hom_ref")
    alt = t - het - ref
    p = ratio(F.get("ac", F.lit(0)), F.col("n_chr"))
    e = [p * p * t, 2 * p * (1 - p) * t, (1 - p) * (1 - p) * t]
    chi = sum((ratio((o - x) * (o - x), x) for o, x in zip((ref, het, alt), e, strict=True)), F.lit(0.0))
    df = sites.where("n_alleles = 2 and fully_diploid")
    df = df.select(*KEY, ref.alias("obs_hom1"), het.alias("obs_het"), alt.alias("obs_hom2"), *(x.alias(f"e_{n}") for x, n in zip(e, ("hom1", "het", "hom2"), strict=True)), chi.alias("chisq"), exact_test(het, ref, alt).alias("__p"))
    return df.select("*", F.col("__p.p").alias("p_hwe"), F.col("__p.deficit").alias("p_het_deficit"), F.col("__p.excess").alias("p_het_excess")).drop("__p")


def mismatches() -> Column:
    """Ordered pairs of called alleles that differ."""
    return F.aggregate("ac", F.lit(0).cast("long"), lambda s, x: s + x * (F.col("n_chr") - x))


def site_pi(sites: DataFrame) -> DataFrame:
    n = F.col("n_chr").cast("long")
    return sites.where("fully_diploid").select(*KEY, ratio(mismatches(), n * (n - 1)).alias("pi"))
