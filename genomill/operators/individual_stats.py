"""Per-sample outputs: calls are exploded and summed by sample, with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.functions.calls import complete, ratio


def _calls(sites: DataFrame, fields: str, *more) -> DataFrame:
    """A row for each call with only the fields that are asked for."""
    slim = F.transform("calls", lambda c: F.struct(*(c[f].alias(f) for f in fields.split())))
    return sites.select(*more, F.posexplode(slim).alias("sample_idx", "c"))


def _named(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    names = F.array(*(F.lit(s) for s in samples))
    return df.select(F.get(names, F.col("sample_idx")).alias("indv"), *df.columns)


def depth(sites: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Number of kept sites where the sample has an unmasked depth, and its mean (NaN for none)."""
    seen = (~F.col("c.masked")) & (F.col("c.dp") >= 0)
    out = _calls(sites, "masked dp").groupBy("sample_idx").agg(F.count_if(seen).alias("n_sites"), F.sum(F.when(seen, F.col("c.dp").cast("long"))).alias("s"))
    return _named(out.select("sample_idx", "n_sites", ratio(F.coalesce("s", F.lit(0)), F.col("n_sites")).alias("mean_depth")), samples)


def missing(sites: DataFrame, samples: Sequence[str]) -> DataFrame:
    """A call is missing for a sample if its first allele is."""
    out = _calls(sites, "masked a1").groupBy("sample_idx").agg(
        F.count_if(~F.col("c.masked")).alias("n_data"), F.count_if("c.masked").alias("n_filtered"), F.count_if(~F.col("c.masked") & F.col("c.a1").isNull()).alias("n_miss")
    )
    return _named(out.select("*", ratio(F.col("n_miss"), F.col("n_data")).alias("f_miss")), samples)


def het(sites: DataFrame, samples: Sequence[str], epsilon: float = 1e-12) -> DataFrame:
    """Observed and expected homozygotes over biallelic, fully diploid, variable sites; samples without a call are left out."""
    p = ratio(F.get("ac", F.lit(1)), F.col("n_chr"))
    ok = sites.where((F.col("n_alleles") == 2) & F.col("fully_diploid")).select("calls", p.alias("p"), F.col("n_chr").cast("double").alias("n"))
    ok = ok.where((F.col("p") > epsilon) & (F.col("p") < 1 - epsilon))
    full = _calls(ok, "masked ploidy a1 a2", "p", "n").where(complete(F.col("c")) & ~F.col("c.masked"))
    hom = 1 - 2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)
    out = full.groupBy("sample_idx").agg(F.count_if(F.col("c.a1") == F.col("c.a2")).alias("o_hom"), F.sum(hom).alias("e_hom"), F.count("*").alias("n_sites"))
    return _named(out.select("*", ratio(F.col("o_hom") - F.col("e_hom"), F.col("n_sites") - F.col("e_hom")).alias("f")), samples)
