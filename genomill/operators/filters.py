"""Site filters, in two layers: those that need the record only, and those that need its calls' aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.functions.calls import count_columns, lit_set, mask_reason, ratio, settled, site_columns
from genomill.functions.hwe import exact_test
from genomill.operators.thin import thinned
from genomill.spec import QuerySpec


def record_predicates(spec: QuerySpec) -> list[Column]:
    """Predicates on chromosome, position, FILTER, INFO, alleles and quality; pushed to the scan where it can take them."""
    c, out = F.col, []
    if spec.chroms:
        out.append(c("chrom").isin(sorted(spec.chroms)))
    if spec.not_chroms:
        out.append(~c("chrom").isin(sorted(spec.not_chroms)))
    if spec.from_bp is not None:
        out.append(c("pos") >= spec.from_bp)
    if spec.to_bp is not None:
        out.append(c("pos") <= spec.to_bp)
    passed = F.coalesce(F.get("filters", F.lit(0)) == "PASS", F.lit(False))
    if spec.keep_filtered:
        out.append(F.arrays_overlap("filters", lit_set(spec.keep_filtered)))
    if spec.remove_filtered:
        out.append(passed | ~F.arrays_overlap("filters", lit_set(spec.remove_filtered)))
    if spec.remove_filtered_all:
        out.append((F.size("filters") == 0) | passed)
    if spec.keep_info:
        out.append(F.arrays_overlap("info_keys", lit_set(spec.keep_info)))
    if spec.remove_info:
        out.append(~F.arrays_overlap("info_keys", lit_set(spec.remove_info)))
    low, high = spec.biallelic
    if low is not None:
        out.append(F.size("alleles") >= low)
    if high is not None:
        out.append(F.size("alleles") <= high)
    # An indel has a reference of more than one base, or an alternate of another length than the reference.
    indel = (F.length(F.get("alleles", F.lit(0))) != 1) | F.exists("alleles", lambda a: F.length(a) != F.length(F.get("alleles", F.lit(0))))
    if spec.remove_indels:
        out.append(~indel)
    if spec.keep_only_indels:
        out.append(indel)
    if spec.min_q is not None and spec.min_q >= 0:
        out.append(c("qual") >= spec.min_q)
    return out


def call_predicates(spec: QuerySpec) -> list[Column]:
    """Predicates on the aggregates of site_columns and count_columns."""
    c, out = F.col, []
    mean = ratio(c("raw_dp"), c("n_sel"))
    if spec.min_mean_dp is not None:
        out.append(mean >= spec.min_mean_dp)
    if spec.max_mean_dp is not None:
        out.append(mean <= spec.max_mean_dp)
    if spec.max_missing is not None:
        out.append((c("slots") == 0) | (ratio(c("n_chr"), c("slots")) >= spec.max_missing))
    if spec.max_missing_count is not None:
        out.append(c("slots") - c("n_chr") <= spec.max_missing_count)
    freq = F.transform("ac", lambda x: ratio(x, c("n_chr")))
    maf = F.array_min(F.transform(freq, lambda f: F.least(f, 1 - f)))
    empty = c("n_chr") == 0
    # A site without called alleles has an endless minor frequency: above every minimum, above every finite maximum.
    if spec.maf is not None:
        out.append(empty | (maf >= spec.maf))
    if spec.max_maf is not None:
        out.append(~empty & (maf <= spec.max_maf))
    least = F.array_min("ac")
    if spec.mac is not None:
        out.append(least >= spec.mac)
    if spec.max_mac is not None:
        out.append(least <= spec.max_mac)
    alt_f, alt_c = F.slice(freq, 2, 1 << 20), F.slice("ac", 2, 1 << 20)
    low, high = spec.non_ref_af, spec.max_non_ref_af
    inside = lambda x, a, b: reduce(lambda p, q: p & q, [*([x >= a] if a is not None else []), *([x <= b] if b is not None else [])], F.lit(True))
    if low is not None or high is not None:
        out.append(F.forall(alt_f, lambda f: F.isnan(f) | inside(f, low, high)))
        # The "any" form of the frequency counts only beside the plain one.
        if spec.non_ref_af_any is not None or spec.max_non_ref_af_any is not None:
            out.append((F.size(alt_f) == 0) | F.exists(alt_f, lambda f: F.isnan(f) | inside(f, spec.non_ref_af_any, spec.max_non_ref_af_any)))
    if spec.non_ref_ac is not None or spec.max_non_ref_ac is not None:
        out.append(F.forall(alt_c, lambda n: inside(n, spec.non_ref_ac, spec.max_non_ref_ac)))
    if spec.non_ref_ac_any is not None or spec.max_non_ref_ac_any is not None:
        out.append((F.size(alt_c) == 0) | F.exists(alt_c, lambda n: inside(n, spec.non_ref_ac_any, spec.max_non_ref_ac_any)))
    return out


def masked(sites: DataFrame, spec: QuerySpec) -> DataFrame:
    """calls with masked set by the genotype filters; no call is dropped."""
    if not (spec.min_gq or spec.min_dp is not None or spec.max_dp is not None or spec.remove_filtered_geno or spec.remove_filtered_geno_all):
        return sites
    reason = mask_reason(spec)
    has = lambda k: F.array_contains("format", k)
    return sites.withColumn("calls", F.transform("calls", lambda c: c.withField("masked", c["masked"] | reason(c, has("GQ"), has("DP")))))


def summarized(sites: DataFrame, streaming: bool = False) -> DataFrame:
    """sites with the per-site aggregates, all within the row and computed once for every filter and output on them."""
    return settled(sites.withColumns(site_columns()).withColumns(count_columns()), streaming)


def kept_sites(sites: DataFrame, spec: QuerySpec, streaming: bool = False) -> DataFrame:
    """Sites that pass all filters, masked and summarized."""
    record, calls = record_predicates(spec), call_predicates(spec)
    if record:
        sites = sites.where(reduce(lambda a, b: a & b, record))
    sites = summarized(masked(sites, spec), streaming)
    if spec.hwe is not None:
        sites = sites.withColumn("__hwe", exact_test(F.col("n_het"), F.col("n_hom_ref"), F.col("n_complete") - F.col("n_het") - F.col("n_hom_ref"))["p"])
        calls.append(F.col("__hwe") >= spec.hwe)
    if calls:
        sites = sites.where(reduce(lambda a, b: a & b, calls)).drop("__hwe")
    return thinned(sites, spec.thin) if spec.thin and spec.thin >= 1 else sites
