"""Column functions on one site's calls. calls: array of (a1, a2, ploidy, phased, dp, gq, ft, raw), null alleles missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL = "struct<a1:int,a2:int,ploidy:int,phased:boolean,dp:int,gq:int,ft:string,raw:string,masked:boolean>"
SITE = f"ordinal bigint, chrom string, pos int, id string, alleles array<string>, qual double, filters array<string>, info string, info_keys array<string>, format array<string>, calls array<{CALL}>"


def settled(df: DataFrame, streaming: bool = False) -> DataFrame:
    """df, whose columns filters above don't compute again for each of their uses.

    No filter is pushed below a projection with a nondeterministic column that is asked for. A stream allows no row
    numbers, so there a random column that passes always takes their place.
    """
    return df.withColumn("__stay", F.rand(0) if streaming else F.monotonically_increasing_id()).where("__stay >= 0").drop("__stay")


def lit_set(names) -> Column:
    return F.array(*(F.lit(x) for x in sorted(names)))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; 0 / 0 is NaN and the rest over 0 infinite, as in IEEE arithmetic."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def total(array: Column, of) -> Column:
    """Sum of of(element), in longs."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, c: s + of(c).cast("long"))


def live(calls: Column) -> Column:
    return F.filter(calls, lambda c: ~c["masked"])


def observed(calls: Column) -> Column:
    """All called alleles of unmasked calls."""
    return F.filter(F.flatten(F.transform(live(calls), lambda c: F.array(c["a1"], c["a2"]))), lambda a: a.isNotNull())


def complete(c: Column) -> Column:
    return (c["ploidy"] == 2) & c["a1"].isNotNull() & c["a2"].isNotNull()


def missing_alleles(c: Column) -> Column:
    return F.when(c["ploidy"] == 2, c["a1"].isNull().cast("int") + c["a2"].isNull().cast("int")).otherwise(c["a1"].isNull().cast("int"))


def mask_reason(spec) -> object:
    """call -> whether the genotype filters mask it, given whether the site has GQ and DP."""

    def reason(c: Column, has_gq: Column, has_dp: Column) -> Column:
        out = F.lit(False)
        if spec.min_gq is not None and spec.min_gq > 0:
            out = out | (has_gq & (c["gq"] < spec.min_gq))
        if spec.min_dp is not None:
            out = out | (has_dp & (c["dp"] < spec.min_dp))
        if spec.max_dp is not None:
            out = out | (has_dp & (c["dp"] > spec.max_dp))
        tokens = F.split(F.coalesce(c["ft"], F.lit("")), ";")
        if spec.remove_filtered_geno_all:
            # The first token that says anything decides, whatever names are also given.
            first = F.get(F.filter(tokens, lambda t: (t != "") & (t != ".")), F.lit(0))
            out = out | F.coalesce(first != "PASS", F.lit(False))
        elif spec.remove_filtered_geno:
            out = out | F.arrays_overlap(tokens, lit_set(spec.remove_filtered_geno))
        return out

    return reason


def site_columns() -> dict[str, Column]:
    """The shared per-site aggregates, computed within the row; first layer (needs calls, alleles)."""
    calls = F.col("calls")
    return {
        "obs": observed(calls),
        "n_alleles": F.size("alleles"),
        "n_sel": F.size("calls"),
        "slots": total(calls, lambda c: c["ploidy"]),
        "raw_dp": total(calls, lambda c: F.when(c["dp"] >= 0, c["dp"]).otherwise(0)),
        "live_slots": total(live(calls), lambda c: c["ploidy"]),
        "n_masked": F.size(F.filter(calls, lambda c: c["masked"])),
        "half_phased": F.size(F.filter(live(calls), lambda c: c["phased"] & (c["ploidy"] == 2) & c["a2"].isNull())),
        "fully_diploid": F.forall(live(calls), lambda c: c["ploidy"] == 2),
        "n_complete": F.size(F.filter(live(calls), complete)),
        "n_het": F.size(F.filter(live(calls), lambda c: complete(c) & (c["a1"] != c["a2"]))),
        "n_hom_ref": F.size(F.filter(live(calls), lambda c: complete(c) & (c["a1"] == 0) & (c["a2"] == 0))),
        "dp_n": F.size(F.filter(live(calls), lambda c: c["dp"] >= 0)),
        "dp_sum": total(live(calls), lambda c: F.when(c["dp"] >= 0, c["dp"].cast("long")).otherwise(0)),
        "dp_sq": total(live(calls), lambda c: F.when(c["dp"] >= 0, c["dp"].cast("long") * c["dp"].cast("long")).otherwise(0)),
    }


def count_columns() -> dict[str, Column]:
    """Second layer: counts of each allele and what follows from them."""
    return {
        "n_chr": F.size("obs"),
        "ac": F.transform(F.sequence(F.lit(0), F.col("n_alleles") - 1), lambda k: F.size(F.filter("obs", lambda x: x == k)).cast("long")),
    }
