"""Sample selection and joins of sites with side tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.spec import QuerySpec, SpecError

#: A side table of fewer rows is broadcast; a larger one is joined by its key with a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> bool:
    """Whether a side table is short enough to send to every executor; reads no more rows than the bound."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def selected(samples: Sequence[str], spec: QuerySpec) -> list[int]:
    """Numbers of the samples to keep, in input order: those named to keep (or in a population), less those to remove."""
    keep = set(spec.keep_samples).union(*spec.populations)
    out = [i for i, s in enumerate(samples) if (not keep or s in keep) and s not in spec.remove_samples]
    if not out and samples:
        raise SpecError("Sample filters removed all individuals")
    return out


def population_indices(samples: Sequence[str], populations: Iterable[Sequence[str]]) -> list[list[int]]:
    """For each population the numbers of its samples; names that aren't there and repeats count for nothing."""
    return [[i for i, s in enumerate(samples) if s in set(p)] for p in populations]


def with_samples(sites: DataFrame, indices: Sequence[int], n: int) -> DataFrame:
    """Only the calls of the numbered samples."""
    if list(indices) == list(range(n)):
        return sites
    at = F.array(*(F.lit(i) for i in indices))
    return sites.withColumn("calls", F.transform(at, lambda i: F.get("calls", i)))


def at_positions(sites: DataFrame, positions: DataFrame, keep: bool) -> DataFrame:
    """Semi (keep) or anti join on (chrom, pos)."""
    side = positions.select("chrom", "pos").distinct()
    side = F.broadcast(side) if small(positions) else side
    return sites.join(side, ["chrom", "pos"], "left_semi" if keep else "left_anti")


def in_intervals(sites: DataFrame, bed: DataFrame, keep: bool, bin_size: int = 1 << 14) -> DataFrame:
    """Sites whose longest allele's span meets an interval (start < end of span, end >= pos), or those without one.

    Sites and intervals meet in bins of positions, so the join is an equality join on (chrom, bin), not a range join
    of everything; an interval is in each bin that it covers.
    """
    span = F.greatest(F.col("pos"), F.col("pos") + F.array_max(F.transform("alleles", F.length)) - 1)
    cut = lambda x: F.floor(x / bin_size).cast("long")
    left = sites.withColumn("__end", span)
    hits = left.select("ordinal", "chrom", "pos", "__end", F.explode(F.sequence(cut(F.col("pos")), cut(F.col("__end")))).alias("__bin"))
    right = bed.where("end >= start").select(F.col("chrom").alias("__chrom"), "start", "end", F.explode(F.sequence(cut(F.col("start")), cut(F.col("end")))).alias("__b"))
    right = F.broadcast(right) if small(right) else right
    met = hits.join(right, (hits["chrom"] == right["__chrom"]) & (hits["__bin"] == right["__b"]) & (right["start"] < hits["__end"]) & (right["end"] >= hits["pos"]), "left_semi")
    return sites.join(met.select("ordinal").distinct(), "ordinal", "left_semi" if keep else "left_anti")


def beside(sites: DataFrame, positions: DataFrame | None = None, exclude_positions: DataFrame | None = None, bed: DataFrame | None = None, exclude_bed: DataFrame | None = None) -> DataFrame:
    """sites after those of the side tables that there are."""
    for side, keep in ((positions, True), (exclude_positions, False)):
        sites = sites if side is None else at_positions(sites, side, keep)
    for side, keep in ((bed, True), (exclude_bed, False)):
        sites = sites if side is None else in_intervals(sites, side, keep)
    return sites
