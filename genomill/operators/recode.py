"""Kept sites back to VCF lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.sources.vcf import Header


def recoded_header(header: Header, samples: Sequence[str]) -> list[str]:
    columns = header.lines[-1].split("\t")[:9] if samples else header.lines[-1].split("\t")[:8]
    return [*header.lines[:-1], "\t".join([*columns, *samples])]


def recode(sites: DataFrame, info_all: bool = False) -> DataFrame:
    """ordinal, line: several FILTER names are sorted, INFO is kept only if asked for, a masked genotype is ./. whatever its ploidy."""
    gt = F.array_position("format", "GT")

    def cell(c):
        parts = F.split(c["raw"], ":")
        hidden = F.array_join(F.transform(parts, lambda x, i: F.when(i == gt - 1, "./.").otherwise(x)), ":")
        return F.when(c["masked"] & (gt > 0), hidden).otherwise(c["raw"])

    dotted = lambda c, sep: F.when(F.size(c) == 0, ".").otherwise(F.array_join(c, sep))
    fixed = [
        F.col("chrom"),
        F.col("pos").cast("string"),
        F.col("id"),
        F.get("alleles", F.lit(0)),
        dotted(F.slice("alleles", 2, 1 << 20), ","),
        F.col("qual_raw"),
        dotted(F.array_sort("filters"), ";"),
        F.col("info") if info_all else F.lit("."),
    ]
    with_calls = F.concat(F.array(*fixed, dotted(F.col("format"), ":")), F.transform("calls", cell))
    return sites.select("ordinal", F.array_join(F.when(F.size("calls") > 0, with_calls).otherwise(F.array(*fixed)), "\t").alias("line"))
