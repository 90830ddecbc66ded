"""Site outputs over a folder that VCF lines keep coming into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import selectors
from genomill.operators.filters import kept_sites
from genomill.sources.vcf import Header, parse_sites
from genomill.spec import QuerySpec, SpecError


def stream_sites(spark: SparkSession, folder: str, header: Header, spec: QuerySpec) -> DataFrame:
    """A streaming frame of kept, summarized sites in append mode.

    All filters are local to a site, so no state is kept and nothing is shuffled; thinning needs the order of all
    sites and is refused.
    """
    if spec.thin:
        raise SpecError("thinning needs all sites in order")
    lines = spark.readStream.text(folder).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    # A stream numbers no rows across its batches.
    sites = parse_sites(lines.withColumn("ordinal", F.lit(None).cast("long")))
    at = selectors.selected(header.samples, spec)
    return kept_sites(selectors.with_samples(sites, at, len(header.samples)), spec, streaming=True)
