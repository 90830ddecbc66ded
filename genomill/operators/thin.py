"""Ordered greedy thinning: a site goes if it is less than N bases behind the last kept site of its chromosome."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thinned(sites: DataFrame, distance: int) -> DataFrame:
    """Kept sites, each chromosome on its own in input order.

    A gap of at least the distance before a site makes it kept whatever came before, so chromosomes fall into
    independent runs at such gaps and the runs are folded in parallel.
    """
    if distance < 1:
        return sites
    order = Window.partitionBy("chrom").orderBy("ordinal")
    slim = sites.select("ordinal", "chrom", "pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(order) >= distance, F.lit(True))
    runs = slim.withColumn("__new", fresh.cast("int")).withColumn("__run", F.sum("__new").over(order))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = (None, None, 0)
        for batch in batches:
            keep = []
            for chrom, run, pos in zip(batch["chrom"], batch["run"], batch["pos"], strict=True):
                if (chrom, run) != last[:2] or pos - last[2] >= distance:
                    last = (chrom, run, pos)
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.loc[keep, ["ordinal"]]

    kept = runs.select("ordinal", "chrom", F.col("__run").alias("run"), "pos").repartition("chrom", "run").sortWithinPartitions("chrom", "run", "ordinal").mapInPandas(fold, "ordinal long")
    return sites.join(kept, "ordinal", "left_semi")
