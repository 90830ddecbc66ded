"""Side inputs: positions, intervals, sample names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split(F.trim("value"), r"\s+").alias("f"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos; blank lines and those with # are skipped, a line that can't be read raises an error."""
    df = _fields(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    pos = F.get("f", F.lit(1)).try_cast("int")
    return df.select(F.get("f", F.lit(0)).alias("chrom"), F.when(pos.isNull(), F.raise_error(F.concat(F.lit("bad position: "), "value")).cast("int")).otherwise(pos).alias("pos"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end; the first line is always a header, lines that can't be read are left out."""
    df = _fields(spark, path).withColumn("n", F.monotonically_increasing_id()).where("n > 0")
    get = lambda k: F.get("f", F.lit(k))
    out = df.select(get(0).alias("chrom"), get(1).try_cast("int").alias("start"), get(2).try_cast("int").alias("end"))
    return out.where("chrom is not null and start is not null and end is not null")


def read_names(spark: SparkSession, path: str) -> list[str]:
    """The first word of each line, in order; a list of samples is as long as the samples at most."""
    rows = _fields(spark, path).where(F.trim("value") != "").select(F.get("f", F.lit(0)).alias("s")).collect()
    return [r.s for r in rows]
