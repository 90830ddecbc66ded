"""A call set from the ordinary tables part and lineitem: parts are sites, groups of suppliers are samples.

The projection uses integers only, so SQL gives the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.functions.calls import CALL

SAMPLES = 20


def samples_of(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the samples that any line item has."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % SAMPLES).alias("s")).distinct().orderBy("s").collect()  # at most SAMPLES rows
    return [f"S{r.s:02d}" for r in rows]


def sites(spark: SparkSession, sf_dir: str, copy: int = 1) -> DataFrame:
    """Sites with calls for the copy-th line item of each part and sample; copy 2 leaves out every third part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    if copy != 1:
        part = part.where("p_partkey % 3 <> 0")
    n_alleles = F.expr("case when p_partkey % 11 = 0 then 3 else 2 end")
    part = part.select(
        F.col("p_partkey").cast("long").alias("ordinal"),
        F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chrom"),
        ((F.col("p_partkey") - F.col("p_partkey") % 5) * 20 + F.col("p_size")).cast("int").alias("pos"),
        F.lit(".").alias("id"),
        F.expr("concat(array(case when p_partkey % 13 = 0 then 'AT' else 'A' end, 'C'), case when p_partkey % 11 = 0 then array('G') else array() end)").alias("alleles"),
        F.expr("case when p_partkey % 17 = 0 then -1D else cast(p_partkey * 7 % 100 as double) end").alias("qual"),
        F.expr("case p_partkey % 4 when 0 then array('PASS') when 1 then array() when 2 then array('q10') else array('q10', 's50') end").cast("array<string>").alias("filters"),
        F.lit(".").alias("info"),
        F.expr("concat(case when p_size % 3 = 0 then array('DB') else array() end, case when p_size % 5 = 0 then array('H2') else array() end)").cast("array<string>").alias("info_keys"),
        F.array(F.lit("GT"), F.lit("DP"), F.lit("GQ"), F.lit("FT")).alias("format"),
        n_alleles.alias("__na"),
    )
    order = Window.partitionBy("l_partkey", "s").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("s", (F.col("l_suppkey") % SAMPLES).cast("int"))
    # One exchange by part serves the ranking, the grouping and the join.
    item = item.repartition("l_partkey").withColumn("rn", F.row_number().over(order)).where(F.col("rn") == copy)
    cells = item.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("s", "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "l_discount"))).alias("cells"))
    n = len(samples_of(spark, sf_dir))
    df = part.join(cells, part["ordinal"] == cells["l_partkey"], "left")
    by_sample = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["s"], c)))
    df = df.withColumn("__m", F.when(F.col("cells").isNotNull(), by_sample))
    site = F.col("ordinal")

    def call(i: Column) -> Column:
        c = F.col("__m")[i]
        gone = c.isNull() | (c["l_linenumber"] == 7)
        chance = (site * 37) % 100
        a1 = F.when((c["l_orderkey"] * 7919 + c["l_linenumber"] * 31) % 100 < chance, (1 + c["l_orderkey"] % (F.col("__na") - 1)).cast("int")).otherwise(0)
        haploid = F.coalesce(c["l_linenumber"] == 5, F.lit(False)) & (site % 7 == 0)
        half = (c["l_linenumber"] == 6) & (c["l_linestatus"] == "O")
        a2 = F.when((c["l_orderkey"] * 104729 + c["l_suppkey"] * 17) % 100 < chance, 1).otherwise(0)
        return F.struct(
            F.when(~gone, a1).alias("a1"),
            F.when(~gone & ~half & ~haploid, a2).alias("a2"),
            F.when(haploid, 1).otherwise(2).alias("ploidy"),
            F.coalesce(c["l_linestatus"] == "F", F.lit(False)).alias("phased"),
            F.coalesce(c["l_quantity"].cast("int"), F.lit(-1)).alias("dp"),
            F.coalesce(F.round(c["l_discount"] * 100).cast("int") * 9 + c["l_linenumber"].cast("int"), F.lit(-1)).alias("gq"),
            F.when(c["l_returnflag"] == "N", "PASS").when(c["l_returnflag"] == "R", "LowDP").otherwise(".").alias("ft"),
            F.lit(None).cast("string").alias("raw"),
            F.lit(False).alias("masked"),
        ).cast(CALL)

    return df.withColumn("calls", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), call)).drop("cells", "__m", "__na", "l_partkey")
