"""VCF text (plain, gzip or BGZF) to sites, with Catalyst expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.functions.calls import CALL


@dataclass(frozen=True)
class Header:
    """Header lines of a call set."""

    lines: tuple[str, ...]
    samples: tuple[str, ...]
    contigs: tuple[str, ...] = ()
    info_types: dict[str, str] = field(default_factory=dict, hash=False)


def parse_header(lines: list[str]) -> Header:
    """Raises unless the last line is the #CHROM line."""
    if not lines or not lines[-1].startswith("#CHROM"):
        raise ValueError("no #CHROM line before the data")
    columns = lines[-1].rstrip("\r\n").split("\t")
    ids = lambda kind: [m[1] for x in lines if (m := re.match(rf"##{kind}=<ID=([^,>]+)", x))]
    kinds = {m[1]: m[2] for x in lines if (m := re.match(r"##INFO=<ID=([^,>]+),.*?Type=(\w+)", x))}
    return Header(tuple(x.rstrip("\r\n") for x in lines), tuple(columns[9:]), tuple(ids("contig")), kinds)


def read_header(spark: SparkSession, path: str) -> Header:
    """The header, read by the driver through Hadoop's file systems up to the #CHROM line and no further."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        raw = jvm.java.io.BufferedInputStream(stream)
        raw.mark(2)
        zipped = raw.read() == 0x1F and raw.read() == 0x8B
        raw.reset()
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(jvm.java.util.zip.GZIPInputStream(raw) if zipped else raw, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None and line.startswith("#"):
            lines.append(line)
            if line.startswith("#CHROM"):
                break
    finally:
        stream.close()
    return parse_header(lines)


def _call(raw: Column, at: dict[str, Column]) -> Column:
    parts = F.split(raw, ":")
    get = lambda k: F.when(at[k] > 0, F.get(parts, at[k] - 1))
    gt = F.coalesce(get("GT"), F.lit("."))
    alleles = F.split(gt, r"[/|]")
    number = lambda k: F.get(alleles, F.lit(k)).try_cast("int")
    has = at["GT"] > 0
    ploidy = F.size(alleles)
    ploidy = F.when(~has, 2).when(ploidy > 2, F.raise_error(F.lit("polyploid genotype")).cast("int")).otherwise(ploidy)
    whole = lambda k: F.greatest(F.coalesce(get(k).try_cast("int"), F.lit(-1)), F.lit(-1))
    return F.struct(
        F.when(has, number(0)).alias("a1"),
        F.when(has & (F.size(alleles) > 1), number(1)).alias("a2"),
        ploidy.cast("int").alias("ploidy"),
        gt.contains("|").alias("phased"),
        whole("DP").alias("dp"),
        whole("GQ").alias("gq"),
        get("FT").alias("ft"),
        raw.alias("raw"),
        F.lit(False).alias("masked"),
    ).cast(CALL)


def parse_sites(lines: DataFrame) -> DataFrame:
    """lines (value, and ordinal if it is known) without header lines to sites.

    Fields that a record hasn't are missing; a record of 8 columns has no calls; more than two alleles in a call
    raise an error, but only where the call is used.
    """
    if "ordinal" not in lines.columns:
        lines = lines.withColumn("ordinal", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    part = lambda k: F.get(f, F.lit(k))
    listed = lambda c, sep: F.when(c.isNull() | (c == ".") | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, sep))
    df = lines.select(
        "ordinal",
        part(0).alias("chrom"),
        part(1).cast("int").alias("pos"),
        part(2).alias("id"),
        F.concat(F.array(part(3)), listed(part(4), ",")).alias("alleles"),
        F.coalesce(part(5).try_cast("float").cast("double"), F.lit(-1.0)).alias("qual"),
        part(5).alias("qual_raw"),
        listed(part(6), ";").alias("filters"),
        part(7).alias("info"),
        F.transform(listed(part(7), ";"), lambda x: F.get(F.split(x, "="), F.lit(0))).alias("info_keys"),
        listed(part(8), ":").alias("format"),
        F.slice(f, 10, 1 << 20).alias("cells"),
    )
    at = {k: F.array_position("format", k) for k in ("GT", "DP", "GQ", "FT")}
    df = df.withColumns({f"__{k}": v for k, v in at.items()})
    return df.withColumn("calls", F.transform("cells", lambda raw: _call(raw, {k: F.col(f"__{k}") for k in at}))).drop("cells", *(f"__{k}" for k in at))


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Sites and header of one VCF file. Plain text is split between tasks; a gzip stream is one task."""
    header = read_header(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return parse_sites(lines), header


def from_lines(spark: SparkSession, text: str) -> tuple[DataFrame, Header]:
    """Sites and header of VCF text in memory, for tests and small inputs."""
    rows = [x.rstrip("\r") for x in text.split("\n") if x.strip()]
    head = [x for x in rows if x.startswith("#")]
    body = spark.createDataFrame([(i, x) for i, x in enumerate(x for x in rows if not x.startswith("#"))], "ordinal long, value string")
    return parse_sites(body), parse_header(head)
