"""Comparison of two call sets: full outer joins by position, and by sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.functions.calls import ratio

UNKNOWN = ("N", ".", "")


def diff_individuals(spark, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """indv, files (B, 1 or 2), by name."""
    a, b = set(first), set(second)
    rows = [(s, "B" if s in a and s in b else "1" if s in a else "2") for s in sorted(a | b)]
    return spark.createDataFrame(rows, "indv string, files string")


def _numbered(sites: DataFrame, side: str) -> DataFrame:
    """Records of one position are paired in order, the k-th with the k-th."""
    again = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("ordinal"))
    ref, alts = F.get("alleles", F.lit(0)), F.slice("alleles", 2, 1 << 20)
    return sites.select("chrom", "pos", again.alias("k"), ref.alias(f"ref{side}"), alts.alias(f"alt{side}"), F.col("alleles").alias(f"alleles{side}"), F.col("calls").alias(f"calls{side}"))


def _paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer join with the references resolved: an unknown one takes the other's."""
    df = _numbered(first, "1").join(_numbered(second, "2"), ["chrom", "pos", "k"], "full_outer")
    unknown = lambda c: F.col(c).isin(*UNKNOWN)
    r1 = F.when(unknown("ref1"), F.col("ref2")).otherwise(F.col("ref1"))
    r2 = F.when(unknown("ref2"), r1).otherwise(F.col("ref2"))
    both = F.col("alleles1").isNotNull() & F.col("alleles2").isNotNull()
    clash = both & (F.col("r1") != F.col("r2")) & ~unknown("r1") & ~unknown("r2")
    return df.withColumns({"r1": r1, "r2": r2}).withColumns({"both": both, "clash": clash})


def _names(alleles: str, c: Column) -> list[Column]:
    return [F.coalesce(F.get(alleles, c[a]), F.lit(".")) for a in ("a1", "a2")]


def _compared(pairs: Sequence[tuple[int, int]]) -> Column:
    """Array over common samples of (called in both, differing)."""

    def one(i: int, j: int) -> Column:
        x, y = F.get("calls1", F.lit(i)), F.get("calls2", F.lit(j))
        # A haploid call counts as missing here.
        gone = lambda c: (c["ploidy"] < 2) | (c["a1"].isNull() & c["a2"].isNull())
        called = ~gone(x) & ~gone(y)
        unlike = lambda p, q: ~(((p[0] == q[0]) & (p[1] == q[1])) | ((p[0] == q[1]) & (p[1] == q[0])))
        index = lambda c: [F.coalesce(c["a1"], F.lit(-1)), F.coalesce(c["a2"], F.lit(-1))]
        same = (F.col("r1") == F.col("r2")) & (F.col("alt1") == F.col("alt2"))
        differ = F.when(same, unlike(index(x), index(y))).otherwise(unlike(_names("alleles1", x), _names("alleles2", y)))
        return F.struct(F.coalesce(called, F.lit(False)).alias("called"), F.coalesce(called & differ, F.lit(False)).alias("discord"))

    return F.array(*(one(i, j) for i, j in pairs)) if pairs else F.array().cast("array<struct<called:boolean,discord:boolean>>")


def _common(first: Sequence[str], second: Sequence[str]) -> list[tuple[str, int, int]]:
    at = {s: j for j, s in enumerate(second)}
    return [(s, i, at[s]) for i, s in enumerate(first) if s in at]


def site_discordance(first: DataFrame, second: DataFrame, samples1: Sequence[str], samples2: Sequence[str]) -> DataFrame:
    """chrom, pos, files, matching_alleles, n_common_called, n_discord, discordance; records whose references clash are left out."""
    df = _paired(first, second).where(~F.coalesce("clash", F.lit(False)))
    df = df.withColumn("v", F.when(F.col("both"), _compared([(i, j) for _, i, j in _common(samples1, samples2)])))
    files = F.when(F.col("both"), "B").when(F.col("alleles1").isNotNull(), "1").otherwise("2")
    called = F.coalesce(F.size(F.filter("v", lambda e: e["called"])), F.lit(0)).cast("long")
    discord = F.coalesce(F.size(F.filter("v", lambda e: e["discord"])), F.lit(0)).cast("long")
    match = (F.col("both") & (F.col("r1") == F.col("r2")) & (F.col("alt1") == F.col("alt2"))).cast("int")
    out = df.select("chrom", "pos", files.alias("files"), F.coalesce(match, F.lit(0)).alias("matching_alleles"), F.when(F.col("both"), called).otherwise(0).alias("n_common_called"), F.when(F.col("both"), discord).otherwise(0).alias("n_discord"))
    return out.withColumn("discordance", ratio(F.col("n_discord"), F.col("n_common_called")))


def individual_discordance(first: DataFrame, second: DataFrame, samples1: Sequence[str], samples2: Sequence[str]) -> DataFrame:
    """indv, n_common_called, n_discord, discordance by name, over common sites; samples of one side have 0 0 NaN."""
    common = _common(samples1, samples2)
    df = _paired(first, second).where(F.col("both") & ~F.coalesce("clash", F.lit(False)))
    sums = df.select(F.posexplode(_compared([(i, j) for _, i, j in common])).alias("k", "e")).groupBy("k").agg(F.count_if("e.called").alias("n_common_called"), F.count_if("e.discord").alias("n_discord"))
    at = {s: k for k, (s, _, _) in enumerate(common)}
    names = first.sparkSession.createDataFrame([(s, at.get(s)) for s in sorted({*samples1, *samples2})], "indv string, k int")
    out = names.join(sums, "k", "left").select("indv", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_common_called", "n_discord")))
    return out.withColumn("discordance", ratio(F.col("n_discord"), F.col("n_common_called")))


def site_presence(first: DataFrame, second: DataFrame) -> DataFrame:
    """chrom, pos1, pos2, in_file (B, 1, 2, O), ref1, ref2, alt1, alt2.

    O stands for records that overlap: at one position with other references, or where the later record begins inside
    the earlier one's reference. Each consumes its partner, so records are walked in order; they are dealt out by runs
    that no reference allele reaches across.
    """
    cols = ["chrom", "pos", "side", "ordinal", "ref", "alt"]
    one = lambda df, side: df.select("chrom", "pos", F.lit(side).alias("side"), "ordinal", F.get("alleles", F.lit(0)).alias("ref"), F.array_join(F.slice("alleles", 2, 1 << 20), ",").alias("alt"))
    df = one(first, 1).unionByName(one(second, 2))
    end = F.col("pos") + F.length("ref") - 1
    order = Window.partitionBy("chrom").orderBy("pos", "side", "ordinal")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["side"] == s].sort_values(["pos", "ordinal"]).to_dict("records") for s in (1, 2)]
        i = j = 0
        out = []

        def row(x: dict | None, y: dict | None, kind: str, refs: tuple[str, str] | None = None) -> None:
            some = x or y
            r1, r2 = refs or (x["ref"] if x else ".", y["ref"] if y else ".")
            out.append((some["chrom"], x["pos"] if x else None, y["pos"] if y else None, kind, r1, r2, (x["alt"] or ".") if x else ".", (y["alt"] or ".") if y else "."))

        while i < len(sides[0]) or j < len(sides[1]):
            x = sides[0][i] if i < len(sides[0]) else None
            y = sides[1][j] if j < len(sides[1]) else None
            if x and y and x["pos"] == y["pos"]:
                r1, r2 = x["ref"], y["ref"]
                r1 = r2 if r1 in UNKNOWN else r1
                r2 = r1 if r2 in UNKNOWN else r2
                row(x, y, "O" if r1 != r2 and r1 not in UNKNOWN and r2 not in UNKNOWN else "B", (r1, r2))
                i, j = i + 1, j + 1
            elif x and y and min(x, y, key=lambda r: r["pos"])["pos"] + len(min(x, y, key=lambda r: r["pos"])["ref"]) > max(x["pos"], y["pos"]):
                row(x, y, "O")
                i, j = i + 1, j + 1
            elif y is None or (x and x["pos"] < y["pos"]):
                row(x, None, "1")
                i += 1
            else:
                row(None, y, "2")
                j += 1
        return pd.DataFrame(out, columns=["chrom", "pos1", "pos2", "in_file", "ref1", "ref2", "alt1", "alt2"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (batch["chrom"] == batch["chrom"].iloc[-1]) & (batch["run"] == batch["run"].iloc[-1])
            held = batch[last]
            for _, group in batch[~last].groupby(["chrom", "run"], sort=False):
                yield walk(group)
        if held is not None and len(held):
            yield walk(held)

    dealt = df.select(*cols, "run").repartition("chrom", "run").sortWithinPartitions("chrom", "run", "pos", "side", "ordinal")
    return dealt.mapInPandas(runs, "chrom string, pos1 int, pos2 int, in_file string, ref1 string, ref2 string, alt1 string, alt2 string")
