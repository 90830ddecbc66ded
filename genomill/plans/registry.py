"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.engine import CallSet, compare
from genomill.operators import fst, individual_stats, ld, pca, site_stats, windows
from genomill.operators.recode import recode
from genomill.operators.selectors import population_indices
from genomill.operators.windows import tajima_constants
from genomill.plans.sql import MAF, query, two_sets
from genomill.session import importable
from genomill.spec import QuerySpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
COUNTS_SQL = "SELECT chrom, pos, n_alleles, CAST(n_chr AS INTEGER) AS n_chr, c0, c1, c2 FROM "


def calls(spark: SparkSession, sf_dir: str, copy: int = 1) -> CallSet:
    return CallSet.from_tables(importable(spark), sf_dir, copy)


def register(name: str, sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Doubles for comparison between engines: rounded, NaN to null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.round(c, digits)) for c in columns})


def count_rows(sites: DataFrame) -> DataFrame:
    get = lambda i: F.coalesce(F.get("ac", F.lit(i)), F.lit(0).cast("long")).alias(f"c{i}")
    return sites.select("chrom", "pos", "n_alleles", "n_chr", get(0), get(1), get(2))


def filter_query(name: str, where: str, mask: str = "FALSE", samples: str = "TRUE", more: str = "", table: str = "kept", sides: Callable | None = None, **options) -> None:
    """Counts of the sites that a filter keeps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {k: f(spark) for k, f in (sides() if sides else {}).items()}
        return count_rows(calls(spark, sf_dir).kept(QuerySpec(**options), **own).sites)

    register(name, query(COUNTS_SQL + table, where=where, mask=mask, samples=samples, more=more))(run)


def _flag(names: str) -> frozenset[str]:
    return frozenset(names.split())


filter_query("flt_chr", "chrom IN ('chr1', 'chr3')", chroms=_flag("chr1 chr3"))
filter_query("flt_not_chr", "chrom NOT IN ('chr2')", not_chroms=_flag("chr2"))
filter_query("flt_range", "chrom = 'chr2' AND pos BETWEEN 500 AND 20000", chroms=_flag("chr2"), from_bp=500, to_bp=20000)
filter_query("flt_keep_filtered", "fl IN (0, 3)", keep_filtered=_flag("PASS s50"))
filter_query("flt_remove_filtered", "fl IN (0, 1)", remove_filtered=_flag("q10"))
filter_query("flt_remove_filtered_all", "fl IN (0, 1)", remove_filtered_all=True)
filter_query("flt_info", "db AND NOT h2", keep_info=_flag("DB"), remove_info=_flag("H2"))
filter_query("flt_alleles", "n_alleles BETWEEN 3 AND 3", min_alleles=3, max_alleles=3)
filter_query("flt_indel", "length(ref) = 1", remove_indels=True)
filter_query("flt_only_indel", "length(ref) > 1", keep_only_indels=True)
filter_query("flt_minq", "qual >= 30", min_q=30.0)
filter_query("flt_meandp", "raw_dp / n_sel::DOUBLE BETWEEN 15 AND 22", min_mean_dp=15.0, max_mean_dp=22.0)
filter_query("flt_maxmissing", "n_chr / slots::DOUBLE >= 0.65", max_missing=0.65)
filter_query("flt_maxmissing_count", "slots - n_chr <= 12", max_missing_count=12)
filter_query("flt_maf", f"(n_chr = 0 OR {MAF} >= 0.1) AND n_chr > 0 AND {MAF} <= 0.45", maf=0.1, max_maf=0.45)
filter_query("flt_mac", "least_ac BETWEEN 2 AND 9", mac=2, max_mac=9)
filter_query("flt_nonref_af", "n_chr = 0 OR (f1 BETWEEN 0.1 AND 0.9 AND (n_alleles = 2 OR f2 BETWEEN 0.1 AND 0.9))", non_ref_af=0.1, max_non_ref_af=0.9)
filter_query("flt_nonref_af_any", "n_chr = 0 OR (f1 >= 0 AND (f1 >= 0.4 OR (n_alleles = 3 AND f2 >= 0.4)))", non_ref_af=0.0, non_ref_af_any=0.4)
filter_query("flt_nonref_ac", "c1 BETWEEN 3 AND 20 AND (n_alleles = 2 OR c2 BETWEEN 3 AND 20)", non_ref_ac=3, max_non_ref_ac=20)
filter_query("flt_nonref_ac_any", "c1 >= 8 OR (n_alleles = 3 AND c2 >= 8)", non_ref_ac_any=8)
filter_query("mask_gq", "TRUE", mask="gq < 20", min_gq=20.0)
filter_query("mask_dp", "TRUE", mask="dp < 10 OR dp > 40", min_dp=10, max_dp=40)
filter_query("mask_ft", "TRUE", mask="ft = 'LowDP'", remove_filtered_geno=_flag("LowDP"))
filter_query("mask_ft_all", "TRUE", mask="ft NOT IN ('PASS', '.')", remove_filtered_geno_all=True)
filter_query("keep_samples", "TRUE", samples="s IN (1, 3, 5, 7)", keep_samples=_flag("S01 S03 S05 S07"))
filter_query("remove_samples", "TRUE", samples="s NOT IN (0, 2)", remove_samples=_flag("S00 S02"))

SEVEN = {"min_alleles": 2, "max_alleles": 2, "min_gq": 10.0, "min_q": 30.0, "min_mean_dp": 7.0, "max_missing": 0.5, "maf": 0.1}
SEVEN_SQL = f"n_alleles = 2 AND qual >= 30 AND raw_dp / n_sel::DOUBLE >= 7 AND n_chr / slots::DOUBLE >= 0.5 AND (n_chr = 0 OR {MAF} >= 0.1)"
filter_query("seven_filter_counts", SEVEN_SQL, mask="gq < 10", **SEVEN)
filter_query(
    "ten_filter_counts", SEVEN_SQL + " AND length(ref) = 1 AND chrom <> 'chr5' AND fl IN (0, 1)", mask="gq < 10", remove_indels=True, not_chroms=_flag("chr5"), remove_filtered_all=True, **SEVEN
)

HWE_SQL = """
probs AS (
  SELECT site_id, n_het, h, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2.0 + 1) - lgamma(n_complete - (rare + h) / 2.0 + 1) AS lp
  FROM (SELECT site_id, n_het, n_complete, n_het + 2 * least(n_hom_ref, n_complete - n_het - n_hom_ref) AS rare,
      unnest(range((n_het + 2 * least(n_hom_ref, n_complete - n_het - n_hom_ref)) % 2, n_het + 2 * least(n_hom_ref, n_complete - n_het - n_hom_ref) + 1, 2)) AS h
    FROM {table})),
exact AS (
  SELECT site_id, least(sum(p) FILTER (p <= po * (1 + 1e-9)), 1) AS p, least(sum(p) FILTER (h <= n_het), 1) AS pd, least(sum(p) FILTER (h >= n_het), 1) AS pe
  FROM (SELECT site_id, h, n_het, exp(lp - mx) / tot AS p, exp(lo - mx) / tot AS po FROM (
      SELECT *, sum(exp(lp - mx)) OVER (PARTITION BY site_id) AS tot FROM (
        SELECT *, max(lp) OVER (PARTITION BY site_id) AS mx, max(CASE WHEN h = n_het THEN lp END) OVER (PARTITION BY site_id) AS lo FROM probs)))
  GROUP BY site_id)
"""
filter_query("flt_hwe", "n_alleles <= 2", more=HWE_SQL.format(table="kept"), table="kept JOIN exact USING (site_id) WHERE p >= 0.05", hwe=0.05)
THIN_SQL = """
walk AS (
  WITH RECURSIVE w(chrom, pos) AS (
    SELECT chrom, min(pos) FROM kept GROUP BY chrom
    UNION ALL SELECT w.chrom, (SELECT min(k.pos) FROM kept k WHERE k.chrom = w.chrom AND k.pos >= w.pos + 700) FROM w WHERE w.pos IS NOT NULL)
  SELECT chrom, pos FROM w WHERE pos IS NOT NULL)
"""
filter_query("flt_thin", "TRUE", more=THIN_SQL, table="kept JOIN walk USING (chrom, pos)", thin=700)


def _positions(spark: SparkSession) -> DataFrame:
    return spark.range(0, 100_000).select(F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom"), F.expr("cast((id - id % 5) div 5 * 3 as int)").alias("pos"))


POSITIONS_SQL = "posn AS (SELECT concat('chr', CAST(id % 5 + 1 AS VARCHAR)) AS chrom, CAST((id - id % 5) // 5 * 3 AS INTEGER) AS pos FROM (SELECT unnest(range(0, 100000)) AS id))"
filter_query("flt_positions", "TRUE", more=POSITIONS_SQL, table="kept SEMI JOIN posn USING (chrom, pos)", sides=lambda: {"positions": _positions})
filter_query("flt_excl_positions", "TRUE", more=POSITIONS_SQL, table="kept ANTI JOIN posn USING (chrom, pos)", sides=lambda: {"exclude_positions": _positions})


def _bed(spark: SparkSession) -> DataFrame:
    return spark.range(0, 40).select(F.concat(F.lit("chr"), (F.col("id") % 4 + 1).cast("string")).alias("chrom"), (F.col("id") * 990).cast("int").alias("start"), (F.col("id") * 990 + 300 + F.col("id") * 10).cast("int").alias("end"))


BED_SQL = 'bed AS (SELECT concat(\'chr\', CAST(id % 4 + 1 AS VARCHAR)) AS chrom, id * 990 AS lo, id * 990 + 300 + id * 10 AS hi FROM (SELECT unnest(range(0, 40)) AS id))'
BED_HIT = "EXISTS (SELECT 1 FROM bed b WHERE b.chrom = kept.chrom AND b.lo < kept.pos + length(kept.ref) - 1 AND b.hi >= kept.pos)"
filter_query("flt_bed", "TRUE", more=BED_SQL, table=f"kept WHERE {BED_HIT}", sides=lambda: {"bed": _bed})
filter_query("flt_excl_bed", "TRUE", more=BED_SQL, table=f"kept WHERE NOT {BED_HIT}", sides=lambda: {"exclude_bed": _bed})


def output(name: str, select: str, make: Callable[[CallSet], DataFrame], *, where: str = "TRUE", more: str = "", mask: str = "gq < 10", **options) -> None:
    """An output over all sites with calls of low quality masked."""
    spec = QuerySpec(min_gq=10.0, **options)
    register(name, query(select, where=where, mask=mask, more=more))(lambda spark, sf_dir: make(calls(spark, sf_dir).kept(spec)))


FREQS = "SELECT chrom, pos, n_alleles, CAST(n_chr AS INTEGER) AS n_chr, round(f0, 6) AS f0, round(f1, 6) AS f1, round(CASE WHEN n_alleles = 3 THEN f2 END, 6) AS f2 FROM kept"


def _freqs(df: DataFrame) -> DataFrame:
    df = df.select("chrom", "pos", "n_alleles", "n_chr", *(F.get("freq", F.lit(i)).alias(f"f{i}") for i in range(3)))
    return rounded(df, "f0", "f1", "f2")


LABELLED = FREQS.replace("SELECT chrom", "SELECT concat(ref, CASE WHEN n_alleles = 3 THEN ',C,G' ELSE ',C' END) AS alleles, chrom")
output(
    "freq",
    LABELLED,
    lambda c: rounded(site_stats.freq(c.sites).select(F.array_join("alleles", ",").alias("alleles"), "chrom", "pos", "n_alleles", "n_chr", *(F.get("freq", F.lit(i)).alias(f"f{i}") for i in range(3))), "f0", "f1", "f2"),
)
output("freq2", FREQS, lambda c: _freqs(site_stats.freq(c.sites)))
output("counts", COUNTS_SQL + "kept", lambda c: count_rows(c.sites))
output(
    "missing_site",
    "SELECT chrom, pos, live_slots - half_phased AS n_data, n_masked AS n_filtered, live_slots - n_chr - half_phased AS n_miss, "
    "CASE WHEN live_slots - half_phased > 0 THEN round((live_slots - n_chr - half_phased) / (live_slots - half_phased)::DOUBLE, 6) END AS f_miss FROM kept",
    lambda c: rounded(site_stats.missing_site(c.sites).drop("ordinal"), "f_miss"),
)
output("site_depth", "SELECT chrom, pos, dp_sum AS sum_depth, dp_sq AS sumsq_depth FROM kept", lambda c: site_stats.site_depth(c.sites).drop("ordinal"))
output(
    "site_mean_depth",
    "SELECT chrom, pos, CASE WHEN dp_n > 0 THEN round(dp_sum / dp_n::DOUBLE, 6) END AS mean_depth, CASE WHEN dp_n > 1 THEN "
    "round((dp_sq / dp_n::DOUBLE - (dp_sum / dp_n::DOUBLE) * (dp_sum / dp_n::DOUBLE)) * dp_n / (dp_n - 1), 6) END AS var_depth FROM kept",
    lambda c: rounded(site_stats.site_mean_depth(c.sites).drop("ordinal"), "mean_depth", "var_depth"),
)
output("site_depth_corrected", "SELECT chrom, pos, dp_sum AS sum_depth, dp_sq AS sumsq_depth FROM kept", lambda c: site_stats.site_depth(c.sites, True).drop("ordinal"))
DEEPER, WRAP_SQL = 40_000, "SELECT chrom, pos, dp_sum * 40000 % 4294967296 AS sum_depth, dp_sq * 1600000000 % 4294967296 AS sumsq_depth FROM kept"


def _deeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths so great that the sums pass 32 bits."""
    own = calls(spark, sf_dir)
    sites = own.sites.withColumn("calls", F.transform("calls", lambda x: x.withField("dp", F.when(x["dp"] >= 0, x["dp"] * DEEPER).otherwise(x["dp"]))))
    return site_stats.site_depth(CallSet(sites, own.samples).kept(QuerySpec(min_gq=10.0)).sites).drop("ordinal")


register("site_depth_wrapped", query(WRAP_SQL, mask="gq < 10"))(_deeper)
output("site_quality", "SELECT chrom, pos, qual FROM kept", lambda c: site_stats.site_quality(c.sites).drop("ordinal"))
output("site_pi", "SELECT chrom, pos, CASE WHEN n_chr > 1 THEN round(mism / (n_chr * (n_chr - 1))::DOUBLE, 6) END AS pi FROM kept WHERE fully_diploid", lambda c: rounded(site_stats.site_pi(c.sites).drop("ordinal"), "pi"))

E_SQL = ["n_complete * f0 * f0", "2 * f0 * (1 - f0) * n_complete", "(1 - f0) * (1 - f0) * n_complete"]
output(
    "hardy_chisq",
    "SELECT chrom, pos, CAST(n_hom_ref AS INTEGER) AS obs_hom1, CAST(n_het AS INTEGER) AS obs_het, CAST(n_complete - n_het - n_hom_ref AS INTEGER) AS obs_hom2, "
    + ", ".join(f"round({x}, 6) AS e_{n}" for x, n in zip(E_SQL, ("hom1", "het", "hom2"), strict=True))
    + ", round("
    + " + ".join(f"({o} - {x}) * ({o} - {x}) / ({x})" for o, x in zip(("n_hom_ref", "n_het", "(n_complete - n_het - n_hom_ref)"), E_SQL, strict=True))
    + ", 6) AS chisq, round(p, 6) AS p_hwe, round(pd, 6) AS p_het_deficit, round(pe, 6) AS p_het_excess FROM kept JOIN exact USING (site_id) WHERE n_chr > 0 AND n_complete > 0 AND f0 > 0 AND f0 < 1",
    lambda c: rounded(site_stats.hardy(c.sites.where("n_chr > 0 and n_complete > 0 and ac[0] > 0 and ac[0] < n_chr")).drop("ordinal"), "e_hom1", "e_het", "e_hom2", "chisq", "p_hwe", "p_het_deficit", "p_het_excess"),
    where="n_alleles = 2 AND fully_diploid",
    more=HWE_SQL.format(table="(SELECT * FROM kept WHERE n_complete > 0)"),
)

SAMPLE = "concat('S', lpad(CAST(s AS VARCHAR), 2, '0')) AS indv"
output(
    "indv_depth",
    f"SELECT {SAMPLE}, CAST(count(*) FILTER (NOT masked AND dp >= 0) AS BIGINT) AS n_sites, round(sum(CAST(dp AS BIGINT)) FILTER (NOT masked AND dp >= 0) / CAST(count(*) FILTER (NOT masked AND dp >= 0) AS DOUBLE), 6) AS mean_depth FROM v GROUP BY s",
    lambda c: rounded(individual_stats.depth(c.sites, c.samples).drop("sample_idx"), "mean_depth"),
)
output(
    "indv_missing",
    f"SELECT {SAMPLE}, CAST(count(*) FILTER (NOT masked) AS BIGINT) AS n_data, CAST(count(*) FILTER (masked) AS BIGINT) AS n_filtered, CAST(count(*) FILTER (NOT masked AND a1 IS NULL) AS BIGINT) AS n_miss, "
    "round(count(*) FILTER (NOT masked AND a1 IS NULL) / CAST(count(*) FILTER (NOT masked) AS DOUBLE), 6) AS f_miss FROM v GROUP BY s",
    lambda c: rounded(individual_stats.missing(c.sites, c.samples).drop("sample_idx"), "f_miss"),
)
output(
    "het",
    f"SELECT {SAMPLE}, CAST(count(*) FILTER (a1 = a2) AS BIGINT) AS o_hom, round(sum(e), 4) AS e_hom, CAST(count(*) AS BIGINT) AS n_sites, round((count(*) FILTER (a1 = a2) - sum(e)) / (count(*) - sum(e)), 4) AS f "
    "FROM (SELECT v.*, 1 - 2 * k.f1 * (1 - k.f1) * k.n_chr / (k.n_chr - 1) AS e FROM v JOIN kept k USING (site_id) WHERE full_call AND k.f1 > 0 AND k.f1 < 1) GROUP BY s",
    lambda c: rounded(individual_stats.het(c.sites, c.samples).drop("sample_idx"), "e_hom", "f", digits=4),
    where="n_alleles = 2 AND fully_diploid",
)

N_SMP = "(SELECT count(*) FROM smp)"


def _pi_sql(size: int, step: int) -> str:
    return (
        "SELECT chrom, CAST(bin * {s} + 1 AS BIGINT) AS bin_start, CAST(bin * {s} + {n} AS BIGINT) AS bin_end, CAST(count(*) FILTER (c0 < n_chr) AS BIGINT) AS n_variants, CAST({n} - count(*) AS BIGINT) AS n_monomorphic, "
        "round(CAST(sum(mism) AS DOUBLE) / CAST(sum(n_chr * (n_chr - 1)) + ({n} - count(*)) * 2 * {k} * (2 * {k} - 1) AS DOUBLE), 9) AS pi FROM "
        "(SELECT *, unnest(range(CASE WHEN pos <= {n} THEN 0 ELSE (pos - {n} + {s} - 1) // {s} END, (pos + {s} - 1) // {s})) AS bin FROM kept WHERE fully_diploid AND mism > 0) GROUP BY chrom, bin"
    ).format(n=size, s=step, k=N_SMP)


output("window_pi", _pi_sql(1000, 1000), lambda c: rounded(windows.window_pi(c.sites, 1000, None, len(c.samples)), "pi", digits=9))
output("window_pi_step", _pi_sql(1000, 250), lambda c: rounded(windows.window_pi(c.sites, 1000, 250, len(c.samples)), "pi", digits=9))


def _tajima_sql(n: int) -> str:
    a1, e1, e2 = tajima_constants(n)
    return f"WHEN {n} THEN CASE WHEN s > 0 THEN round((2 * pq * {n} / {n - 1} - s / {a1!r}) / sqrt({e1!r} * s + {e2!r} * s * (s - 1)), 6) END"


output(
    "tajima_d",
    f"SELECT chrom, bin_start, n_snps, CASE 2 * (SELECT count(*) FROM smp) {_tajima_sql(20)} {_tajima_sql(40)} END AS tajima_d FROM (SELECT g.chrom, g.bin_start, coalesce(b.s, 0) AS s, CAST(coalesce(b.s, 0) AS BIGINT) AS n_snps, coalesce(b.pq, 0) AS pq FROM grid g LEFT JOIN bins b USING (chrom, bin_start))",
    lambda c: rounded(windows.tajima_d(c.sites, 150, len(c.samples)), "tajima_d"),
    where="n_alleles = 2 AND fully_diploid",
    more="""bins AS (SELECT chrom, CAST(pos - pos % 150 AS BIGINT) AS bin_start, count(*) FILTER (f0 > 0 AND f0 < 1) AS s, sum(f0 * (1 - f0)) FILTER (f0 > 0 AND f0 < 1) AS pq FROM kept GROUP BY ALL),
grid AS (SELECT chrom, CAST(unnest(range(lo, hi + 1, 150)) AS BIGINT) AS bin_start FROM (SELECT chrom, min(bin_start) FILTER (s > 0) AS lo, max(bin_start) AS hi FROM bins GROUP BY chrom) WHERE lo IS NOT NULL)""",
)

FST_SQL = """
pop AS (
  SELECT site_id, s % 2 AS pop, k, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN a1 = k THEN 1 ELSE 0 END + CASE WHEN a2 = k THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*)) AS p,
    CAST(count(*) FILTER (a1 <> a2 AND (a1 = k OR a2 = k)) AS DOUBLE) / count(*) AS h
  FROM v JOIN kept USING (site_id), (SELECT unnest(range(0, 3)) AS k) WHERE full_call AND k < kept.n_alleles GROUP BY site_id, s % 2, k),
wide AS (
  SELECT site_id, k, sum(n) AS tot, sum(n) / 2 AS nb, sum(n) - sum(n * n) / sum(n) AS nc, sum(n * p) / sum(n) AS pb, sum(n * h) / sum(n) AS hb FROM pop GROUP BY site_id, k HAVING count(*) = 2 AND sum(n) > 2),
var AS (SELECT w.*, (SELECT sum(q.n * (q.p - w.pb) * (q.p - w.pb)) FROM pop q WHERE q.site_id = w.site_id AND q.k = w.k) / w.nb AS s2 FROM wide w),
abc AS (
  SELECT site_id, sum(nb / nc * (s2 - (pb * (1 - pb) - s2 / 2 - hb / 4) / (nb - 1))) AS num,
    sum(nb / nc * (s2 - (pb * (1 - pb) - s2 / 2 - hb / 4) / (nb - 1)) + nb / (nb - 1) * (pb * (1 - pb) - s2 / 2 - (2 * nb - 1) / (4 * nb) * hb) + hb / 2) AS den FROM var GROUP BY site_id),
fst AS (SELECT kept.chrom, kept.pos, num, den, CASE WHEN abs(den) > 1e-12 THEN num / den END AS fst FROM kept LEFT JOIN abc USING (site_id))
"""
TWO = (tuple(f"S{i:02d}" for i in range(0, 20, 2)), tuple(f"S{i:02d}" for i in range(1, 20, 2)))


def _fst(c: CallSet) -> DataFrame:
    out = fst.site_fst(c.sites, population_indices(c.samples, TWO))
    return out.withColumn("fst", F.when(F.abs("den") > 1e-12, F.col("fst")))


output("weir_fst", "SELECT chrom, pos, round(fst, 5) AS fst FROM fst", lambda c: rounded(_fst(c).select("chrom", "pos", "fst"), "fst", digits=5), where="fully_diploid", more=FST_SQL)
output(
    "window_fst",
    "SELECT chrom, CAST(bin * 500 + 1 AS BIGINT) AS bin_start, CAST(bin * 500 + 1000 AS BIGINT) AS bin_end, CAST(count(*) AS BIGINT) AS n_variants, round(sum(num) / sum(den), 5) AS weighted_fst, round(avg(fst), 5) AS mean_fst FROM "
    "(SELECT *, unnest(range(CASE WHEN pos <= 1000 THEN 0 ELSE (pos - 1000 + 499) // 500 END, (pos + 499) // 500)) AS bin FROM fst WHERE fst IS NOT NULL) GROUP BY chrom, bin",
    lambda c: rounded(fst.window_fst(c.sites, population_indices(c.samples, TWO), 1000, 500), "weighted_fst", "mean_fst", digits=5),
    where="fully_diploid",
    more=FST_SQL,
)

LD_SQL = """
snp AS (SELECT site_id, chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) AS i FROM kept),
dose AS (SELECT site_id, s, CASE WHEN a1 = 0 THEN 1 ELSE 0 END + CASE WHEN a2 = 0 THEN 1 ELSE 0 END AS g FROM v WHERE full_call),
pairs AS (SELECT a.chrom, a.pos AS pos1, b.pos AS pos2, a.site_id AS ia, b.site_id AS ib FROM snp a JOIN snp b ON a.chrom = b.chrom AND {cond}),
sums AS (SELECT p.chrom, pos1, pos2, count(x.g) AS n, coalesce(sum(x.g), 0) AS sx, coalesce(sum(y.g), 0) AS sy, coalesce(sum(x.g * x.g), 0) AS sxx, coalesce(sum(y.g * y.g), 0) AS syy, coalesce(sum(x.g * y.g), 0) AS sxy
  FROM pairs p LEFT JOIN (dose x JOIN dose y ON x.s = y.s) ON x.site_id = p.ia AND y.site_id = p.ib GROUP BY p.chrom, pos1, pos2, p.ia, p.ib),
r2 AS (SELECT chrom, pos1, pos2, CAST(n AS BIGINT) AS n_indv, CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN
  round(CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE), 6) END AS r2 FROM sums)
"""
output("geno_r2", "SELECT * FROM r2", lambda c: rounded(ld.geno_r2(c.sites, window=3), "r2"), where="n_alleles = 2", more=LD_SQL.format(cond="b.i - a.i BETWEEN 1 AND 3"))
output(
    "geno_r2_windowed", "SELECT * FROM r2 WHERE r2 >= 0.2", lambda c: rounded(ld.geno_r2(c.sites, bp=400, bp_min=50, min_r2=0.2), "r2"), where="n_alleles = 2", more=LD_SQL.format(cond="b.i > a.i AND b.pos - a.pos BETWEEN 50 AND 400")
)
LD_ALL = {"chroms": frozenset(["chr2"]), "to_bp": 12_000}
output("geno_r2_all", "SELECT * FROM r2", lambda c: rounded(ld.geno_r2(c.sites), "r2"), where="n_alleles = 2 AND chrom = 'chr2' AND pos <= 12000", more=LD_SQL.format(cond="b.i > a.i"), **LD_ALL)
output("geno_r2_min", "SELECT * FROM r2", lambda c: rounded(ld.geno_r2(c.sites, window=5, window_min=3), "r2"), where="n_alleles = 2", more=LD_SQL.format(cond="b.i - a.i BETWEEN 3 AND 5"))


def _filled(c: CallSet) -> CallSet:
    """Missing alleles as the reference: PCA takes complete genotypes only."""
    whole = F.transform("calls", lambda x: x.withField("a1", F.coalesce(x["a1"], F.lit(0))).withField("a2", F.coalesce(x["a2"], F.lit(0))).withField("ploidy", F.lit(2)))
    return CallSet(c.sites.withColumn("calls", whole), c.samples)


def _gram(normalize: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _filled(calls(spark, sf_dir)).kept(QuerySpec())
        return rounded(pca.gram(own.sites, len(own.samples), normalize), "value").select("i", "j", "value")

    return run


for _name, _scale in (("pca_gram", " / sqrt(p * (1 - p))"), ("pca_gram_no_norm", "")):
    register(
        _name,
        query(
            "SELECT CAST(a.r AS BIGINT) AS i, CAST(b.r AS BIGINT) AS j, round(sum(a.x * b.x) / any_value(a.m), 6) AS value FROM std a JOIN std b USING (site_id) GROUP BY a.r, b.r",
            where="n_alleles = 2",
            more=f"""full0 AS (SELECT site_id, s, dense_rank() OVER (ORDER BY s) - 1 AS r, CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END AS g FROM v JOIN (SELECT site_id AS site_id FROM kept) USING (site_id)),
freqs AS (SELECT site_id, avg(g) / 2 AS p FROM full0 GROUP BY site_id),
std AS (SELECT site_id, r, (g - 2 * p){_scale} AS x, (SELECT count(*) FROM freqs WHERE p > 0 AND p < 1) AS m FROM full0 JOIN freqs USING (site_id) WHERE p > 0 AND p < 1)""",
        ),
    )(_gram(not _name.endswith("no_norm")))


@register("pca", None)
def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _filled(calls(spark, sf_dir)).kept(QuerySpec())
    return pca.pca(own.sites, own.samples)


def _written(own: CallSet) -> CallSet:
    """The call set with the fields that only text has: raw calls, quality and INFO as they would be read."""
    sep = lambda x: F.when(x["phased"], "|").otherwise("/")
    shown = lambda a: F.coalesce(a.cast("string"), F.lit("."))
    raw = lambda x: F.concat(shown(x["a1"]), F.when(x["ploidy"] == 2, F.concat(sep(x), shown(x["a2"]))).otherwise(""), F.lit(":"), shown(F.when(x["dp"] >= 0, x["dp"])), F.lit(":"), shown(F.when(x["gq"] >= 0, x["gq"])), F.lit(":"), x["ft"])
    sites = own.sites.withColumn("calls", F.transform("calls", lambda x: x.withField("raw", raw(x)))).withColumn("qual_raw", F.when(F.col("qual") >= 0, F.col("qual").cast("int").cast("string")).otherwise("."))
    return CallSet(sites.withColumn("info", F.when(F.size("info_keys") == 0, ".").otherwise(F.array_join("info_keys", ";"))), own.samples)


def _recoded(info_all: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _written(calls(spark, sf_dir)).kept(QuerySpec(min_gq=10.0, min_q=30.0)).sites
        return recode(kept, info_all).select(F.col("ordinal").alias("site_id"), "line")

    return run


for _name, _info in (("recode_rows", "'.'"), ("recode_info_all", "CASE WHEN db AND h2 THEN 'DB;H2' WHEN db THEN 'DB' WHEN h2 THEN 'H2' ELSE '.' END")):
    register(
        _name,
        query(
            "SELECT kept.site_id, concat_ws(chr(9), kept.chrom, CAST(kept.pos AS VARCHAR), '.', kept.ref, CASE WHEN kept.n_alleles = 3 THEN 'C,G' ELSE 'C' END, CASE WHEN kept.qual >= 0 THEN CAST(CAST(kept.qual AS INTEGER) AS VARCHAR) ELSE '.' END, "
            f"CASE kept.fl WHEN 0 THEN 'PASS' WHEN 1 THEN '.' WHEN 2 THEN 'q10' ELSE 'q10;s50' END, {_info}, 'GT:DP:GQ:FT', cells) AS line FROM kept JOIN shown USING (site_id)",
            where="qual >= 30",
            mask="gq < 10",
            more="""shown AS (SELECT site_id, string_agg(concat(CASE WHEN masked THEN './.' ELSE concat(coalesce(CAST(a1 AS VARCHAR), '.'), CASE WHEN ploidy = 2 THEN concat(CASE WHEN phased THEN '|' ELSE '/' END, coalesce(CAST(a2 AS VARCHAR), '.')) ELSE '' END) END,
  ':', CASE WHEN dp >= 0 THEN CAST(dp AS VARCHAR) ELSE '.' END, ':', CASE WHEN gq >= 0 THEN CAST(gq AS VARCHAR) ELSE '.' END, ':', ft), chr(9) ORDER BY s) AS cells FROM v GROUP BY site_id)""",
        ),
    )(_recoded(_name == "recode_info_all"))

DIFF_SQL = """
gt AS (
  SELECT a.site_id, a.s, a.chrom, a.pos, (a.ploidy = 2 AND (a.a1 IS NOT NULL OR a.a2 IS NOT NULL) AND b.ploidy = 2 AND (b.a1 IS NOT NULL OR b.a2 IS NOT NULL)) AS called,
    least(coalesce(a.a1, -1), coalesce(a.a2, -1)) <> least(coalesce(b.a1, -1), coalesce(b.a2, -1)) OR greatest(coalesce(a.a1, -1), coalesce(a.a2, -1)) <> greatest(coalesce(b.a1, -1), coalesce(b.a2, -1)) AS differ
  FROM call1 a JOIN call2 b ON a.site_id = b.site_id AND a.s = b.s)
"""


def comparison(name: str, output: str, sql: str, finish: Callable[[DataFrame], DataFrame] = lambda d: d, more: str = "", sides: Callable | None = None, other: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """A comparison of the call set with its second copy, whose sites other may change."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = calls(spark, sf_dir), calls(spark, sf_dir, 2)
        own = {k: f(spark) for k, f in (sides() if sides else {}).items()}
        return finish(compare(a, CallSet(other(b.sites), b.samples), QuerySpec(outputs=(output,)), **own)[output])

    register(name, two_sets(sql, DIFF_SQL.rstrip() + (f",\n{more}\n" if more else "\n")))(run)


SITE_DISC = (
    "SELECT a.chrom, a.pos, CASE WHEN b.site_id IS NULL THEN '1' ELSE 'B' END AS files, CASE WHEN b.site_id IS NULL THEN 0 ELSE 1 END AS matching_alleles, CAST(coalesce(g.n, 0) AS BIGINT) AS n_common_called, CAST(coalesce(g.d, 0) AS BIGINT) AS n_discord, "
    "CASE WHEN coalesce(g.n, 0) > 0 THEN round(g.d / CAST(g.n AS DOUBLE), 6) END AS discordance FROM site1 a LEFT JOIN site2 b USING (site_id) LEFT JOIN (SELECT site_id, count(*) FILTER (called) AS n, count(*) FILTER (called AND differ) AS d FROM gt GROUP BY site_id) g USING (site_id)"
)
INDV_DISC = f"SELECT {SAMPLE}, CAST(count(*) FILTER (called) AS BIGINT) AS n_common_called, CAST(count(*) FILTER (called AND differ) AS BIGINT) AS n_discord, round(count(*) FILTER (called AND differ) / CAST(count(*) FILTER (called) AS DOUBLE), 6) AS discordance FROM gt"
PRESENCE = (
    "SELECT a.chrom, a.pos AS pos1, b.pos AS pos2, CASE WHEN b.site_id IS NULL THEN '1' {clash}ELSE 'B' END AS in_file, a.ref AS ref1, coalesce({ref2}, '.') AS ref2, CASE WHEN a.n_alleles = 3 THEN 'C,G' ELSE 'C' END AS alt1, "
    "CASE WHEN b.site_id IS NULL THEN '.' WHEN b.n_alleles = 3 THEN 'C,G' ELSE 'C' END AS alt2 FROM site1 a LEFT JOIN site2 b USING (site_id)"
)
DISCORDANCE = lambda d: rounded(d, "discordance")
comparison("diff_site_disc", "diff_site_discordance", SITE_DISC, DISCORDANCE)
comparison("diff_indv_disc", "diff_indv_discordance", INDV_DISC + " GROUP BY s", DISCORDANCE)
comparison("diff_indv", "diff_indv", f"SELECT {SAMPLE}, 'B' AS files FROM smp")
comparison("diff_site", "diff_site", PRESENCE.format(clash="", ref2="b.ref"))
# Both copies have the same sites but for those that the second lacks, so a filter of the first is one of both.
A_POSITION, A_BED = "(a.chrom, a.pos) IN (SELECT chrom, pos FROM posn)", BED_HIT.replace("kept.", "a.")
comparison("diff_site_positions", "diff_site", PRESENCE.format(clash="", ref2="b.ref") + f" WHERE {A_POSITION}", more=POSITIONS_SQL, sides=lambda: {"positions": _positions})
comparison("diff_site_excl_bed", "diff_site", PRESENCE.format(clash="", ref2="b.ref") + f" WHERE NOT {A_BED}", more=BED_SQL, sides=lambda: {"exclude_bed": _bed})
comparison("diff_site_disc_bed", "diff_site_discordance", SITE_DISC + f" WHERE {A_BED}", DISCORDANCE, more=BED_SQL, sides=lambda: {"bed": _bed})
comparison(
    "diff_indv_disc_excl_positions", "diff_indv_discordance", INDV_DISC + " WHERE (chrom, pos) NOT IN (SELECT chrom, pos FROM posn) GROUP BY s", DISCORDANCE, more=POSITIONS_SQL, sides=lambda: {"exclude_positions": _positions}
)


def _other_references(sites: DataFrame) -> DataFrame:
    """Every fourth site with another reference."""
    return sites.withColumn("alleles", F.when(F.col("ordinal") % 4 == 1, F.concat(F.array(F.lit("T")), F.slice("alleles", 2, 1 << 20))).otherwise(F.col("alleles")))


comparison("diff_site_overlaps", "diff_site", PRESENCE.format(clash="WHEN b.site_id % 4 = 1 THEN 'O' ", ref2="CASE WHEN b.site_id % 4 = 1 THEN 'T' ELSE b.ref END"), other=_other_references)
