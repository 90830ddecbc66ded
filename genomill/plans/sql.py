"""SQL for the driver tables: the same cells and aggregates as sources.tables and functions.calls."""

from __future__ import annotations

SITE = """
site{c} AS (
  SELECT CAST(p_partkey AS BIGINT) AS site_id, concat('chr', CAST(p_partkey % 5 + 1 AS VARCHAR)) AS chrom,
    CAST((p_partkey - p_partkey % 5) * 20 + p_size AS INTEGER) AS pos, CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 2 END AS n_alleles,
    CASE WHEN p_partkey % 13 = 0 THEN 'AT' ELSE 'A' END AS ref,
    CASE WHEN p_partkey % 17 = 0 THEN -1.0 ELSE CAST(p_partkey * 7 % 100 AS DOUBLE) END AS qual,
    CAST(p_partkey % 4 AS INTEGER) AS fl, p_size % 3 = 0 AS db, p_size % 5 = 0 AS h2
  FROM part{where}),
"""
CELL = """
smp AS (SELECT DISTINCT CAST(l_suppkey % 20 AS INTEGER) AS s FROM lineitem),
pick{c} AS (
  SELECT * FROM (SELECT *, CAST(l_suppkey % 20 AS INTEGER) AS s, ROW_NUMBER() OVER (PARTITION BY l_partkey, l_suppkey % 20
    ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = {rn}),
raw{c} AS (
  SELECT t.*, smp.s, l_linenumber AS ln, l_orderkey AS ok, l_suppkey AS sk, l_linestatus AS ls, l_returnflag AS rf, l_quantity AS q, l_discount AS disc,
    (l_linenumber IS NULL OR l_linenumber = 7) AS gone, coalesce(l_linenumber = 5 AND site_id % 7 = 0, FALSE) AS hap
  FROM site{c} t CROSS JOIN smp LEFT JOIN pick{c} p ON p.l_partkey = t.site_id AND p.s = smp.s),
call{c} AS (
  SELECT site_id, chrom, pos, n_alleles, ref, qual, fl, db, h2, s,
    CASE WHEN NOT gone THEN CASE WHEN (ok * 7919 + ln * 31) % 100 < (site_id * 37) % 100 THEN CAST(1 + ok % (n_alleles - 1) AS INTEGER) ELSE 0 END END AS a1,
    CASE WHEN NOT gone AND NOT (ln = 6 AND ls = 'O') AND NOT hap THEN CASE WHEN (ok * 104729 + sk * 17) % 100 < (site_id * 37) % 100 THEN 1 ELSE 0 END END AS a2,
    CASE WHEN hap THEN 1 ELSE 2 END AS ploidy, coalesce(ls = 'F', FALSE) AS phased, coalesce(CAST(q AS INTEGER), -1) AS dp,
    coalesce(CAST(round(disc * 100) AS INTEGER) * 9 + CAST(ln AS INTEGER), -1) AS gq,
    CASE rf WHEN 'N' THEN 'PASS' WHEN 'R' THEN 'LowDP' ELSE '.' END AS ft
  FROM raw{c}),
"""
AGG = """
m AS (SELECT *, {mask} AS masked FROM call WHERE {samples}),
v AS (SELECT *, (NOT masked AND ploidy = 2 AND a1 IS NOT NULL AND a2 IS NOT NULL) AS full_call FROM m),
agg0 AS (
  SELECT site_id, any_value(chrom) AS chrom, any_value(pos) AS pos, any_value(n_alleles) AS n_alleles, any_value(ref) AS ref, any_value(qual) AS qual,
    any_value(fl) AS fl, any_value(db) AS db, any_value(h2) AS h2, CAST(count(*) AS BIGINT) AS n_sel, CAST(sum(ploidy) AS BIGINT) AS slots,
    CAST(sum(CASE WHEN dp >= 0 THEN dp ELSE 0 END) AS BIGINT) AS raw_dp, CAST(sum(CASE WHEN masked THEN 0 ELSE ploidy END) AS BIGINT) AS live_slots,
    CAST(count(*) FILTER (masked) AS BIGINT) AS n_masked, CAST(count(*) FILTER (NOT masked AND phased AND ploidy = 2 AND a2 IS NULL) AS BIGINT) AS half_phased,
    coalesce(bool_and(ploidy = 2) FILTER (NOT masked), TRUE) AS fully_diploid, CAST(count(*) FILTER (full_call) AS BIGINT) AS n_complete,
    CAST(count(*) FILTER (full_call AND a1 <> a2) AS BIGINT) AS n_het, CAST(count(*) FILTER (full_call AND a1 = 0 AND a2 = 0) AS BIGINT) AS n_hom_ref,
    CAST(count(*) FILTER (NOT masked AND dp >= 0) AS BIGINT) AS dp_n, CAST(coalesce(sum(CAST(dp AS BIGINT)) FILTER (NOT masked AND dp >= 0), 0) AS BIGINT) AS dp_sum,
    CAST(coalesce(sum(CAST(dp AS BIGINT) * dp) FILTER (NOT masked AND dp >= 0), 0) AS BIGINT) AS dp_sq,
    CAST(count(*) FILTER (NOT masked AND a1 IS NOT NULL) + count(*) FILTER (NOT masked AND a2 IS NOT NULL) AS BIGINT) AS n_chr,
    CAST(count(*) FILTER (NOT masked AND a1 = 0) + count(*) FILTER (NOT masked AND a2 = 0) AS BIGINT) AS c0,
    CAST(count(*) FILTER (NOT masked AND a1 = 1) + count(*) FILTER (NOT masked AND a2 = 1) AS BIGINT) AS c1,
    CAST(count(*) FILTER (NOT masked AND a1 = 2) + count(*) FILTER (NOT masked AND a2 = 2) AS BIGINT) AS c2
  FROM v GROUP BY site_id),
agg AS (
  SELECT *, CASE WHEN n_alleles = 3 THEN least(c0, c1, c2) ELSE least(c0, c1) END AS least_ac, CASE WHEN n_chr > 0 THEN c0 / n_chr::DOUBLE END AS f0,
    CASE WHEN n_chr > 0 THEN c1 / n_chr::DOUBLE END AS f1, CASE WHEN n_chr > 0 THEN c2 / n_chr::DOUBLE END AS f2,
    c0 * (n_chr - c0) + c1 * (n_chr - c1) + c2 * (n_chr - c2) AS mism FROM agg0),
kept AS (SELECT * FROM agg WHERE {where}){more}
"""
MAF = "least(f0, 1 - f0, f1, 1 - f1, CASE WHEN n_alleles = 3 THEN least(f2, 1 - f2) ELSE 1 END)"


def query(select: str, *, where: str = "TRUE", mask: str = "FALSE", samples: str = "TRUE", more: str = "") -> str:
    """A full statement; `more` are further common tables behind kept."""
    head = "WITH " + SITE.format(c="", where="") + CELL.format(c="", rn=1)
    return head + AGG.format(mask=mask, samples=samples, where=where, more=f",\n{more}" if more else "") + select


def two_sets(select: str, more: str) -> str:
    """A statement over call1 and call2, the first and second line items of each cell."""
    one = SITE.format(c="1", where="") + CELL.format(c="1", rn=1)
    two = SITE.format(c="2", where=" WHERE p_partkey % 3 <> 0") + CELL.format(c="2", rn=2).replace("smp AS (SELECT DISTINCT CAST(l_suppkey % 20 AS INTEGER) AS s FROM lineitem),", "")
    return "WITH " + one + two + more + select
