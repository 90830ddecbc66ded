"""Call sets and their outputs: one filtered, summarized plan feeds every output that is asked for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import diff, fst, individual_stats, ld, pca, recode, selectors, site_stats, windows
from genomill.operators.filters import kept_sites, record_predicates
from genomill.sources import bcf, bgzf, index, tables, text_output, vcf
from genomill.spec import ORDERED_OUTPUTS, QuerySpec

#: Chromosomes, first and last position (None for no bound) that the filters ask for.
Region = tuple[Sequence[str], int | None, int | None]


@dataclass
class CallSet:
    """Sites, the names of their samples, and the header if there is one."""

    sites: DataFrame
    samples: list[str]
    header: vcf.Header | None = None

    @classmethod
    def from_vcf(cls, spark: SparkSession, path: str) -> CallSet:
        sites, header = vcf.read_vcf(spark, path)
        return cls(sites, list(header.samples), header)

    @classmethod
    def from_bgzf(cls, spark: SparkSession, path: str, split: int = 16 << 20, region: Region | None = None) -> CallSet:
        """Block-gzipped VCF, read in ranges by several tasks; of a region only the blocks that an index beside the file names.

        Without a usable index, or a region, the whole file is read. The region's filters still have to be applied.
        """
        header = vcf.read_header(spark, path)
        found = index.beside(path) if region and region[0] else None
        chunks = index.merged(c for chrom in region[0] for c in found.ranges(chrom, *region[1:])) if found else None
        lines = bgzf.read_lines(spark, path, split, chunks).where(~F.col("value").startswith("#") & (F.col("value") != ""))
        return cls(vcf.parse_sites(lines), list(header.samples), header)

    @classmethod
    def from_bcf(cls, spark: SparkSession, path: str) -> CallSet:
        lines, header = bcf.read_lines(spark, path)
        return cls(vcf.parse_sites(lines), list(header.samples), header)

    @classmethod
    def detect(cls, spark: SparkSession, path: str, region: Region | None = None) -> CallSet:
        """By the file's first bytes, not by its name."""
        kind = bcf.sniff(path)
        if kind == "bgzf":
            return cls.from_bgzf(spark, path, region=region)
        return (cls.from_bcf if kind == "bcf" else cls.from_vcf)(spark, path)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, copy: int = 1) -> CallSet:
        return cls(tables.sites(spark, sf_dir, copy), tables.samples_of(spark, sf_dir))

    @classmethod
    def from_lines(cls, spark: SparkSession, text: str) -> CallSet:
        sites, header = vcf.from_lines(spark, text)
        return cls(sites, list(header.samples), header)

    def restricted(self, spec: QuerySpec) -> CallSet:
        """Only the samples that the options select."""
        at = selectors.selected(self.samples, spec)
        return CallSet(selectors.with_samples(self.sites, at, len(self.samples)), [self.samples[i] for i in at], self.header)

    def kept(self, spec: QuerySpec, positions: DataFrame | None = None, exclude_positions: DataFrame | None = None, bed: DataFrame | None = None, exclude_bed: DataFrame | None = None) -> CallSet:
        """Sites after all filters, with their aggregates."""
        own = self.restricted(spec)
        return CallSet(kept_sites(selectors.beside(own.sites, positions, exclude_positions, bed, exclude_bed), spec), own.samples, own.header)

    def outputs(self, spec: QuerySpec, **sides: DataFrame | None) -> dict[str, DataFrame]:
        """A DataFrame for each output. With several the kept sites are cached, so the scan is shared."""
        own = self.kept(spec, **sides)
        if len(spec.outputs) > 1:
            own.sites = own.sites.persist()
        if ORDERED_OUTPUTS & set(spec.outputs):
            windows.checked_order(own.sites)
        return {name: own.output(name, spec) for name in spec.outputs}

    def output(self, name: str, spec: QuerySpec) -> DataFrame:
        """One output of kept sites."""
        s, n = self.sites, len(self.samples)
        pops = selectors.population_indices(self.samples, spec.populations)
        make = {
            "freq": lambda: site_stats.freq(s),
            "freq2": lambda: site_stats.freq(s).drop("alleles"),
            "counts": lambda: site_stats.counts(s),
            "missing_site": lambda: site_stats.missing_site(s),
            "site_depth": lambda: site_stats.site_depth(s, spec.corrected_depth),
            "site_mean_depth": lambda: site_stats.site_mean_depth(s, spec.corrected_depth),
            "site_quality": lambda: site_stats.site_quality(s),
            "hardy": lambda: site_stats.hardy(s),
            "site_pi": lambda: site_stats.site_pi(s),
            "window_pi": lambda: windows.window_pi(s, spec.window_pi, spec.window_pi_step, n),
            "tajima_d": lambda: windows.tajima_d(s, spec.tajima, n),
            "weir_fst": lambda: fst.site_fst(s, pops),
            "window_fst": lambda: fst.window_fst(s, pops, spec.fst_window, spec.fst_step),
            "depth": lambda: individual_stats.depth(s, self.samples),
            "missing_indv": lambda: individual_stats.missing(s, self.samples),
            "het": lambda: individual_stats.het(s, self.samples),
            "geno_r2": lambda: ld.geno_r2(s, window=spec.ld_window, window_min=spec.ld_window_min, bp=spec.ld_window_bp, bp_min=spec.ld_window_bp_min, min_r2=spec.min_r2),
            "pca": lambda: pca.pca(s, self.samples, spec.pca_normalize),
            "recode": lambda: recode.recode(s, spec.recode_info_all),
        }
        return make[name]()

    def lines(self, name: str, spec: QuerySpec) -> Iterable[str]:
        """One output of kept sites as text lines with a header, in order, fetched part by part."""
        df = self.output(name, spec)
        rows = lambda d, *by: d.orderBy(*by).toLocalIterator()
        pairs = lambda r, values: "\t".join(f"{a}:{text_output.number(v)}" for a, v in zip(r.alleles, values, strict=True))
        site = "CHROM\tPOS"
        if name in ("freq", "counts"):
            key = "freq" if name == "freq" else "count"
            return text_output.table(f"{site}\tN_ALLELES\tN_CHR\t{{ALLELE:{key.upper()}}}", ((r.chrom, r.pos, r.n_alleles, r.n_chr, pairs(r, r[key])) for r in rows(df, "ordinal")))
        if name == "freq2":
            return text_output.table(f"{site}\tN_ALLELES\tN_CHR\t{{FREQ}}", ((r.chrom, r.pos, r.n_alleles, r.n_chr, *r.freq) for r in rows(df, "ordinal")))
        if name == "recode":
            return (*recode.recoded_header(self.header, self.samples), *(r.line for r in rows(df, "ordinal")))
        if name == "hardy":
            three = lambda v: "/".join(f"{x:.2f}" if isinstance(x, float) else str(x) for x in v)
            return text_output.table(
                "CHR\tPOS\tOBS(HOM1/HET/HOM2)\tE(HOM1/HET/HOM2)\tChiSq_HWE\tP_HWE\tP_HET_DEFICIT\tP_HET_EXCESS",
                ((r.chrom, r.pos, three((r.obs_hom1, r.obs_het, r.obs_hom2)), three((r.e_hom1, r.e_het, r.e_hom2)), *(f"{x:.6e}" for x in (r.chisq, r.p_hwe, r.p_het_deficit, r.p_het_excess))) for r in rows(df, "ordinal")),
            )
        if name == "het":
            return text_output.table("INDV\tO(HOM)\tE(HOM)\tN_SITES\tF", ((r.indv, r.o_hom, f"{r.e_hom:.1f}", r.n_sites, f"{r.f:.5f}") for r in rows(df, "sample_idx")))
        headers = {
            "missing_site": ("CHR\tPOS\tN_DATA\tN_GENOTYPE_FILTERED\tN_MISS\tF_MISS", ["ordinal"], "chrom pos n_data n_filtered n_miss f_miss"),
            "site_depth": (f"{site}\tSUM_DEPTH\tSUMSQ_DEPTH", ["ordinal"], "chrom pos sum_depth sumsq_depth"),
            "site_mean_depth": (f"{site}\tMEAN_DEPTH\tVAR_DEPTH", ["ordinal"], "chrom pos mean_depth var_depth"),
            "site_quality": (f"{site}\tQUAL", ["ordinal"], "chrom pos qual"),
            "site_pi": (f"{site}\tPI", ["ordinal"], "chrom pos pi"),
            "weir_fst": (f"{site}\tWEIR_AND_COCKERHAM_FST", ["ordinal"], "chrom pos fst"),
            "window_pi": ("CHROM\tBIN_START\tBIN_END\tN_VARIANTS\tN_MONOMORPHIC\tPI", ["chrom", "bin_start"], "chrom bin_start bin_end n_variants n_monomorphic pi"),
            "tajima_d": ("CHROM\tBIN_START\tN_SNPS\tTajimaD", ["chrom", "bin_start"], "chrom bin_start n_snps tajima_d"),
            "window_fst": ("CHROM\tBIN_START\tBIN_END\tN_VARIANTS\tWEIGHTED_FST\tMEAN_FST", ["chrom", "bin_start"], "chrom bin_start bin_end n_variants weighted_fst mean_fst"),
            "depth": ("INDV\tN_SITES\tMEAN_DEPTH", ["sample_idx"], "indv n_sites mean_depth"),
            "missing_indv": ("INDV\tN_DATA\tN_GENOTYPES_FILTERED\tN_MISS\tF_MISS", ["sample_idx"], "indv n_data n_filtered n_miss f_miss"),
            "geno_r2": ("CHR\tPOS1\tPOS2\tN_INDV\tR^2", ["chrom", "pos1", "pos2"], "chrom pos1 pos2 n_indv r2"),
        }
        if name == "pca":
            return text_output.table("\t".join(df.columns).upper(), (tuple(r) for r in df.collect()))
        head, order, columns = headers[name]
        return text_output.table(head, ((*(r[c] for c in columns.split()),) for r in rows(df, *order)), "nan" if name == "tajima_d" else "-nan")


def compare(first: CallSet, second: CallSet, spec: QuerySpec, positions: DataFrame | None = None, exclude_positions: DataFrame | None = None, bed: DataFrame | None = None, exclude_bed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The comparison outputs of two call sets, after the filters and side tables that they share."""
    both = []
    for x in (first, second):
        own = x.restricted(spec)
        for p in record_predicates(spec):
            own.sites = own.sites.where(p)
        own.sites = selectors.beside(own.sites, positions, exclude_positions, bed, exclude_bed)
        both.append(own)
    a, b = both
    make = {
        "diff_site": lambda: diff.site_presence(a.sites, b.sites),
        "diff_indv": lambda: diff.diff_individuals(a.sites.sparkSession, a.samples, b.samples),
        "diff_site_discordance": lambda: diff.site_discordance(a.sites, b.sites, a.samples, b.samples),
        "diff_indv_discordance": lambda: diff.individual_discordance(a.sites, b.sites, a.samples, b.samples),
    }
    return {name: make[name]() for name in spec.outputs}


def write_outputs(calls: CallSet, spec: QuerySpec, prefix: str, **sides: DataFrame | None) -> Sequence[str]:
    """Text files prefix + suffix for each output, all or none."""
    own = calls.kept(spec, **sides)
    if len(spec.outputs) > 1:
        own.sites = own.sites.persist()
    if ORDERED_OUTPUTS & set(spec.outputs):
        windows.checked_order(own.sites)
    files = {prefix + text_output.SUFFIX[name]: own.lines(name, spec) for name in spec.outputs}
    text_output.publish(files)
    return list(files)
