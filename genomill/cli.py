"""Command line: one input, filters, outputs as text files with a prefix."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from genomill.engine import CallSet, compare, write_outputs
from genomill.session import importable
from genomill.sources import bcf, bgzf, side_files, text_output
from genomill.spec import QuerySpec, SpecError

#: Flag, field of QuerySpec, type. The flags' names are fixed values that users of such tools know.
VALUES = [
    ("--from-bp", "from_bp", int), ("--to-bp", "to_bp", int), ("--min-alleles", "min_alleles", int), ("--max-alleles", "max_alleles", int), ("--minQ", "min_q", float),
    ("--min-meanDP", "min_mean_dp", float), ("--max-meanDP", "max_mean_dp", float), ("--max-missing", "max_missing", float), ("--max-missing-count", "max_missing_count", int),
    ("--maf", "maf", float), ("--max-maf", "max_maf", float), ("--mac", "mac", int), ("--max-mac", "max_mac", int), ("--non-ref-af", "non_ref_af", float),
    ("--max-non-ref-af", "max_non_ref_af", float), ("--non-ref-af-any", "non_ref_af_any", float), ("--max-non-ref-af-any", "max_non_ref_af_any", float), ("--non-ref-ac", "non_ref_ac", int),
    ("--max-non-ref-ac", "max_non_ref_ac", int), ("--non-ref-ac-any", "non_ref_ac_any", int), ("--max-non-ref-ac-any", "max_non_ref_ac_any", int), ("--hwe", "hwe", float), ("--thin", "thin", int),
    ("--minGQ", "min_gq", float), ("--minDP", "min_dp", int), ("--maxDP", "max_dp", int), ("--window-pi-step", "window_pi_step", int), ("--fst-window-step", "fst_step", int),
    ("--ld-window", "ld_window", int), ("--ld-window-min", "ld_window_min", int), ("--ld-window-bp", "ld_window_bp", int), ("--ld-window-bp-min", "ld_window_bp_min", int), ("--min-r2", "min_r2", float),
]
SETS = [
    ("--chr", "chroms"), ("--not-chr", "not_chroms"), ("--keep-filtered", "keep_filtered"), ("--remove-filtered", "remove_filtered"), ("--keep-INFO", "keep_info"),
    ("--remove-INFO", "remove_info"), ("--remove-filtered-geno", "remove_filtered_geno"), ("--indv", "keep_samples"), ("--remove-indv", "remove_samples"),
]
SWITCHES = [
    ("--remove-filtered-all", "remove_filtered_all"), ("--remove-filtered-geno-all", "remove_filtered_geno_all"), ("--remove-indels", "remove_indels"), ("--keep-only-indels", "keep_only_indels"),
    ("--corrected-depth-arithmetic", "corrected_depth"), ("--recode-INFO-all", "recode_info_all"),
]
OUTPUTS = [
    ("--freq", "freq"), ("--freq2", "freq2"), ("--counts", "counts"), ("--missing-site", "missing_site"), ("--site-depth", "site_depth"), ("--site-mean-depth", "site_mean_depth"), ("--depth", "depth"),
    ("--missing-indv", "missing_indv"), ("--het", "het"), ("--hardy", "hardy"), ("--site-quality", "site_quality"), ("--site-pi", "site_pi"), ("--geno-r2", "geno_r2"), ("--pca", "pca"), ("--recode-vcf", "recode"),
    ("--diff-site", "diff_site"), ("--diff-indv", "diff_indv"), ("--diff-site-discordance", "diff_site_discordance"), ("--diff-indv-discordance", "diff_indv_discordance"),
]
WINDOWS = [("--window-pi", "window_pi", "window_pi"), ("--TajimaD", "tajima", "tajima_d"), ("--fst-window-size", "fst_window", "window_fst")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genomill", description=__doc__, allow_abbrev=False)
    source = p.add_mutually_exclusive_group(required=True)
    for flag in ("--vcf", "--gzvcf", "--bcf", "--input"):
        source.add_argument(flag)
    for flag in ("--diff", "--gzdiff", "--diff-bcf", "--positions", "--exclude-positions", "--bed", "--exclude-bed", "--keep", "--remove"):
        p.add_argument(flag)
    for flag in ("--recode", "--recode-bcf"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--weir-fst-pop", action="append", default=[])
    p.add_argument("--pca-no-norm", action="store_true")
    p.add_argument("--out", default="out")
    for flag, name, kind in VALUES:
        p.add_argument(flag, dest=name, type=kind)
    for flag, name in SETS:
        p.add_argument(flag, dest=name, action="append", default=[])
    for flag, name in SWITCHES:
        p.add_argument(flag, dest=name, action="store_true")
    for flag, name in OUTPUTS:
        p.add_argument(flag, dest=f"output_{name}", action="store_true")
    for flag, name, _ in WINDOWS:
        p.add_argument(flag, dest=name, type=int)
    return p


def run_log(argv: Sequence[str], calls: CallSet, spec: QuerySpec, sides: dict, done: Sequence[str], seconds: float) -> list[str]:
    """The lines of PREFIX.log: the command, the filters set, individuals and sites kept of all, files and time."""
    plain = QuerySpec()
    shown = lambda v: ",".join(sorted(map(str, v))) if isinstance(v, frozenset) else str(v)
    filters = [f"\t{k} = {shown(v)}" for k, v in spec.__dict__.items() if v != getattr(plain, k) and k not in ("outputs", "info_types", "populations")]
    out = ["genomill " + " ".join(argv), "", "Filters:", *(filters or ["\tnone"]), *(f"\t{k}: a file" for k in sides), "", "Outputs: " + (", ".join(spec.outputs) or "recoding only")]
    if not any(o.startswith("diff") for o in spec.outputs):
        kept = calls.kept(spec, **sides)
        out += [f"Kept {len(kept.samples)} of {len(calls.samples)} individuals", f"Kept {kept.sites.count()} of {calls.sites.count()} sites read"]
    return [*out, *(f"Wrote {x}" for x in done), f"Took {seconds:.1f} s"]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    began = time.time()
    spark = importable(spark or SparkSession.builder.appName("genomill").getOrCreate())
    names = lambda path: side_files.read_names(spark, path) if path else []
    populations = tuple(tuple(names(p)) for p in a.weir_fst_pop)
    outputs = [name for _, name in OUTPUTS if getattr(a, f"output_{name}")] + [out for _, name, out in WINDOWS if getattr(a, name)]
    if a.pca_no_norm and "pca" not in outputs:
        outputs.append("pca")
    if len(populations) > 1 and "window_fst" not in outputs:
        outputs.append("weir_fst")
    options = {name: getattr(a, name) for _, name, _ in VALUES} | {name: getattr(a, name) for _, name in SWITCHES} | {name: getattr(a, name) for _, name, _ in WINDOWS}
    options |= {name: frozenset(getattr(a, name)) for _, name in SETS}
    options["keep_samples"] |= set(names(a.keep))
    options["remove_samples"] |= set(names(a.remove))
    region = (sorted(options["chroms"]), options["from_bp"], options["to_bp"])
    calls = CallSet.detect(spark, a.vcf or a.gzvcf or a.bcf or a.input, region)
    spec = QuerySpec(**options, populations=populations, outputs=tuple(outputs), pca_normalize=not a.pca_no_norm, info_types=calls.header.info_types if calls.header else {})
    other = a.diff or a.gzdiff or a.diff_bcf
    recoded = a.recode or a.recode_bcf
    if not outputs and not recoded:
        raise SpecError("no output asked for")
    sides = {k: (side_files.read_bed if "bed" in k else side_files.read_positions)(spark, v) for k in ("positions", "exclude_positions", "bed", "exclude_bed") if (v := getattr(a, k))}
    if any(o.startswith("diff") for o in outputs):
        if not other:
            raise SpecError("a comparison needs a second input")
        if recoded:
            raise SpecError("comparisons can't go with recoding")
        found = compare(calls, CallSet.detect(spark, other, region), spec, **sides)
        files = {a.out + text_output.SUFFIX[k]: text_output.table("\t".join(df.columns).upper(), (tuple("." if x is None else x for x in r) for r in df.orderBy(*df.columns[:2]).toLocalIterator()), "nan") for k, df in found.items()}
        text_output.publish(files)
        done = list(files)
    else:
        done = list(write_outputs(calls, spec, a.out, **sides)) if outputs else []
        if recoded:  # block-gzipped parts
            own = calls.kept(spec, **sides)
            header = [*own.header.lines[:-1], "\t".join([*own.header.lines[-1].split("\t")[:9], *own.samples])]
            for asked, kind, write in ((a.recode, "recode_gz", bgzf.write_lines), (a.recode_bcf, "recode_bcf", bcf.write_records)):
                if asked:
                    uri = ("file://" if a.out.startswith("/") else "") + a.out + text_output.SUFFIX[kind]
                    write(own.output("recode", spec), header, uri)
                    done.append(uri)
    log = run_log(argv if argv is not None else sys.argv[1:], calls, spec, sides, done, time.time() - began)
    text_output.publish({a.out + text_output.SUFFIX["log"]: log})
    logging.getLogger("genomill").info("wrote %s in %.1f s", ", ".join(done), time.time() - began)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
