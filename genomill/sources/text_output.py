"""Statistics as tab-separated text with C's six significant digits, and staged publishing."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Sequence

SUFFIX = {
    "freq": ".frq", "freq2": ".frq", "counts": ".frq.count", "missing_site": ".lmiss", "site_depth": ".ldepth", "site_mean_depth": ".ldepth.mean", "depth": ".idepth",
    "missing_indv": ".imiss", "het": ".het", "hardy": ".hwe", "site_quality": ".lqual", "site_pi": ".sites.pi", "window_pi": ".windowed.pi", "tajima_d": ".Tajima.D",
    "weir_fst": ".weir.fst", "window_fst": ".windowed.weir.fst", "geno_r2": ".geno.ld", "pca": ".pca", "recode": ".recode.vcf", "recode_gz": ".recode.vcf.gz.parts", "recode_bcf": ".recode.bcf.parts", "log": ".log", "diff_site": ".diff.sites_in_files",
    "diff_indv": ".diff.indv_in_files", "diff_site_discordance": ".diff.sites", "diff_indv_discordance": ".diff.indv",
}


def number(x: float | int | None, nan: str = "-nan") -> str:
    """As a C++ stream prints it: integers whole, doubles with six significant digits."""
    if x is None:
        return nan
    if isinstance(x, int):
        return str(x)
    if math.isnan(x):
        return nan
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return f"{x:.6g}"


def table(header: str, rows: Iterable[Sequence], nan: str = "-nan") -> Iterable[str]:
    yield header
    for r in rows:
        yield "\t".join(x if isinstance(x, str) else number(x, nan) for x in r)


def publish(files: dict[str, Iterable[str]]) -> None:
    """Write every file beside its target and rename all of them at the end; on a failure none appears."""
    staged = {}
    try:
        for path, lines in files.items():
            staged[path] = f"{path}.staging"
            with open(staged[path], "w", encoding="utf-8") as f:
                f.writelines(x + "\n" for x in lines)
        for path, temporary in staged.items():
            os.replace(temporary, path)
    except BaseException:
        for temporary in staged.values():
            if os.path.exists(temporary):
                os.remove(temporary)
        raise


