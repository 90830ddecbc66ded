"""The query: every site, genotype, sample and output option, validated once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

OUTPUTS = (
    "freq freq2 counts missing_site site_depth site_mean_depth site_quality hardy site_pi window_pi tajima_d weir_fst window_fst "
    "depth missing_indv het geno_r2 pca recode diff_site diff_indv diff_site_discordance diff_indv_discordance"
).split()
ORDERED_OUTPUTS = {"window_pi", "tajima_d", "window_fst", "geno_r2"}


class SpecError(ValueError):
    """An option that can't be read, or options that contradict each other."""


@dataclass(frozen=True)
class QuerySpec:
    """Options of one run; None or empty leaves a filter out. All site filters must hold."""

    chroms: frozenset[str] = frozenset()
    not_chroms: frozenset[str] = frozenset()
    from_bp: int | None = None
    to_bp: int | None = None
    keep_filtered: frozenset[str] = frozenset()
    remove_filtered: frozenset[str] = frozenset()
    remove_filtered_all: bool = False
    keep_info: frozenset[str] = frozenset()
    remove_info: frozenset[str] = frozenset()
    min_alleles: int | None = None
    max_alleles: int | None = None
    remove_indels: bool = False
    keep_only_indels: bool = False
    min_q: float | None = None
    min_mean_dp: float | None = None
    max_mean_dp: float | None = None
    max_missing: float | None = None
    max_missing_count: int | None = None
    maf: float | None = None
    max_maf: float | None = None
    mac: int | None = None
    max_mac: int | None = None
    non_ref_af: float | None = None
    max_non_ref_af: float | None = None
    non_ref_af_any: float | None = None
    max_non_ref_af_any: float | None = None
    non_ref_ac: int | None = None
    max_non_ref_ac: int | None = None
    non_ref_ac_any: int | None = None
    max_non_ref_ac_any: int | None = None
    hwe: float | None = None
    thin: int | None = None
    min_gq: float | None = None
    min_dp: int | None = None
    max_dp: int | None = None
    remove_filtered_geno: frozenset[str] = frozenset()
    remove_filtered_geno_all: bool = False
    keep_samples: frozenset[str] = frozenset()
    remove_samples: frozenset[str] = frozenset()
    populations: tuple[tuple[str, ...], ...] = ()
    outputs: tuple[str, ...] = ()
    window_pi: int | None = None
    window_pi_step: int | None = None
    tajima: int | None = None
    fst_window: int | None = None
    fst_step: int | None = None
    ld_window: int | None = None
    ld_window_min: int | None = None
    ld_window_bp: int | None = None
    ld_window_bp_min: int | None = None
    min_r2: float | None = None
    pca_normalize: bool = True
    corrected_depth: bool = False
    recode_info_all: bool = False
    info_types: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        for name, value in self.__dict__.items():
            if isinstance(value, float) and not math.isfinite(value):
                raise SpecError(f"{name} must be finite")
        bad = [o for o in self.outputs if o not in OUTPUTS]
        if bad:
            raise SpecError(f"unknown outputs: {bad}")
        checks = [
            (self.chroms and self.not_chroms, "chroms and not_chroms exclude each other"),
            ((self.from_bp is not None or self.to_bp is not None) and len(self.chroms) != 1, "a position range needs exactly one chromosome"),
            (self.remove_indels and self.keep_only_indels, "remove_indels and keep_only_indels exclude each other"),
            ("freq" in self.outputs and "freq2" in self.outputs, "freq and freq2 exclude each other"),
            (self.max_missing is not None and not 0 <= self.max_missing <= 1, "max_missing lies between 0 and 1"),
            ({"weir_fst", "window_fst"} & set(self.outputs) and len(self.populations) < 2, "F_ST needs two populations"),
            ("diff_site" in self.outputs and {"diff_site_discordance", "diff_indv_discordance"} & set(self.outputs), "diff_site can't go with discordance"),
            (any(o.startswith("diff") for o in self.outputs) and any(not o.startswith("diff") for o in self.outputs), "comparisons can't go with outputs of one call set"),
            (any(o.startswith("diff") for o in self.outputs) and self.filters_calls, "comparisons take chromosome, position, BED and sample filters only"),
            ("window_pi" in self.outputs and not (self.window_pi or 0) > 0, "window_pi needs a window"),
            ("tajima_d" in self.outputs and not (self.tajima or 0) > 0, "tajima_d needs a window"),
            ("window_fst" in self.outputs and not (self.fst_window or 0) > 0, "window_fst needs a window"),
        ]
        for wrong, why in checks:
            if wrong:
                raise SpecError(why)
        not_flags = [k for k in (*self.keep_info, *self.remove_info) if self.info_types.get(k, "Flag") != "Flag"]
        if not_flags:
            raise SpecError(f"only INFO flags can be filtered on: {not_flags}")

    @property
    def filters_calls(self) -> bool:
        """Whether any filter beyond chromosome, position and samples is set."""
        plain = {"chroms", "not_chroms", "from_bp", "to_bp", "keep_samples", "remove_samples", "populations", "outputs", "info_types", "pca_normalize"}
        return any(v not in (None, False, frozenset(), ()) for k, v in self.__dict__.items() if k not in plain)

    @property
    def biallelic(self) -> tuple[int | None, int | None]:
        """Bounds on the number of alleles, with those that hwe and geno_r2 imply."""
        low, high = self.min_alleles, self.max_alleles
        if self.hwe is not None and high is None:
            high = 2
        if "geno_r2" in self.outputs:
            low = high = 2
        return low, high
