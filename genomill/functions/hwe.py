"""The exact test of Hardy-Weinberg proportions."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities that differ by rounding only count as equal.
TIE = 1 + 1e-9


@functools.lru_cache(maxsize=200_000)
def exact(het: int, hom_ref: int, hom_alt: int) -> tuple[float, float, float]:
    """(two-sided, deficit, excess of heterozygotes) given the allele counts; all 1 without genotypes.

    The number of heterozygotes h has the probability n! 2^h / (hom! h! hom'!) times a constant.
    """
    n = het + hom_ref + hom_alt
    if not n:
        return 1.0, 1.0, 1.0
    rare = het + 2 * min(hom_ref, hom_alt)
    h = np.arange(rare % 2, rare + 1, 2)
    log = h * math.log(2) - np.array([math.lgamma(x + 1) + math.lgamma((rare - x) / 2 + 1) + math.lgamma(n - (rare + x) / 2 + 1) for x in h.tolist()])
    p = np.exp(log - log.max())
    p /= p.sum()
    at = p[h == het][0]
    return float(min(p[p <= at * TIE].sum(), 1)), float(min(p[h <= het].sum(), 1)), float(min(p[h >= het].sum(), 1))


def _exact(het: pd.Series, hom_ref: pd.Series, hom_alt: pd.Series) -> pd.DataFrame:
    rows = [exact(int(a), int(b), int(c)) for a, b, c in zip(het, hom_ref, hom_alt, strict=True)]
    return pd.DataFrame(rows, columns=["p", "deficit", "excess"])


def exact_test(het: Column, hom_ref: Column, hom_alt: Column) -> Column:
    """Struct of p, deficit and excess. Arrow batches; equal counts are worked out once in a worker."""
    return F.pandas_udf(_exact, "p double, deficit double, excess double")(het, hom_ref, hom_alt)
