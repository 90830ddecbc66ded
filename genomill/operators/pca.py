"""Principal components of samples: a distributed Gram matrix, then its eigenvectors on the driver (samples x samples)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.functions.calls import ratio

BATCH = 1024


def gram(sites: DataFrame, n_samples: int, normalize: bool = True) -> DataFrame:
    """i, j, value: sum over variable biallelic sites of X_i X_j / number of sites; X the alternate dosage, centred.

    A site with a call that isn't complete and diploid raises. Each task adds up its own matrix, samples squared in size.
    """
    p = ratio(F.get("ac", F.lit(1)), F.col("n_chr"))
    bad = F.exists("calls", lambda c: (c["ploidy"] != 2) | c["a1"].isNull() | c["a2"].isNull())
    dose = F.transform("calls", lambda c: (c["a1"] + c["a2"]).cast("double"))
    df = sites.where("n_alleles = 2").select(F.when(bad, F.raise_error(F.lit("PCA needs complete diploid genotypes"))).otherwise(dose).alias("g"), p.alias("p"))
    df = df.where("p > 0 and p < 1")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sites = np.zeros((n_samples, n_samples)), 0
        for batch in batches:
            for low in range(0, len(batch), BATCH):
                part = batch.iloc[low : low + BATCH]
                freq = part["p"].to_numpy()[:, None]
                x = np.stack(part["g"].to_numpy()) - 2 * freq
                if normalize:
                    x /= np.sqrt(freq * (1 - freq))
                total += x.T @ x
                sites += len(part)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel(), "n": sites})

    sums = df.mapInPandas(add, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("i", "j", ratio(F.col("s"), F.col("n")).alias("value"), F.col("n").alias("n_sites"))


def pca(sites: DataFrame, samples: Sequence[str], normalize: bool = True) -> DataFrame:
    """indv (EIGENVALUE first) and components by descending squared eigenvalue; a vector's sign is arbitrary."""
    n = len(samples)
    rows = gram(sites, n, normalize).collect()  # samples squared
    matrix, used = np.zeros((n, n)), 0
    for r in rows:
        matrix[r.i, r.j], used = r.value, r.n_sites
    if used <= n:
        raise ValueError("PCA needs more sites than samples")
    value, vector = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-(value**2), kind="stable")
    out = [("EIGENVALUE", *map(float, value[order]))] + [(s, *map(float, vector[k, order])) for k, s in enumerate(samples)]
    return sites.sparkSession.createDataFrame(out, "indv string, " + ", ".join(f"pc{i + 1} double" for i in range(n)))
