"""Mixing sources to target weights (3): soft memberships and nonnegative document rates.

1. A softmax classifier is trained on a bounded sample of labelled documents; it gives every document a posterior over
   the domains, so a document counts to several of them.
2. Rates r >= 0, one for each document, minimise
       1/2 e' G^-1 e + ridge/2 sum_d n_d/N (r_d - 1)^2,  e_k = sum_d r_d n_d p_dk / N - t_k,  G = sum_d n_d/N p_d p_d'
   (n tokens, p posteriors, N all tokens, t target shares) by accelerated projected gradient. G makes rare domains
   weigh as much as frequent ones, in the residuals and against the ridge. In the metric of the token counts a
   document's step depends on its posterior and G^-1 e only. An iteration is one pass over (n, p): each task replays
   the residuals so far for its documents and returns one sum for each domain.
3. Where that doesn't bring every domain within TOLERANCE of its target, Newton steps on the dual finish: the optimum
   has the rates max(0, 1 + p'l) for one multiplier l of each domain. They end when the optimum's equations hold.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.llm._common import checkpoint, map_arrow, own

TRAIN_ROWS = 3000
VOCABULARY = 4000
SYMBOLS, CAPITALS = b"#*$%&|<>!", bytes(range(65, 91))
DENSE = 5
RIDGE, DUAL_RIDGE = 1e-4, 1e-6
# Relative to each target: error that ends the gradient steps, and error in the optimum's equations that ends the dual steps.
ITERATIONS, TOLERANCE = 80, 1e-3
DUAL_STEPS, DUAL_TOLERANCE = 100, 1e-5
TARGETS = {"clean": 0.92, "low": 0.02, "toxic": 0.06}


def label_domain() -> Column:
    """The domain that the labels table gives: toxic, else clean or low by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")


def _dense(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size = max(len(words), 1), max(len(text), 1)
    return [1.0, min(math.log1p(len(words)) / 8, 2.0), 1 - distinct / n, min((len(text) - len(text.translate(None, SYMBOLS))) / n, 2.0), 5 * (len(text) - len(text.translate(None, CAPITALS))) / size]


class Classifier:
    """Softmax regression on the presence of frequent words and a few ratios."""

    def __init__(self, domains: list[str], vocabulary: dict[bytes, int], weights: np.ndarray):
        self.domains, self.vocabulary, self.weights = domains, vocabulary, weights

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], domains: list[str], rounds: int = 150) -> Classifier:
        seen, bags = Counter(), []
        for t in texts:
            words = t.split()
            bags.append((t, words, set(words)))
            seen.update(bags[-1][2])
        top = sorted(seen, key=lambda w: (-seen[w], w))[:VOCABULARY]
        vocabulary = {w: i for i, w in enumerate(top)}
        x = np.zeros((len(texts), len(top) + DENSE), dtype=np.float32)
        for i, (t, words, distinct) in enumerate(bags):
            x[i, [vocabulary[w] for w in distinct if w in vocabulary]] = 1
            x[i, len(top) :] = _dense(t, words, len(distinct))
        y = np.zeros((len(texts), len(domains)), dtype=np.float32)
        y[np.arange(len(texts)), [domains.index(d) for d in labels]] = 1
        w = np.zeros((x.shape[1], len(domains)), dtype=np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, rounds + 1 if len(texts) else 1):  # Adam on the mean cross-entropy
            z = x @ w
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ (e / e.sum(axis=1, keepdims=True) - y) / len(texts) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(domains, vocabulary, w.astype(np.float64))

    def posterior(self, text: bytes) -> tuple[int, np.ndarray]:
        """(words, probabilities of the domains)."""
        words = text.split()
        distinct = set(words)
        v = self.vocabulary
        z = self.weights[[v[w] for w in distinct if w in v]].sum(axis=0) + _dense(text, words, len(distinct)) @ self.weights[len(v) :]
        e = np.exp(z - z.max())
        return len(words), e / e.sum()


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", domain: Column | None = None, domains: list[str] | None = None, rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier from at most `rows` labelled documents: those with the least hashes of their keys."""
    domains = domains or list(TARGETS)
    named = labels.select(F.col(key).alias("__key"), (label_domain() if domain is None else domain).alias("__domain"))
    picked = named.where(F.col("__domain").isin(domains) & F.col("__key").isNotNull()).orderBy(F.xxhash64("__key"), "__key", "__domain").limit(rows)
    # At most `rows` rows of a key and a name.
    found = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text")).join(F.broadcast(picked), "__key").orderBy("__key", "__domain", "__text").limit(rows).collect()
    return Classifier.fit([bytes(r["__text"] or b"") for r in found], [r["__domain"] for r in found], domains)


def memberships(docs: DataFrame, classifier: Classifier, *, key: str = "doc_id", text: str = "text", tokens: str | None = None) -> DataFrame:
    """key, n_tokens (the column tokens, else words) and p, the posterior over the classifier's domains, of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((classifier.domains, classifier.vocabulary, classifier.weights))

    def make():
        model = Classifier(*shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, p = zip(*(model.posterior(x or b"") for x in batch.column(1).to_pylist()), strict=True)
            if tokens is not None:
                n = [x or 0 for x in batch.column(2).to_pylist()]
            flat = pa.array(np.concatenate(p))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(model.domains)), flat)], ["key", "n", "p"])

        return run

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *([own(tokens).cast("long").alias("tokens")] if tokens is not None else []))
    return map_arrow(rows, make, f"key {kind}, n long, p array<double>").select(F.col("key").alias(key), F.col("n").alias("n_tokens"), "p")


def replay(p: np.ndarray, steps: list[np.ndarray], step: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) after the residuals of each step so far; rows of p are posteriors."""
    rate = ahead = np.ones(len(p))
    t = 1.0
    for residual in steps:
        new = np.maximum(ahead - step * (p @ residual + ridge * (ahead - 1)), 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - rate)
        rate = new
    return rate, ahead


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(slim: DataFrame, steps: list[np.ndarray], step: float, ridge: float, k: int) -> np.ndarray:
    """Expected tokens of each domain at the rates, and at the extrapolated rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k)
        for batch in batches:
            p, n = _matrix(batch.column(1)), batch.column(0).to_numpy()
            rate, ahead = replay(p, steps, step, ridge)
            total += np.concatenate([(n * rate) @ p, (n * ahead) @ p])
        yield pa.RecordBatch.from_pydict({f"s{i}": [x] for i, x in enumerate(total.tolist())})

    parts = slim.select("n_tokens", "p").mapInArrow(run, ", ".join(f"s{i} double" for i in range(2 * k))).collect()  # a row of a few numbers for each task
    return np.array([math.fsum(sorted(r[i] for r in parts)) for i in range(2 * k)])


def _dual_sums(slim: DataFrame, duals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of duals: expected tokens of each domain, sum of n r^2, and sum of n p p' over rates above 0."""
    many = len(duals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, k + 1 + k * k))
        for batch in batches:
            p, n = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for i, dual in enumerate(duals):
                rate = np.maximum(1 + p @ dual, 0)
                total[i] += np.concatenate([(n * rate) @ p, [(n * rate) @ rate], ((p * (n * (rate > 0))[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = slim.select("n_tokens", "p").mapInArrow(run, "sums array<double>").collect()  # a row of a few numbers for each task
    sums = np.array([math.fsum(sorted(c)) for c in zip(*(r["sums"] for r in parts), strict=True)]).reshape(many, -1)
    return sums[:, :k], sums[:, k], sums[:, k + 1 :].reshape(many, k, k)


def _finish(slim: DataFrame, target: np.ndarray, gram: np.ndarray, total: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(multiplier of each domain, shares reached) by Newton steps with a line search; the sums of all its points are one pass."""
    k, lengths = len(target), 0.5 ** np.arange(12)
    inside = gram @ np.linalg.pinv(gram, hermitian=True)  # what the posteriors can tell apart
    points = np.zeros((1, k))
    for _ in range(DUAL_STEPS):
        reached, squares, active = (x / total for x in _dual_sums(slim, points, k))
        best = int(np.argmin(0.5 * squares - points @ target + 0.5 * ridge * np.einsum("ij,jk,ik->i", points, gram, points)))
        dual, reached = points[best], reached[best]
        error = inside @ (reached - target + ridge * gram @ dual)
        if np.all(np.abs(error) <= DUAL_TOLERANCE * target):
            return dual, reached
        step = np.linalg.lstsq(active[best] + ridge * gram, error, rcond=1e-15)[0]
        points = np.concatenate([dual[None], dual - lengths[:, None] * step])
    logging.getLogger(__name__).warning("the mixture is not at its optimum after %d steps; error %s", DUAL_STEPS, error)
    return dual, reached


def solve(slim: DataFrame, target: np.ndarray, *, ridge: float = RIDGE, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float, np.ndarray | None]:
    """G^-1 times the residuals of each iteration, the step, and the dual if that finished; rates() takes them. slim: n_tokens, p."""
    k, steps, step = len(target), [], 1 / (1 + ridge)
    total = float(slim.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return steps, step, None
    gram = _dual_sums(slim, np.zeros((1, k)), k)[2][0] / total
    inverse = np.linalg.pinv(gram, hermitian=True)
    dual = None
    while True:
        reached, ahead = np.split(_sums(slim, steps, step, ridge, k) / total, 2)
        if np.all(np.abs(reached - target) <= tolerance * target):
            break
        if len(steps) == iterations:
            dual, reached = _finish(slim, target, gram, total, DUAL_RIDGE)
            break
        steps.append(inverse @ (ahead - target))
    logging.getLogger(__name__).info("shares of tokens reached %s, targets %s", reached.tolist(), target.tolist())
    return steps, step, dual


def rates(p: np.ndarray, steps: list[np.ndarray], step: float, dual: np.ndarray | None) -> np.ndarray:
    """Rates of documents from what solve() gave."""
    return replay(p, steps, step, RIDGE)[0] if dual is None else np.maximum(1 + p @ dual, 0)


def mix(docs: DataFrame, labels: DataFrame, *, targets: Mapping[str, float] = TARGETS, key: str = "doc_id", text: str = "text", domain: Column | None = None, rows: int = TRAIN_ROWS, tokens: str | None = None) -> DataFrame:
    """One row per document: key, n_tokens, p_<domain> for each domain, rate, copies.

    Tokens are counted by the column tokens (a tokenizer's counts, null for none); without one they are white-space words.

    Over all documents, rate * n_tokens * p sums to the target share of all tokens for each domain, within
    TOLERANCE of it or as far as nonnegative rates allow (rates of rare domains can be high). copies is rate, rounded up or down by a hash of the key so that its expectation is rate.
    A null text has no tokens and its rate is that of its posterior. Repeated rows have equal results; without
    labelled documents every posterior is uniform; an empty table gives no rows. Only key, text and tokens are read, so
    other columns' names can't clash; texts are read whole.
    """
    domains = list(targets)
    target = np.array([targets[d] for d in domains], dtype=float)
    target /= target.sum()
    classifier = train(docs, labels, key=key, text=text, domain=domain, domains=domains, rows=rows)
    slim = checkpoint(memberships(docs, classifier, key=key, text=text, tokens=tokens))
    steps, step, dual = solve(slim, target)
    kind = slim.schema[key].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rate = rates(_matrix(batch.column(2)), steps, step, dual)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["key", "n_tokens", "p", "rate"])

        return run

    out = map_arrow(slim.select(F.col(key).alias("key"), "n_tokens", "p"), make, f"key {kind}, n_tokens long, p array<double>, rate double")
    unit = F.pmod(F.xxhash64("key", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return out.select(F.col("key").alias(key), "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)), "rate", F.floor(F.col("rate") + unit).cast("long").alias("copies"))


def resampled(docs: DataFrame, mixed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """docs with each row as often as its key's copies say; keys that mixed hasn't are left out. Columns of any name stay."""
    many = mixed.groupBy(F.col(key).alias("key")).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*map(own, docs.columns)).alias("row"))
    out = rows.join(many, F.col("row").getField(key).eqNullSafe(many["key"])).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
