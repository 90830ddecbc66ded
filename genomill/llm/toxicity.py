"""Toxicity (10): a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters, each damped by the lengths that it spans
in both, so inserted or left-out characters only weaken a match. Landmarks are character runs that tell the sentences
of toxic documents from those of others, and frequent clean words. A word's Nyström vector is its kernel with them,
whitened by the landmarks' own kernel matrix. The machine is trained on words of labelled sentences: of a toxic
document's sentence only its most toxic word counts, as the label says that there is one, of a clean sentence all do.
A document's features are its two most toxic words' decision values, how many words are decided toxic and how many there
are; a logistic regression fitted on the training documents makes them a score.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm._chunks import in_groups
from genomill.llm._common import held, map_arrow

ORDER, DECAY = 3, 0.5
TRAIN_PER_CLASS = 1200
LANDMARKS, CLEAN_LANDMARKS = 64, 16
LENGTH = 24
#: Least support times log ratio of a landmark: among so many runs weaker ones arise by chance.
EVIDENCE = 25.0
CACHE_WORDS = 300_000
RIDGE = 0.02
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
SPELLED = re.compile(r"(?:(?<=\s)|^)\w(?:[ \t]\w){2,}(?=\s|$)")
EDGES = " .,;:!?#*$%&<>()|\"'[]{}-_/\\"


def normal(word: str) -> str:
    """Lower case without marks at the ends, behind a sign for the beginning."""
    return "^" + word.strip(EDGES).lower()


def words_of_text(text: str) -> list[str]:
    """White-space words, and each run of three or more single letters joined to one."""
    words = text.split()
    if SPELLED.search(text):
        words += [re.sub(r"[ \t]", "", m[0]) for m in SPELLED.finditer(text)]
    return words


def coded(strings: list[str], pad: int) -> np.ndarray:
    """Code points, a row for each string, filled up with pad."""
    length = np.array([len(s) for s in strings])
    out = np.full((len(strings), int(length.max(initial=1))), pad, dtype=np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row of a with the same row of b; their pads must differ."""
    n, square = len(a), decay * decay
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    levels = [np.ones((len(b) + 1, n), dtype=np.float32)] + [np.zeros((len(b) + 1, n), dtype=np.float32) for _ in range(order - 1)]
    out = np.zeros(n, dtype=np.float32)
    for x in a:
        same = (b == x) * np.float32(square)
        out += (same * levels[-1][:-1]).sum(axis=0)
        for k in range(order - 1, 0, -1):  # a level needs the one below as it was before x
            run = np.zeros(n, dtype=np.float32)
            gain = same * levels[k - 1][:-1]
            levels[k] *= np.float32(decay)
            for j in range(len(b)):
                run = run * np.float32(decay) + gain[j]
                levels[k][j + 1] += run
    return out


class Landmarks:
    """Strings with their adjacent character pairs; a word's kernel with one counts if it has half of those pairs.

    A word has a pair if the characters are at most two places apart in order.
    """

    def __init__(self, strings: list[str]):
        self.strings, self.codes = strings, coded(strings, -2)
        self.own = np.maximum(subsequence_kernel(np.where(self.codes == -2, -1, self.codes), self.codes), 1e-9)
        pairs = [[(s[i], s[i + 1]) for i in range(len(s) - 1)] for s in strings]
        self.pair = {p: i for i, p in enumerate(dict.fromkeys(p for x in pairs for p in x))}
        self.keys = np.array([ord(a) << 21 | ord(b) for a, b in self.pair], dtype=np.int64)
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]
        self.has = np.zeros((len(self.pair), len(strings)), dtype=np.float32)
        for j, x in enumerate(pairs):
            self.has[[self.pair[p] for p in x], j] = 1
        self.need = np.ceil(self.has.sum(axis=0) / 2)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernels with the landmarks as shares of the landmarks' own, a row for each word (already normal, at most LENGTH long).

        The word's own kernel doesn't count: an insult with a long ending is as near to its landmark as without. No word
        is nearer to a landmark than that itself, however often it repeats a part of it.
        """
        out = np.zeros((len(words), len(self.strings)), dtype=np.float32)
        if not words:
            return out
        codes = coded(words, -1)
        found = np.zeros((len(words), len(self.pair)), dtype=np.float32)
        for gap in (1, 2, 3):
            if codes.shape[1] > gap:
                left, right = codes[:, :-gap].astype(np.int64), codes[:, gap:].astype(np.int64)
                key = np.where(right >= 0, left << 21 | right, -1)
                at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
                row, column = np.nonzero(self.sorted[at] == key)
                found[row, self.order[at[row, column]]] = 1
        some = np.flatnonzero(found.sum(axis=1) >= self.need.min())
        i, j = np.nonzero(found[some] @ self.has >= self.need)
        i = some[i]
        for low in range(0, len(i), 50_000):
            a, b = i[low : low + 50_000], j[low : low + 50_000]
            out[a, b] = np.minimum(subsequence_kernel(codes[a], self.codes[b]) / self.own[b], 1)
        return out


class Model:
    """Decision values of words and scores of documents."""

    def __init__(self, landmarks: list[str], alpha: list[float], bias: float, weights: list[float], shift: float):
        self.parts = (landmarks, alpha, bias, weights, shift)
        self.landmarks, self.alpha = Landmarks(landmarks) if landmarks else None, np.array(alpha, dtype=np.float32)
        self.bias, self.weights, self.shift, self.known = bias, np.array(weights), shift, {}

    def decide(self, words: list[str]) -> list[float]:
        """Of each normal word; a long one is the best of its overlapping windows, one with marks inside is also tried without."""
        if self.landmarks is None:
            return [self.bias] * len(words)
        marked = {w: "^" + bare for w in words if not w[1:].isalpha() and len(bare := "".join(filter(str.isalpha, w))) > 2 and bare != w[1:]}
        if marked:
            plain = [w for w in words if w not in marked]
            value = dict(zip(plain + (bare := list(dict.fromkeys(marked.values()))), self.decide(plain + bare), strict=True))
            own = dict(zip(marked, self._decide(list(marked)), strict=True))
            return [max(own[w], value[marked[w]]) if w in marked else value[w] for w in words]
        return self._decide(words)

    def _decide(self, words: list[str]) -> list[float]:
        short = [w for w in words if len(w) <= LENGTH]
        value = dict(zip(short, (self.landmarks.kernel(short) @ self.alpha + self.bias).tolist(), strict=True)) if short else {}
        for w in words:
            if w not in value:
                cut = [w[k : k + LENGTH] for k in range(0, max(len(w) - LENGTH // 2, 1), LENGTH // 2)]
                value[w] = max(float((self.landmarks.kernel(cut[k : k + 20_000]) @ self.alpha).max()) + self.bias for k in range(0, len(cut), 20_000))
        return [value[w] for w in words]

    def features(self, texts: list[str]) -> list[list[float]]:
        """Of each text: the decision values of its two most toxic words (the bias for none), the logs of one more than the toxic words' and all words' numbers."""
        cut = [words_of_text(t) for t in texts]
        known = self.known
        new = [w for w in set().union(*cut) if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set().union(*cut))
        forms = [normal(w) for w in new]
        distinct = list(dict.fromkeys(forms))
        value = {}
        for low in range(0, len(distinct), 20_000):
            part = distinct[low : low + 20_000]
            value.update(zip(part, self.decide(part), strict=True))
        known.update((w, value[f]) for w, f in zip(new, forms, strict=True))
        out = []
        for words in cut:
            v = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
            top = np.partition(v, len(v) - 2)[-2:].tolist() if len(v) > 1 else [self.bias, *v.tolist()][-2:] if len(v) else [self.bias] * 2
            out.append([top[-1], top[0], math.log1p(int(np.count_nonzero(v > 0))), math.log1p(len(v))])
        return out

    def score(self, texts: list[str]) -> list[float]:
        x = np.array(in_groups(texts, self.features), dtype=np.float64).reshape(len(texts), 4)
        return (1 / (1 + np.exp(-np.clip(x @ self.weights + self.shift, -50, 50)))).tolist()


def _runs(word: str) -> set[str]:
    return {word[k : k + n] for n in range(4, 9) for k in range(len(word) - n + 1)} | ({word} if 4 <= len(word) <= 12 else set())


def find_landmarks(toxic: list[list[str]], clean: list[set[str]], most: int = LANDMARKS) -> list[str]:
    """Character runs that most tell toxic documents' words from clean ones', each on words without the runs before it.

    A run's support is the number of different neighbours that its words stand between, so that a sentence which many
    copies share counts once.
    """
    in_toxic, in_clean = defaultdict(set), defaultdict(int)
    for d in toxic:
        for before, w, after in zip(["", *d[:-1]], d, [*d[1:], ""], strict=True):
            in_toxic[w].add((before, after))
    for d in clean:
        for w in d:
            in_clean[w] += 1
    common = 0.02 * len(clean)
    words = defaultdict(list)
    for w in in_toxic:
        if in_clean.get(w, 0) <= common:
            for g in _runs(w):
                words[g].append(w)
    against = defaultdict(int)
    for w, n in in_clean.items():
        for g in _runs(w):
            if g in words:
                against[g] += n
    used: set[str] = set()
    least = max(5, 0.015 * len(toxic))

    def worth(g: str) -> float:
        docs = set().union(*(in_toxic[w] for w in words[g] if w not in used), set())
        if len(docs) < least:
            return 0.0
        ratio = (len(docs) + 0.5) / len(toxic) / ((against[g] + 0.5) / max(len(clean), 1))
        value = len(docs) * math.log(ratio)
        return value if ratio >= 8 and value >= EVIDENCE else 0.0

    # A run's worth only falls as words are used up, so a stale value at the top is worked out anew.
    heap = [(-v, -len(g), g) for g in words if (v := worth(g)) > 0]
    heapq.heapify(heap)
    out: list[str] = []
    while heap and len(out) < most:
        v, size, g = heapq.heappop(heap)
        now = worth(g)
        if now <= 0:
            continue
        if now < -v - 1e-9:
            heapq.heappush(heap, (-now, size, g))
            continue
        # Among runs that are worth about as much on the same words, the longest says most.
        longer = max((x for _, _, x in heapq.nsmallest(40, heap) if g in x and worth(x) >= 0.9 * now), key=len, default=g)
        out.append(longer)
        used.update(words[g])
        used.update(words[longer])
    return out


def _altered(word: str, k: int) -> list[str]:
    """A word with an inserted and with a doubled character, at a place that k names."""
    i = 2 + k % max(len(word) - 2, 1)
    return [(word[:i] + "*x1"[k % 3] + word[i:])[:LENGTH], (word[:i] + word[i - 1] + word[i:])[:LENGTH]]


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-6) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton's method on the points within the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    weight = weight / weight.sum()
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-8])
    loss = lambda v: v @ ridge @ v + weight @ np.maximum(1 - y * (x @ v), 0) ** 2
    v = np.zeros(x.shape[1])
    for _ in range(60):
        near = y * (x @ v) < 1
        xa = x[near] * weight[near, None]
        step = np.linalg.solve(ridge + xa.T @ x[near], xa.T @ y[near]) - v
        size, now = 1.0, loss(v)
        while size > 1e-4 and loss(v + size * step) > now - 1e-12:
            size /= 2
        if size <= 1e-4:
            break
        v = v + size * step
    return v[:-1], float(v[-1])


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled documents; without both classes or any landmark it scores every text alike."""
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    base = (len(toxic) + 0.5) / (len(texts) + 1)
    constant = Model([], [], 0.0, [0.0] * 4, math.log(base / (1 - base)))
    if not toxic or not clean:
        return constant
    forms = lambda docs: [[normal(w)[:LENGTH] for w in words_of_text(t)] for t in docs]
    clean_bags = list(map(set, forms(clean)))
    found = find_landmarks(forms(toxic), clean_bags)
    if not found:
        return constant
    seen = defaultdict(int)
    for d in clean_bags:
        for w in d:
            seen[w] += 1
    clean_words = sorted(seen, key=lambda w: (-seen[w], w))
    landmarks = found + [w for w in clean_words if len(w) >= 5][:CLEAN_LANDMARKS]
    marks = Landmarks(landmarks)
    gram = marks.kernel(landmarks).astype(np.float64) * np.sqrt(marks.own / marks.own[:, None])
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    phi = lambda words: marks.kernel(words) @ white
    # Sentences of toxic documents with a landmark's run hold the insult; the rest of such a document says nothing.
    sentences = [[normal(w)[:LENGTH] for w in words_of_text(s)] for t in toxic for s in SENTENCE.split(t)]
    sentences = [s for s in sentences if any(g in w for w in s for g in found)]
    vocabulary = list(dict.fromkeys(w for s in sentences for w in s))
    features = phi(vocabulary)
    index = {w: i for i, w in enumerate(vocabulary)}
    witness = [next(w for w in s if any(g in w for g in found)) for s in sentences]
    everyday = clean_words[:4000] + sorted(clean_words[4000:], key=lambda w: zlib.crc32(w.encode()))[:8000]
    hard: list[str] = []
    clean_phi = phi(clean_words)
    at = {w: i for i, w in enumerate(clean_words)}
    v, b = np.zeros(len(landmarks)), 0.0
    for _ in range(3):
        times = Counter(witness)
        positive = list(times)
        changed = [x for k, w in enumerate(positive) if len(w) > 3 for x in _altered(w, k)]
        negative = list(dict.fromkeys(everyday + hard))
        x = np.concatenate([phi(positive + changed), clean_phi[[at[w] for w in negative]]])
        y = np.concatenate([np.ones(len(positive) + len(changed)), -np.ones(len(negative))])
        share = np.array([times[w] for w in positive], dtype=float) / len(witness)
        weight = np.concatenate([share, np.repeat(share[[len(w) > 3 for w in positive]], 2) / 4, np.full(len(negative), 0.5 / len(negative))])
        v, b = _hinge(x, y, weight)
        decision = features @ v
        witness = [max(s, key=lambda w: decision[index[w]]) for s in sentences]
        hard = [clean_words[i] for i in np.argsort(-(clean_phi @ v), kind="stable")[:1000].tolist()]
    model = Model(landmarks, (white @ v).tolist(), float(b), [0.0] * 4, 0.0)
    x = np.array(in_groups(texts, model.features))
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([(x - middle) / scale, np.ones((len(x), 1))], axis=1)
    y = np.array(labels, dtype=float)
    # Platt's targets and a ridge keep the weights from running off on separable data.
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    ridge = np.diag([RIDGE] * 4 + [1e-6])
    w = np.zeros(5)
    for _ in range(100):  # Newton steps of the logistic loss
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge
        w = w + np.clip(np.linalg.solve(h, z.T @ (t - p) - ridge @ w), -2, 2)
    return Model(landmarks, model.alpha.tolist(), float(b), (w[:4] / scale).tolist(), float(w[4] - (w[:4] * middle / scale).sum()))


def held_out(key: str):
    """Rows whose labels are never learnt from: the check sum of the key as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model:
    """Fit on at most per_class labelled documents of each class that aren't held out: those with the least hashes."""
    named = labels.select(F.col(key).alias("__key"), F.col(label).alias("__y")).where(F.col("__key").isNotNull() & F.col("__y").isin(0, 1)).where(~held_out("__key")).distinct()
    rank = ["__y", F.xxhash64("__key"), "__key"]
    picked = named.where("__y = 0").orderBy(*rank).limit(per_class).unionByName(named.where("__y = 1").orderBy(*rank).limit(per_class))
    # One text of each key and label, the least, so at most 2 * per_class rows whatever is repeated.
    found = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(picked), "__key").groupBy("__key", "__y").agg(F.min("__text").alias("__text")).collect()
    found = sorted((r["__key"], r["__text"], int(r["__y"])) for r in found)
    return fit([r[1] for r in found], [r[2] for r in found])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: key, held_out, score, predicted (1 from the threshold on).

    A null, empty or white-space text has no words and gets the score of an indifferent word. Every word of every
    text is scored, long words by overlapping windows; equal texts have equal scores; repeated rows stay; a null key
    stays null and isn't held out; other columns are not read, so their names can't clash; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared, name = docs.sparkSession.sparkContext.broadcast(model.parts), ("toxicity", hash(repr(model.parts)))

    def make():
        own = held(name, lambda: Model(*shared.value))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score([x or "" for x in batch.column(1).to_pylist()]), pa.float64())], ["key", "score"])

        return run

    out = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
