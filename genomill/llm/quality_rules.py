"""Quality rules (1): a short-circuit cascade in an order estimated on a sample, in DataFrame functions only.

Each rule is one Boolean expression over the base features. On a bounded sample the rejections of each rule are
counted and its evaluation is timed; the rules then stand in a conjunction by rejections per second, so most bad
documents are decided by the first tests and the later ones aren't evaluated for them. The order never changes a
verdict. There is no shuffle: every document is decided within its row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.llm._common import checkpoint, own, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
SAMPLE_ROWS = 1000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A document passes when the column that passes() builds is true; it may use BASE, text, words and n_lines."""

    name: str
    passes: Callable[[], Column]


def _removed(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def default_rules() -> list[Rule]:
    """Limits found on labelled documents: clean ones lie far from each."""
    c = F.col
    repeats = lambda: F.size(F.filter(F.zip_with(F.expr("slice(words, 2, greatest(n_words - 1, 0))"), F.expr("slice(words, 1, greatest(n_words - 1, 0))"), lambda a, b: a == b), lambda x: x))
    return [
        Rule("symbols", lambda: 10 * c("n_symbols") <= c("n_words")),
        Rule("duplicate_lines", lambda: 2 * c("n_dup_lines") <= c("n_lines")),
        Rule("word_length", lambda: (2 * c("word_chars") >= 5 * c("n_words")) & (c("word_chars") <= 14 * c("n_words"))),
        Rule("capitals", lambda: 10 * _removed("text", r"\p{Lu}") <= 3 * F.length("text")),
        Rule("exclamations", lambda: 10 * _removed("text", "!") <= 3 * c("n_words")),
        Rule("stutter", lambda: 10 * repeats() <= 3 * c("n_words")),
        Rule("letters", lambda: 2 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) >= c("n_words")),
    ]


def _shifted(array: str, by: int) -> tuple[Column, Column]:
    """The array without its last and without its first by elements."""
    return F.expr(f"slice({array}, 1, greatest(size({array}) - {by}, 0))"), F.expr(f"slice({array}, {by + 1}, greatest(size({array}) - {by}, 0))")


def base_features(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """__row (a struct of docs' columns), __text, __words, __n_lines and the BASE columns (long) with a leading __.

    The row is packed first, so no own column clashes. A null text counts as empty: all zero. Windows are compared by
    64-bit hashes chained over their words.
    """
    df = docs.select(F.struct(*map(own, docs.columns)).alias("__row"), F.coalesce(own(text), F.lit("")).alias("__text")).withColumn("__words", words_of(F.col("__text")))
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for by in (1, 2, 4):
        df = df.withColumn("__h", F.zip_with(*_shifted("__h", by), lambda a, b: F.xxhash64(a, b)))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__line": lines, "__twice": F.size(F.array_distinct("__h")) < F.size("__h")})
    # Only documents with some repeated window sort theirs; equal neighbours are the repeated ones.
    df = df.withColumn("__s", F.when(F.col("__twice"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, k: e["x"].eqNullSafe(F.expr("__s")[k]["x"])
    last = F.size("__s") - 1
    flagged = F.filter("__s", lambda e, k: (F.when(k > 0, same(e, F.greatest(k - 1, F.lit(0)))).otherwise(False)) | (F.when(k < last, same(e, F.least(k + 1, last))).otherwise(False)))
    df = df.withColumn("__at", F.sort_array(F.transform(flagged, lambda e: e["i"])))
    gaps = F.aggregate(F.zip_with(*_shifted("__at", 1), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda t, x: t + x)
    return df.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": _removed("__text", SYMBOLS).cast("long"),
            "__n_dup_lines": (F.size("__line") - F.size(F.array_distinct("__line"))).cast("long"),
            "__n_repeat_words": F.when(F.col("__twice"), gaps + WINDOW).otherwise(0).cast("long"),
            "__n_lines": F.size("__line").cast("long"),
        }
    ).drop("__h", "__s", "__at", "__twice", "__line")


def _plain(df: DataFrame) -> DataFrame:
    """The rules' view of the features: only their names, so the document's own columns can't clash."""
    return df.select(F.col("__text").alias("text"), F.col("__words").alias("words"), F.col("__n_lines").alias("n_lines"), *(F.col(f"__{x}").alias(x) for x in BASE))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per second on a sample of about sample_rows rows; on a tie, or without rows, by their names."""
    rows = docs.count()
    if not rows or len(rules) < 2:
        return sorted(rules, key=lambda r: r.name)
    share = min(1.0, sample_rows / rows)
    picked = docs.select(own(text).alias("text")).sample(share, seed).limit(2 * sample_rows)
    sample = checkpoint(_plain(base_features(picked))).where(~base_failed())
    reject = sample.agg(*(F.count_if(~r.passes()).alias(r.name) for r in rules)).first().asDict()
    cost = {}
    for r in rules:
        runs = []
        for _ in range(2):  # the first also compiles
            began = time.perf_counter()
            sample.agg(F.count_if(r.passes())).collect()
            runs.append(time.perf_counter() - began)
        cost[r.name] = max(runs[-1], 1e-6)
    return sorted(rules, key=lambda r: (-reject[r.name] / cost[r.name], r.name))


def judge(docs: DataFrame, *, text: str = "text", name: str = "quality", rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' columns and the column name: a struct of BASE, base_failed and kept.

    kept is false for a document that fails the base limits or any rule. A null, empty or white-space text has no
    words and fails. Repeated rows and ties each get their own, equal verdicts; a text of any length is judged as a
    whole; an empty table stays empty. Own columns of any name stay as they are, but none may be called name.
    """
    names = docs.columns
    if name in names:
        raise ValueError(f"there is a column {name} already")
    ordered = order_rules(docs, rules or default_rules(), text=text, sample_rows=sample_rows)
    df = base_features(docs, text=text)
    view = {"text": "__text", "words": "__words", "n_lines": "__n_lines"} | {x: f"__{x}" for x in BASE}
    # One struct holds everything the rules see; withField-free, so Catalyst prunes what isn't asked for.
    # A filter on kept must not be pushed below the features, where each use would compute them again; no filter
    # passes a projection with a nondeterministic column that it needs.
    seen = df.select("__row", *(F.col(v).alias(k) for k, v in view.items()), F.monotonically_increasing_id().alias("__stay"))
    seen = seen.withColumn("base_failed", base_failed())
    kept = reduce(lambda a, b: a & b, [r.passes() for r in ordered], (F.col("__stay") >= 0) & ~F.col("base_failed"))
    quality = F.struct(*BASE, "base_failed", kept.alias("kept")).alias("__quality")
    return seen.select("__row", quality).select(*(F.col("__row").getField(n).alias(n) for n in names), F.col("__quality").alias(name))


def verdicts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, the base features, base_failed and kept."""
    out = judge(docs.select(own(key).alias("key"), own(text).alias("text")), name="quality")
    return out.select(F.col("key").alias(key), *(F.col(f"quality.{x}").alias(x) for x in [*BASE, "base_failed", "kept"]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.text, d.w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
g AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= len(lines) AND 2 * word_chars >= 5 * n_words AND word_chars <= 14 * n_words
  AND 10 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) <= 3 * length(text)
  AND 10 * (length(text) - length(replace(text, '!', ''))) <= 3 * n_words
  AND 10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) <= 3 * n_words
  AND 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) >= n_words AS kept
FROM g
"""
