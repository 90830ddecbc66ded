"""Token counts (5): rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of a batch lie one after another in flat arrays of symbol ids. In each round every pre-token finds
its lowest-ranked adjacent pair and merges all its occurrences at once; pre-tokens without a known pair leave with
their number of symbols. A round's work is linear in the symbols still active, and there are at most as many rounds
as a pre-token has symbols.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genomill.llm._chunks import PLAIN, Store, flat, groups, pieces
from genomill.llm._common import held, map_arrow

NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class MergeTable:
    """The merges of a byte-level tokenizers file as sorted pair keys with ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"] for t in spec.get("added_tokens", [])}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_counts(table: MergeTable, pretokens: list[bytes]) -> np.ndarray:
    """Symbols left of each pre-token (its bytes) after all merges."""
    counts = np.zeros(len(pretokens), dtype=np.int64)
    length = np.array([len(x) for x in pretokens], dtype=np.int64)
    row = np.repeat(np.arange(len(pretokens)), length)
    sym = table.of_byte[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
    rank = np.full(len(sym), NONE)
    if len(sym) > 1:
        rank[:-1] = np.where(row[:-1] == row[1:], table.rank(sym[:-1], sym[1:]), NONE)
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        size = np.diff(np.concatenate((first, [len(sym)])))
        least = np.minimum.reduceat(rank, first)
        active = least != NONE
        if not active.all():
            done = ~active
            counts[row[first[done]]] = size[done]
            keep = np.repeat(active, size)
            sym, row, rank = sym[keep], row[keep], rank[keep]
            least, size = least[active], size[active]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        # Occurrences that overlap (a run of one symbol) merge from the left, every other one.
        new_run = np.concatenate(([True], np.diff(hit) != 1))
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        sym[hit] = table.result[rank[hit]]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        changed = np.zeros(len(sym), dtype=bool)
        changed[hit] = True
        sym, row, rank, changed = sym[keep], row[keep], rank[keep], changed[keep]
        # Only pairs that touch a new symbol have other ranks now.
        changed[:-1] |= changed[1:]
        at = np.flatnonzero(changed)
        nxt = np.minimum(at + 1, len(sym) - 1)
        joined = (at + 1 < len(sym)) & (row[at] == row[nxt])
        rank[at] = np.where(joined, table.rank(sym[at], sym[nxt]), NONE)
    return counts


class Counter:
    """Token counts of texts; distinct pieces are merged once in a task, a group of them at a time."""

    def __init__(self, path: str):
        self.table, self.pre = MergeTable(path), Tokenizer.from_file(path).pre_tokenizer
        # Added tokens count as one each and cut the text around them, as the library does by default; the longest first.
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None
        self.store = Store(self.missing)

    def pretokens(self, text: str) -> tuple[list[bytes], int]:
        """The pre-tokens of a piece, and how many added tokens stand between them."""
        of, parts = self.table.byte_of, self.special.split(text) if self.special else [text]
        return [bytes(map(of.__getitem__, s)) for x in parts if x for s, _ in self.pre.pre_tokenize_str(x)], len(parts) - 1

    def missing(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One number for each piece: its tokens. A plain word is a pre-token as it is."""
        plain = pc.match_substring_regex(words.cast(pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        number: dict[bytes, int] = {}
        refs, owner, total = [], [], np.zeros(len(words), dtype=np.int64)
        for k, (x, is_plain) in enumerate(zip(words.to_pylist(), plain.tolist(), strict=True)):
            if is_plain:
                refs.append(number.setdefault(x, len(number)))
                owner.append(k)
                continue
            found, total[k] = self.pretokens(x.decode())
            for c in found:
                refs.append(number.setdefault(c, len(number)))
                owner.append(k)
        if refs:
            np.add.at(total, owner, merge_counts(self.table, list(number))[refs])
        return total, np.ones(len(words), dtype=np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null has none."""
        raw, off = flat(texts)
        out = [np.zeros(0, np.int64)]
        for low, high in groups(off):
            words, index, first = pieces(raw[off[low] : off[high]], off[low : high + 1] - off[low], True)
            at = self.store.load(words)[index]
            each = self.store.values[at].astype(np.int64)
            out.append(np.diff(np.concatenate(([0], np.cumsum(each)))[first]))
        return np.concatenate(out)


def counter_of(path: str) -> Counter:
    """One counter for all tasks of a worker process."""
    return held(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (more than limit tokens).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys pass unchanged; other columns are not read.
    No shuffle; a task holds one Arrow batch and a bounded cache.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def make():
        counter = counter_of(tokenizer)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1)), pa.int64())], ["key", "n_tokens"])

        return run

    # The byte count is Spark's own; it rides along as part of the key's column.
    packed = docs.select(F.struct(F.col(key).alias("k"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("b")).alias("key"), F.col(text).alias("text"))
    out = map_arrow(packed, make, f"key struct<k:{key_type},b:bigint>, n_tokens long")
    return out.select(F.col("key.k").alias(key), F.col("key.b").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
