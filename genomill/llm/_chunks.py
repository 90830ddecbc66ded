"""Cutting texts where a byte-pair tokenizer must cut them too, so that each distinct piece is encoded once in a task.

A space that follows a non-space and precedes a non-space starts a pre-token of a byte-level tokenizer, and a single
line feed between two non-spaces is a pre-token of its own; a letter and a mark behind it are never in one pre-token.
Between such places nothing is merged, so a text's ids are the concatenation of its pieces' ids. A text with other white space is one piece. Cuts are found on Arrow's flat
bytes, Arrow numbers the distinct pieces, and only these become Python objects; all ids are then gathered at once.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from genomill.llm._common import held

# Spark runs a worker on each core; the library's own threads would only get in their way.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that a worker keeps, and bytes of text that are worked on at once.
ENTRIES, GROUP_BYTES = 700_000, 8_000_000
#: Letters that no normalizer of these tokenizers turns into several: one pre-token a word, with the space before it.
PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Marks that make one pre-token together when nothing else is between them.
MARKS = b".,;:!?#*$%&<>()|"
WORDS_AT_ONCE = 2000


def of_bytes(which: bytes) -> np.ndarray:
    """For each byte whether it is one of these."""
    out = np.zeros(256, dtype=bool)
    out[list(which)] = True
    return out


IS_MARK, IS_LETTER = of_bytes(MARKS), of_bytes(bytes(x for x in range(128) if chr(x).isalpha()))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, their offsets); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP_BYTES, as (first, end) numbers."""
    low, n = 0, len(off) - 1
    while low < n:
        high = min(max(int(np.searchsorted(off, off[low] + GROUP_BYTES, "right")) - 1, low + 1), n)
        yield low, high
        low = high


def irregular(raw: np.ndarray, off: np.ndarray, white: np.ndarray, spaces: bool) -> np.ndarray:
    """Numbers of the texts that can't be cut: with special marks or (spaces) white space other than single spaces and line feeds inside."""
    lead = np.flatnonzero(raw == ord("<"))
    lead = lead[lead + 1 < len(raw)]
    bad = [lead[raw[lead + 1] == ord("|")]]
    if not spaces:
        return np.unique(np.searchsorted(off, bad[0], "right") - 1)
    bad += [white[1:][np.diff(white) == 1], np.flatnonzero((raw < 32) & (raw != 10))]
    # White space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    wide = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    wide = wide[wide + 1 < len(raw)]
    if len(wide):
        a, b, c = raw[wide], raw[wide + 1], raw[np.minimum(wide + 2, len(raw) - 1)]
        space = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        space |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        bad.append(wide[space])
    some = np.flatnonzero(off[1:] > off[:-1])
    ends = np.concatenate((off[:-1][some], off[1:][some] - 1))
    bad.append(ends[(raw[ends] == 32) | (raw[ends] == 10)])
    return np.unique(np.searchsorted(off, np.concatenate(bad), "right") - 1)


def pieces(raw: np.ndarray, off: np.ndarray, spaces: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of each piece's distinct one, first piece of each text and the end) of texts in flat bytes.

    The pieces of a text are its bytes without gaps: words with the space before them, marks behind a word, and line
    feeds. checked leaves irregular texts whole.
    """
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    feed = raw == 10
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[:-1] = feed | (raw == 32)
    white = np.flatnonzero(cut)
    cut[1:] |= feed
    mark = np.flatnonzero(IS_MARK[raw[1:]]) + 1
    before = raw[mark - 1]
    accented = (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & (raw[np.maximum(mark - 2, 0)] == 0xC3)
    cut[mark[IS_LETTER[before] | accented]] = True
    for k in irregular(raw, off, white, spaces).tolist():
        cut[off[k] : off[k + 1]] = False
    cut[off] = True
    at = np.flatnonzero(cut)
    each = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    numbered = each.dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(), np.searchsorted(at, off)


def in_groups(texts: list[str], f: Callable[[list[str]], list]) -> list:
    """f of the texts, called for groups of about GROUP_BYTES characters so that what it makes of them stays small."""
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            out += f(group)
            group, size = [], 0
    return out + f(group) if group else out


class Store:
    """Values (runs of numbers) of pieces seen; all are forgotten when there are many, so a task's memory stays bounded."""

    def __init__(self, find: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES):
        """find gives the values of pieces one after another, and how many each has."""
        self.find, self.entries = find, entries
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.start, self.size, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def load(self, words: pa.Array) -> np.ndarray:
        """Slots of the distinct pieces; missing ones are found first."""
        keys = words.to_pylist()
        at = np.fromiter(map(self.slot.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing) and self.slot and len(self.slot) + len(missing) > self.entries:
            self.clear()
            missing = np.arange(len(keys))
        if len(missing):
            new = words.take(pa.array(missing))
            values, size = self.find(new)
            first = len(self.start)
            self.start = np.concatenate((self.start, len(self.values) + np.cumsum(size) - size))
            self.size, self.values = np.concatenate((self.size, size)), np.concatenate((self.values, values.astype(np.uint32)))
            self.slot.update(zip(new.to_pylist(), range(first, first + len(new)), strict=True))
            at[missing] = np.arange(first, first + len(new))
        return at


def put_together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of n pieces in order, from parts (numbers of pieces, their sizes, their values)."""
    size = np.zeros(n, dtype=np.int64)
    for which, own, _ in parts:
        size[which] = own
    start, out = np.cumsum(size) - size, np.zeros(int(size.sum()), dtype=np.int64)
    for which, own, values in parts:
        out[np.arange(len(values)) + np.repeat(start[which] - (np.cumsum(own) - own), own)] = values
    return out, size


class Encoder:
    """Ids that the tokenizers library gives for texts; distinct plain words are encoded many at a time in one joined text."""

    spaces = True

    def __init__(self, path: str):
        self.library, self.store = Tokenizer.from_file(path), Store(self.missing)
        self.vocab = json.loads(self.library.to_str())["model"]["vocab"]
        self.size = max(self.vocab.values()) + 1

    def one(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def joined(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)

    def marked(self, which: Callable[[str], bool]) -> np.ndarray:
        """For each id whether its symbol is such a one."""
        out = np.zeros(self.size, dtype=bool)
        out[[i for s, i in self.vocab.items() if which(s)]] = True
        return out

    def kinds(self, words: pa.Array) -> list[tuple[np.ndarray, Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None]]]:
        """Numbers of plain pieces with what encodes a list of such (to ids and their counts; None if that can't be told)."""
        raise NotImplementedError

    def missing(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece."""
        words = words.cast(pa.string())
        parts, single = [], np.ones(len(words), dtype=bool)
        for which, together in self.kinds(words):
            for low in range(0, len(which), WORDS_AT_ONCE):
                some = which[low : low + WORDS_AT_ONCE]
                got = together(words.take(pa.array(some)).to_pylist())
                if got is not None:
                    single[some] = False
                    parts.append((some, got[1], got[0]))
        rest = np.flatnonzero(single)
        each = [self.one(x) for x in words.take(pa.array(rest)).to_pylist()]
        parts.append((rest, np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(itertools.chain.from_iterable(each), np.int64)))
        return put_together(parts, len(words))

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of a run of texts one after another, each with the end id if there is one; bounds of each text's), in order."""
        raw, off = flat(texts)
        for low, high in groups(off):
            own = off[low : high + 1] - off[low]
            words, index, first = pieces(raw[off[low] : off[high]], own, self.spaces)
            at = self.store.load(words)[index]
            size = self.store.size[at]
            total = np.concatenate(([0], np.cumsum(size)))
            more = np.arange(len(own)) if end is not None else np.zeros(len(own), np.int64)
            bounds = total[first] + more
            take = np.arange(total[-1]) + np.repeat(self.store.start[at] - total[:-1], size)
            ids = self.store.values[take]
            if end is not None:
                out = np.empty(int(bounds[-1]), dtype=np.uint32)
                ends = np.zeros(len(out), dtype=bool)
                ends[bounds[1:] - 1] = True
                out[ends], out[~ends] = end, ids
                ids = out
            yield ids, bounds


def runs(ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """ids and the length of each of n runs that begin at first; None if there aren't n."""
    return (ids, np.diff(first, append=len(ids))) if len(first) == n and (not n or first[0] == 0) else None


class ByteLevelEncoder(Encoder):
    """For a byte-level file without a prefix space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.starts, self.feed = self.marked(lambda s: s[0] == "Ġ"), self.vocab["Ċ"]

    def kinds(self, words: pa.Array) -> list:
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        spaced = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
        return [(np.flatnonzero(plain & spaced), self.spaced), (np.flatnonzero(plain & ~spaced), self.bare)]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self.joined("".join(words))
        return runs(ids, np.flatnonzero(self.starts[ids]), len(words))

    def bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self.joined("\n".join(words))
        feeds = np.flatnonzero(ids == self.feed)
        return runs(np.delete(ids, feeds), np.concatenate(([0], feeds - np.arange(len(feeds)))), len(words))


class WordEncoder(Encoder):
    """For a word-end file, which drops white space, so every cut at a space or line feed is safe."""

    spaces = False

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = self.marked(lambda s: s.endswith("</w>"))

    def kinds(self, words: pa.Array) -> list:
        return [(np.flatnonzero(pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)), self.words)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self.joined(" ".join(words))
        ends = np.flatnonzero(self.ends[ids])
        return runs(ids, np.concatenate(([0], ends[:-1] + 1)), len(words)) if len(ends) and ends[-1] == len(ids) - 1 else None


def byte_level(path: str) -> ByteLevelEncoder:
    """One encoder for all tasks of a worker process."""
    return held(("byte", path), lambda: ByteLevelEncoder(path))


def word_level(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return held(("word", path), lambda: WordEncoder(path))
