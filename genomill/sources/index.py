"""Index files beside block-gzipped VCF: the parts of a file that can hold the records of a region (TBI and CSI)."""

from __future__ import annotations

import logging
import struct
from collections.abc import Iterable
from dataclasses import dataclass

from pyarrow import fs as pafs

from genomill.sources.bgzf import _blocks

#: Bytes of a block at most; parts of the file that are nearer to each other than that are read as one.
MOST_OF_BLOCK = 1 << 16
LINEAR_SHIFT, LINEAR_DEPTH = 14, 5


@dataclass
class Sequence:
    """Chunks of virtual offsets by bin, and what tells where records from a place on begin."""

    bins: dict[int, list[tuple[int, int]]]
    firsts: dict[int, int]  # by bin (CSI)
    linear: tuple[int, ...]  # by 16 KiB of the sequence (TBI)


@dataclass
class Index:
    """A parsed index."""

    shift: int
    depth: int
    sequences: dict[str, Sequence]

    def bins_of(self, low: int, high: int) -> Iterable[int]:
        """Numbers of all bins that overlap the 0-based [low, high), the smallest bins last."""
        first = 0
        for level in range(self.depth + 1):
            width = self.shift + 3 * (self.depth - level)
            yield from range(first + (low >> width), first + ((high - 1) >> width) + 1)
            first += 1 << 3 * level

    def least_offset(self, own: Sequence, low: int) -> int:
        """No record that reaches past low begins before this offset."""
        if own.linear:
            return own.linear[min(low >> LINEAR_SHIFT, len(own.linear) - 1)]
        at = ((1 << 3 * self.depth) - 1) // 7 + (low >> self.shift)
        while at not in own.firsts and at:
            at = (at - 1) >> 3  # the bin around it
        return own.firsts.get(at, 0)

    def ranges(self, chrom: str, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """Chunks (virtual offsets) that hold every record of the chromosome which starts at positions low to high."""
        own = self.sequences.get(chrom)
        if own is None:
            return []
        begin, most = max((low or 1) - 1, 0), 1 << (self.shift + 3 * self.depth)
        end = min(most if high is None else high, most)
        if begin >= end:
            return []
        least = self.least_offset(own, begin)
        asked = set(self.bins_of(begin, end)) if high is not None or low else own.bins.keys()
        pseudo = ((1 << 3 * (self.depth + 1)) - 1) // 7 + 1  # holds counts, no chunks
        return merged((max(a, least), b) for k in asked if k in own.bins and k != pseudo for a, b in own.bins[k] if b > least)


def merged(chunks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those whose blocks touch or nearly touch as one, so that no line is in two."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= (out[-1][1] >> 16) + MOST_OF_BLOCK:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class _Fields:
    """Little-endian numbers one after another."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def chunks(self, n: int) -> list[tuple[int, int]]:
        flat = self.take(f"{2 * n}Q")
        return list(zip(flat[::2], flat[1::2], strict=True))


def _names(fields: _Fields) -> list[str]:
    *_, size = fields.take("7i")
    (raw,) = fields.take(f"{size}s")
    return [x.decode() for x in raw.rstrip(b"\0").split(b"\0")] if raw.strip(b"\0") else []


def parse(raw: bytes) -> Index:
    """An index from its unpacked bytes."""
    fields = _Fields(raw)
    (magic,) = fields.take("4s")
    try:
        if magic == b"TBI\1":
            (count,) = fields.take("i")
            names, shift, depth = _names(fields), LINEAR_SHIFT, LINEAR_DEPTH
        elif magic == b"CSI\1":
            shift, depth, extra = fields.take("3i")
            if not extra:
                raise ValueError("an index without names of sequences")
            stop = fields.at + extra
            names = _names(fields)
            fields.at = stop
            (count,) = fields.take("i")
        else:
            raise ValueError("not an index file")
        if count != len(names):
            raise ValueError("an index with other numbers of sequences and names")
        sequences = {}
        for name in names:
            bins, firsts = {}, {}
            (n,) = fields.take("i")
            for _ in range(n):
                if magic == b"CSI\1":
                    number, first, many = fields.take("IQi")
                    firsts[number] = first
                else:
                    number, many = fields.take("Ii")
                bins[number] = fields.chunks(many)
            linear = fields.take(f"{fields.take('i')[0]}Q") if magic == b"TBI\1" else ()
            sequences[name] = Sequence(bins, firsts, linear)
    except struct.error as e:
        raise ValueError("truncated index") from e
    return Index(shift, depth, sequences)


def beside(uri: str) -> Index | None:
    """The index beside a file, CSI before TBI: one that is not older than the file, can be read, and points into it."""
    files, path = pafs.FileSystem.from_uri(uri)
    data = files.get_file_info(path)
    for kind in (".csi", ".tbi"):
        info = files.get_file_info(path + kind)
        if info.type != pafs.FileType.File:
            continue
        try:
            if info.mtime_ns is not None and data.mtime_ns is not None and info.mtime_ns < data.mtime_ns:
                raise ValueError("older than the file")
            with files.open_input_file(path + kind) as f:
                found = parse(b"".join(x for _, x in _blocks(f, 0, None)))
            if any(b >> 16 > data.size for s in found.sequences.values() for c in s.bins.values() for _, b in c[:1]):
                raise ValueError("it points past the file's end")
            return found
        except ValueError as e:
            logging.getLogger("genomill").warning("index %s not used: %s", path + kind, e)
    return None
