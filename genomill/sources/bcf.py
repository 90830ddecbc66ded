"""BCF2 decoded to VCF lines and written from them: typed values, dictionaries from the header, genotypes as text."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from genomill.sources.bgzf import _blocks, write_parts
from genomill.sources.vcf import Header, parse_header

MAGIC = b"BCF\x02"
INTS = {1: ("b", 1, -128), 2: ("h", 2, -32768), 3: ("i", 4, -2147483648)}
MISSING_FLOAT, END_FLOAT = 0x7F800001, 0x7F800002


def sniff(uri: str) -> str:
    """bcf, bgzf, gzip or text, by the first bytes."""
    files, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    with files.open_input_file(path) as f:
        raw = f.read(1 << 17)
        if raw[:4] != b"\x1f\x8b\x08\x04":
            return "bcf" if raw[:4] == MAGIC else "gzip" if raw[:2] == b"\x1f\x8b" else "text"
        _, data = next(_blocks(f, 0, None))
        return "bcf" if data[:4] == MAGIC else "bgzf"


class Reader:
    """Bytes of the decompressed stream, a few blocks at a time."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.held, self.at = blocks, b"", 0

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.blocks, None)
            if more is None:
                if self.at == len(self.held):
                    return b""
                raise ValueError("truncated BCF")
            self.held, self.at = self.held[self.at :] + more[1], 0
        self.at += n
        return self.held[self.at - n : self.at]


def dictionaries(lines: list[str]) -> tuple[list[str], list[str]]:
    """(strings by number: PASS, then FILTER, INFO and FORMAT in order or by IDX; contigs)."""
    strings, contigs = {0: "PASS"}, []
    for x in lines:
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<ID=([^,>]+)", x)
        if not m:
            continue
        if m[1] == "contig":
            contigs.append(m[2])
        elif m[2] not in strings.values():
            idx = re.search(r"IDX=(\d+)", x)
            strings[int(idx[1]) if idx else max(strings) + 1] = m[2]
    return [strings.get(i, "") for i in range(max(strings) + 1)], contigs


def typed(raw: bytes, at: int) -> tuple[int, int, int]:
    """(type, count, next place)."""
    kind, n = raw[at] & 15, raw[at] >> 4
    at += 1
    if n == 15:
        (n,), at = values(raw, at)
    return kind, n, at


def _items(raw: bytes, at: int, kind: int, n: int) -> list:
    """n values; None is missing, values after the end of a vector are left out."""
    if kind in INTS:
        code, size, missing = INTS[kind]
        out = struct.unpack_from(f"<{n}{code}", raw, at)
        return [None if v == missing else v for v in out if v != missing + 1]
    if kind == 5:
        bits = struct.unpack_from(f"<{n}I", raw, at)
        return [None if b == MISSING_FLOAT else struct.unpack("<f", struct.pack("<I", b))[0] for b in bits if b != END_FLOAT]
    if kind == 7:
        return [raw[at : at + n].rstrip(b"\0").decode()]
    return []


def _size(kind: int) -> int:
    return INTS[kind][1] if kind in INTS else {5: 4, 7: 1}.get(kind, 0)


def values(raw: bytes, at: int) -> tuple[list, int]:
    kind, n, at = typed(raw, at)
    return _items(raw, at, kind, n), at + n * _size(kind)


def shown(items: list) -> str:
    text = lambda v: "." if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return ",".join(map(text, items)) or "."


def genotype(items: list) -> str:
    out = ""
    for k, v in enumerate(items):
        v = v or 0
        out += ("|" if v & 1 else "/") * (k > 0) + ("." if v >> 1 == 0 else str((v >> 1) - 1))
    return out or "."


def record(shared: bytes, own: bytes, strings: list[str], contigs: list[str], samples: int) -> str:
    """One record as a VCF line."""
    rid, pos, _, qual, counts, fmt = struct.unpack_from("<iiiIII", shared)
    n_info, n_allele, n_fmt = counts & 0xFFFF, counts >> 16, fmt >> 24
    (name, at) = values(shared, 24)
    alleles = []
    for _ in range(n_allele):
        a, at = values(shared, at)
        alleles.append(a[0] if a else ".")
    filters, at = values(shared, at)
    info = []
    for _ in range(n_info):
        (key,), at = values(shared, at)
        v, at = values(shared, at)
        info.append(strings[key] + (f"={shown(v)}" if v else ""))
    q = "." if qual == MISSING_FLOAT else f"{struct.unpack('<f', struct.pack('<I', qual))[0]:.6g}"
    fields = [contigs[rid], str(pos + 1), (name[0] if name and name[0] else "."), alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", q, ";".join(strings[f] for f in filters) or ".", ";".join(info) or "."]
    keys, cells, at = [], [[] for _ in range(samples)], 0
    for _ in range(n_fmt):
        (key,), at = values(own, at)
        kind, n, at = typed(own, at)
        keys.append(strings[key])
        for cell in cells:
            items = _items(own, at, kind, n)
            cell.append(genotype(items) if strings[key] == "GT" else (items[0] or "." if kind == 7 and items else shown(items)))
            at += n * _size(kind)
    return "\t".join([*fields, *([":".join(keys)] if samples else []), *(":".join(c) for c in cells)])


def _open(uri: str):
    files, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return files.open_input_file(path)


def _start(reader: Reader) -> Header:
    if reader.read(5)[:4] != MAGIC:
        raise ValueError("not a BCF2 file")
    (n,) = struct.unpack("<I", reader.read(4))
    return parse_header(reader.read(n).rstrip(b"\0").decode().rstrip("\n").split("\n"))


def read_lines(spark: SparkSession, uri: str) -> tuple[DataFrame, Header]:
    """(ordinal, value) and the header. A record can only be found from the one before it, so a file is one task."""
    with _open(uri) as f:
        header = _start(Reader(_blocks(f, 0, None)))
    strings, contigs = dictionaries(list(header.lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with _open(uri) as f:
                reader = Reader(_blocks(f, 0, None))
                _start(reader)
                n, held = 0, []
                while head := reader.read(8):
                    a, b = struct.unpack("<II", head)
                    held.append(record(reader.read(a), reader.read(b), strings, contigs, len(header.samples)))
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(held)), pa.int64()), pa.array(held)], ["ordinal", "value"])
                        n, held = n + len(held), []
                yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(held)), pa.int64()), pa.array(held, pa.string())], ["ordinal", "value"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "ordinal long, value string"), header


def _typed(kind: int, n: int, data: bytes) -> bytes:
    return (bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _ints([n])) + data


def _width(numbers: list[int | None]) -> int:
    """The least type that holds the numbers beside its marks for missing values and ends."""
    some = [x for x in numbers if x is not None]
    low, high = min(some, default=0), max(some, default=0)
    return next(k for k, (_, size, _) in INTS.items() if size == 4 or -(1 << 8 * size - 1) + 8 <= low and high < 1 << 8 * size - 1)


def _packed(numbers: list[int | None], kind: int, n: int) -> bytes:
    code, _, missing = INTS[kind]
    return struct.pack(f"<{n}{code}", *(missing if x is None else x for x in numbers), *[missing + 1] * (n - len(numbers)))


def _ints(numbers: list[int | None]) -> bytes:
    kind = _width(numbers)
    return _typed(kind, len(numbers), _packed(numbers, kind, len(numbers)))


def _bits(x: float | None) -> int:
    return MISSING_FLOAT if x is None else struct.unpack("<I", struct.pack("<f", x))[0]


def _text(x: str) -> bytes:
    return _typed(7, len(x.encode()), x.encode())


def _number(x: str, of: type) -> int | float | None:
    return None if x in (".", "") else of(x)


class Encoder:
    """VCF lines to BCF2 records under a header, which must name all that the lines use."""

    def __init__(self, header: list[str]):
        strings, contigs = dictionaries(header)
        self.strings, self.contigs = {x: i for i, x in enumerate(strings)}, {x: i for i, x in enumerate(contigs)}
        self.kinds = {(m[1], m[2]): m[3] for x in header if (m := re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),.*?Type=(\w+)", x))}
        text = ("\n".join(header) + "\n").encode() + b"\0"
        self.head = MAGIC + b"\x02" + struct.pack("<I", len(text)) + text

    def _info(self, item: str) -> bytes:
        key, given, value = item.partition("=")
        kind = self.kinds.get(("INFO", key), "String")
        out = _ints([self.strings[key]])
        if not given:
            return out + b"\0"
        if kind == "Integer":
            return out + _ints([_number(x, int) for x in value.split(",")])
        if kind == "Float":
            xs = [_bits(_number(x, float)) for x in value.split(",")]
            return out + _typed(5, len(xs), struct.pack(f"<{len(xs)}I", *xs))
        return out + _text(value)

    def _format(self, key: str, cells: list[str]) -> bytes:
        out, kind = _ints([self.strings[key]]), self.kinds.get(("FORMAT", key), "String")
        if key == "GT":
            each = []
            for x in cells:
                parts = re.split(r"([/|])", x)
                each.append([(0 if a == "." else int(a) + 1 << 1) | (k > 0 and parts[2 * k - 1] == "|") for k, a in enumerate(parts[::2])])
        elif kind == "Integer":
            each = [[_number(v, int) for v in x.split(",")] for x in cells]
        elif kind == "Float":
            each = [[_bits(_number(v, float)) for v in x.split(",")] for x in cells]
            n = max(map(len, each))
            return out + _typed(5, n, b"".join(struct.pack(f"<{n}I", *x, *[END_FLOAT] * (n - len(x))) for x in each))
        else:
            raw = [x.encode() for x in cells]
            n = max(map(len, raw))
            return out + _typed(7, n, b"".join(x.ljust(n, b"\0") for x in raw))
        n, width = max(map(len, each)), _width([v for x in each for v in x])
        return out + _typed(width, n, b"".join(_packed(x, width, n) for x in each))

    def record(self, line: str) -> bytes:
        c = line.split("\t")
        alleles = [c[3], *(c[4].split(",") if c[4] != "." else [])]
        filters = [] if c[6] == "." else [self.strings[x] for x in c[6].split(";")]
        info = [] if c[7] == "." else c[7].split(";")
        keys = c[8].split(":") if len(c) > 9 else []
        # Fields that a cell leaves out at its end are missing.
        cells = [x.split(":") + ["."] * len(keys) for x in c[9:]]
        shared = struct.pack("<iiiIII", self.contigs[c[0]], int(c[1]) - 1, len(c[3]), _bits(_number(c[5], float)), len(info) | len(alleles) << 16, len(c[9:]) | len(keys) << 24)
        shared += _text(c[2]) + b"".join(map(_text, alleles)) + (_ints(filters) if filters else b"\0") + b"".join(map(self._info, info))
        own = b"".join(self._format(key, [x[k] for x in cells]) for k, key in enumerate(keys))
        return struct.pack("<II", len(shared), len(own)) + shared + own


def write_records(lines: DataFrame, header: list[str], uri: str) -> list[str]:
    """VCF lines (ordinal, line) in order as a BCF2 file in parts, which their concatenation makes one."""
    encoder = Encoder(header)
    return write_parts(lines, uri, encoder.head, lambda xs: b"".join(map(encoder.record, xs)))
