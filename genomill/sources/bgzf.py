"""Blocked gzip: deterministic blocks, split reading and parallel writing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65280
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
EOF = HEAD + b"\x1b\0\x03\0" + b"\0" * 8


def block(data: bytes) -> bytes:
    """One block of at most BLOCK bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) + 26 > 65536:  # data that doesn't shrink is stored
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    return HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(raw: bytes, at: int = 0) -> int:
    """Whole size of the block that begins at `at`, 0 if none does."""
    if raw[at : at + 4] != HEAD[:4] or raw[at + 12 : at + 16] != b"BC\x02\0" or len(raw) < at + 18:
        return 0
    return struct.unpack_from("<H", raw, at + 16)[0] + 1


def inflate(raw: bytes, at: int, size: int) -> bytes:
    data = zlib.decompress(raw[at + 18 : at + size - 8], -15)
    if struct.unpack_from("<I", raw, at + size - 8)[0] != zlib.crc32(data):
        raise ValueError("block checksum differs")
    return data


def _blocks(f, low: int, high: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the blocks from the first that begins at or after low, to the end of the file."""
    size = f.size()
    f.seek(low)
    raw, base, at = f.read(1 << 20), low, 0
    if low:  # the next block begins where a header is followed by another at its stated size
        while True:
            at = raw.find(HEAD[:4], at)
            if at < 0 or at + 65536 + 18 > len(raw) and base + len(raw) < size:
                more = f.read(1 << 20)
                if not more:
                    return
                raw += more
                at = max(at, 0)
                continue
            n = block_size(raw, at)
            if n and (base + at + n == size or block_size(raw, at + n)):
                break
            at += 1
    while base + at < size:
        if len(raw) - at < 65536 and base + len(raw) < size:
            base, raw, at = base + at, raw[at:] + f.read(1 << 20), 0
        n = block_size(raw, at)
        if not n or at + n > len(raw):
            raise ValueError("truncated block")
        yield base + at, inflate(raw, at, n)
        at += n


def range_lines(uri: str, low: int, high: int, skip: int | None = None) -> Iterator[str]:
    """Lines that begin in blocks which begin in [low, high); a line may end in a later block.

    With skip a line is known to begin so many bytes behind the start of the first block, and is the first.
    """
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        rest, first = b"", low == 0
        for at, data in _blocks(f, low, high):
            if skip is not None:
                data, first, skip = data[skip:], True, None
            if not first:  # the line that is under way belongs to the range before
                cut = data.find(b"\n")
                if cut < 0:
                    if at >= high:
                        return
                    continue
                data, first = data[cut + 1 :], True
                if at >= high:
                    return
            if at >= high:
                cut = data.find(b"\n")
                rest += data if cut < 0 else data[:cut]
                if cut < 0:
                    continue
                if rest:
                    yield rest.decode().rstrip("\r")
                return
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            yield from (x.decode().rstrip("\r") for x in lines)
        if rest:
            yield rest.decode().rstrip("\r")


def read_lines(spark: SparkSession, uri: str, split: int = 16 << 20, chunks: list[tuple[int, int]] | None = None) -> DataFrame:
    """ordinal, value of all lines of a block-gzipped file, read in byte ranges at once; ordinal is in file order.

    With chunks (virtual offsets in order, blocks apart) only their blocks are read; lines near a chunk's end may be more.
    """
    files, path = pafs.FileSystem.from_uri(uri)
    size = files.get_file_info(path).size
    ranges = []
    for begin, end in [(0, size << 16)] if chunks is None else chunks:
        low, stop = begin >> 16, min((end >> 16) + 1, size)
        ranges += [(at, min(at + split, stop), (begin & 0xFFFF) if at == low else None) for at in range(low, stop, split)]
    ranges = [(k, *r) for k, r in enumerate(ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, low, high, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, held = 0, []
                for line in range_lines(uri, low, high, skip):
                    held.append(line)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(range((k << 33) + n, (k << 33) + n + len(held)), pa.int64()), pa.array(held)], ["ordinal", "value"])
                        n, held = n + len(held), []
                yield pa.RecordBatch.from_arrays([pa.array(range((k << 33) + n, (k << 33) + n + len(held)), pa.int64()), pa.array(held, pa.string())], ["ordinal", "value"])

    return spark.createDataFrame(ranges, "k long, low long, high long, skip long").repartitionByRange(max(len(ranges), 1), "k").mapInArrow(run, "ordinal long, value string")


def write_parts(lines: DataFrame, uri: str, head: bytes, pack: Callable[[list[str]], bytes]) -> list[str]:
    """Lines (ordinal, line) in order, packed to bytes, as part files of blocks in a folder; their concatenation is one legal file.

    The head is the first part and the end mark the last. Parts are written beside their names and renamed.
    """
    files, base = pafs.FileSystem.from_uri(uri)
    files.create_dir(base, recursive=True)

    def put(name: str, chunks: Iterator[bytes], attempt: str) -> None:
        with files.open_output_stream(f"{base}/.{name}.{attempt}") as out:
            held = b""
            for x in chunks:
                held += x
                while len(held) >= BLOCK:
                    out.write(block(held[:BLOCK]))
                    held = held[BLOCK:]
            if held:
                out.write(block(held))
        files.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chunks = f"part-{TaskContext.get().partitionId() + 1:06d}", (pack(b.column(0).to_pylist()) for b in batches if b.num_rows)
        first = next(chunks, None)
        if first is not None:

            def every() -> Iterator[bytes]:
                yield first
                yield from chunks

            put(name, every(), str(TaskContext.get().taskAttemptId()))
            yield pa.RecordBatch.from_pydict({"name": [name]})

    put("part-000000", iter([head]), "driver")
    names = [r.name for r in lines.orderBy("ordinal").select("line").mapInArrow(run, "name string").collect()]  # a row for each part
    last = "part-999999"
    with files.open_output_stream(f"{base}/{last}") as out:
        out.write(EOF)
    return ["part-000000", *sorted(names), last]


def write_lines(lines: DataFrame, header: list[str], uri: str) -> list[str]:
    """Lines (ordinal, line) in order as block-gzipped text."""
    return write_parts(lines, uri, ("\n".join(header) + "\n").encode(), lambda xs: ("\n".join(xs) + "\n").encode())
