import gzip
import os
import random
import struct

import pytest

from genomill.cli import main
from genomill.engine import CallSet
from genomill.sources import bcf, bgzf, index
from genomill.spec import QuerySpec
from genomill.streaming.site_stream import stream_sites
from tests.inputs import random_calls, read, vcf


def big_vcf(n: int = 6000) -> str:
    rng = random.Random(5)
    return vcf("A B C", *(f"chr{1 + i * 3 // n} {i + 1} . A C {rng.randint(1, 99)} PASS . GT:DP " + " ".join(f"{rng.randint(0, 1)}/{rng.randint(0, 1)}:{rng.randint(1, 9)}" for _ in range(3)) for i in range(n)))


def blocks(text: str) -> bytes:
    data = text.encode()
    return b"".join(bgzf.block(data[k : k + 5000]) for k in range(0, len(data), 5000)) + bgzf.EOF


def test_plain_gzip_and_blocks_read_alike(spark, tmp_path):
    text = big_vcf()
    (tmp_path / "a.vcf").write_text(text.replace("\n", "\r\n"))
    (tmp_path / "b.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.gz").write_bytes(blocks(text))
    assert gzip.decompress((tmp_path / "c.gz").read_bytes()).decode() == text
    want = None
    for name in ("a.vcf", "b.gz", "c.gz"):
        calls = CallSet.detect(spark, f"file://{tmp_path / name}")
        got = sorted((r.chrom, r.pos, tuple(r["count"])) for r in calls.kept(QuerySpec()).output("counts", QuerySpec()).collect())
        want = want or got
        assert got == want and len(got) == 6000 and calls.samples == ["A", "B", "C"]


def test_ranges_of_blocks_hold_each_line_once(tmp_path):
    text = big_vcf(3000)
    path = tmp_path / "c.gz"
    path.write_bytes(blocks(text))
    size = path.stat().st_size
    for split in (700, 4096, 10**9):
        got = [x for low in range(0, size, split) for x in bgzf.range_lines(f"file://{path}", low, min(low + split, size))]
        assert got == text.rstrip("\n").split("\n")


def test_truncated_blocks_fail(tmp_path):
    path = tmp_path / "c.gz"
    path.write_bytes(blocks(big_vcf(3000))[:-60])
    with pytest.raises(Exception):  # noqa: B017
        list(bgzf.range_lines(f"file://{path}", 0, path.stat().st_size))


def bin_of(low: int, high: int, shift: int, depth: int) -> int:
    """The smallest bin that holds all of [low, high)."""
    for level in range(depth, -1, -1):
        width = shift + 3 * (depth - level)
        if low >> width == (high - 1) >> width:
            return ((1 << 3 * level) - 1) // 7 + (low >> width)
    raise AssertionError


def indexed(text: str, kind: str, step: int = 5000, shift: int = 14, depth: int = 5) -> tuple[bytes, bytes]:
    """(block-gzipped text, its index), the index made line by line."""
    data = text.encode()
    starts, out = [], b""
    for k in range(0, len(data), step):
        starts.append(len(out))
        out += bgzf.block(data[k : k + step])
    starts.append(len(out))
    place = lambda at: starts[at // step] << 16 | at % step
    found, at = {}, 0
    for line in text.splitlines(keepends=True):
        end = at + len(line.encode())
        if line[0] != "#":
            c = line.split("\t")
            low = int(c[1]) - 1
            bins, linear, firsts = found.setdefault(c[0], ({}, {}, {}))
            number = bin_of(low, low + len(c[3]), shift, depth)
            chunks = bins.setdefault(number, [])
            if chunks and chunks[-1][1] == place(at):
                chunks[-1] = (chunks[-1][0], place(end))
            else:
                chunks.append((place(at), place(end)))
            for k in range(low >> 14, (low + len(c[3]) - 1 >> 14) + 1):
                linear.setdefault(k, place(at))
            firsts.setdefault(number, place(at))
        at = end
    names = b"".join(c.encode() + b"\0" for c in found)
    head = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    raw = b"TBI\1" + struct.pack("<i", len(found)) + head if kind == "tbi" else b"CSI\1" + struct.pack("<3i", shift, depth, len(head)) + head + struct.pack("<i", len(found))
    for bins, linear, firsts in found.values():
        raw += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            raw += struct.pack("<I", number) + (struct.pack("<Q", firsts[number]) if kind == "csi" else b"") + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        if kind == "tbi":
            known, last = [], 0
            for k in range(max(linear) + 1):
                last = linear.get(k, last)
                known.append(last)
            raw += struct.pack(f"<i{len(known)}Q", len(known), *known)
    return out + bgzf.EOF, bgzf.block(raw) + bgzf.EOF


@pytest.mark.parametrize(("kind", "shift", "depth"), [("tbi", 14, 5), ("csi", 14, 5), ("csi", 10, 6)])
def test_regions_read_only_their_blocks(spark, tmp_path, kind, shift, depth):
    rng = random.Random(8)
    places = sorted((f"chr{c}", rng.randint(1, 400_000)) for c in (1, 2, 3) for _ in range(1500))
    text = vcf("A B", *(f"{c} {p} . {'A' * rng.choice([1, 1, 1, 30])} C 9 PASS . GT 0/1 {rng.choice(['0/0', '1/1'])}" for c, p in places))
    data, sidecar = indexed(text, kind, 3000, shift, depth)
    (tmp_path / "v.gz").write_bytes(data)
    (tmp_path / f"v.gz.{kind}").write_bytes(sidecar)
    uri, size = f"file://{tmp_path / 'v.gz'}", len(data)
    found = index.beside(uri)
    for chrom, low, high in (("chr2", 100_000, 120_000), ("chr3", 399_000, None), ("chr1", None, 5000), ("chr2", None, None), ("chr9", 1, 10), ("chr3", 50, 50)):
        spec = QuerySpec(chroms=frozenset([chrom]), from_bp=low, to_bp=high)
        calls = CallSet.from_bgzf(spark, uri, 2000, ((chrom,), low, high))
        got = sorted((r.chrom, r.pos) for r in calls.kept(spec).output("counts", spec).collect())
        assert got == [(c, p) for c, p in places if c == chrom and (low or 1) <= p <= (high or 10**9)]
        assert sum((b >> 16) - (a >> 16) for a, b in found.ranges(chrom, low, high)) < (0.4 if low is None and high is None else 0.15) * size


def test_indexes_that_are_no_good_are_not_used(tmp_path):
    data, sidecar = indexed(big_vcf(300), "tbi")
    (tmp_path / "v.gz").write_bytes(data)
    uri, at = f"file://{tmp_path / 'v.gz'}", tmp_path / "v.gz.tbi"
    assert index.beside(uri) is None
    at.write_bytes(sidecar)
    assert index.beside(uri) is not None
    os.utime(at, (1, 1))
    assert index.beside(uri) is None
    for bad in (bgzf.block(b"nonsense") + bgzf.EOF, bgzf.block(b"TBI\1\5\0\0\0") + bgzf.EOF, b"no blocks"):
        at.write_bytes(bad)
        assert index.beside(uri) is None


def test_recoded_blocks_are_one_legal_file(spark, tmp_path):
    calls = CallSet.from_lines(spark, big_vcf(500))
    names = bgzf.write_lines(calls.kept(QuerySpec()).output("recode", QuerySpec()), list(calls.header.lines), f"file://{tmp_path / 'out'}")
    whole = b"".join((tmp_path / "out" / n).read_bytes() for n in names)
    lines = gzip.decompress(whole).decode().rstrip("\n").split("\n")
    assert [x for x in lines if x[0] != "#"] == [x for x in big_vcf(500).split("\n") if x and x[0] != "#"]


def typed(kind: int, data: bytes, n: int) -> bytes:
    return bytes([(n << 4) | kind]) + data


def test_bcf_records(spark, tmp_path):
    head = (
        '##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="">\n##FILTER=<ID=q10,Description="">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="">\n'
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n\0'
    ).encode()
    shared = struct.pack("<iii", 0, 41, 1) + struct.pack("<f", 30.5) + struct.pack("<II", 1 | 2 << 16, 2 | 2 << 24)
    shared += typed(7, b".", 1) + typed(7, b"A", 1) + typed(7, b"CT", 2) + typed(1, b"\1", 1) + typed(1, b"\2", 1) + typed(0, b"", 0)
    own = typed(1, b"\3", 1) + typed(1, bytes([2, 4, 2, 5]), 2) + typed(1, b"\4", 1) + typed(1, bytes([7, 128]), 1)
    data = b"BCF\2\2" + struct.pack("<I", len(head)) + head + struct.pack("<II", len(shared), len(own)) + shared + own
    (tmp_path / "x.bcf").write_bytes(bgzf.block(data) + bgzf.EOF)
    uri = f"file://{tmp_path / 'x.bcf'}"
    assert bcf.sniff(uri) == "bcf"
    lines, header = bcf.read_lines(spark, uri)
    assert header.samples == ("A", "B")
    assert [r.value.split("\t") for r in lines.collect()] == [["chr1", "42", ".", "A", "CT", "30.5", "q10", "DB", "GT:DP", "0/1:7", "0|1:."]]


def test_bcf_is_written_as_it_is_read(spark, tmp_path):
    head = (
        '##fileformat=VCFv4.2\n##FILTER=<ID=low,Description="">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="">\n##INFO=<ID=AF,Number=A,Type=Float,Description="">\n##INFO=<ID=N,Number=.,Type=Integer,Description="">\n'
        '##INFO=<ID=S,Number=1,Type=String,Description="">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">\n##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="">\n'
        '##FORMAT=<ID=FT,Number=1,Type=String,Description="">\n##FORMAT=<ID=X,Number=.,Type=Float,Description="">\n##contig=<ID=chr1>\n##contig=<ID=chr2>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t'
    )
    rows = [x.split("\t") for x in random_calls(9, 60).splitlines() if x[0] != "#"]
    infos = [".", "DB", "AF=0.5,0.25;DB", "N=1,.,70000", "S=some_text;N=-3", "AF=."]
    for k, r in enumerate(rows):
        r[6], r[7] = [".", "PASS", "low"][k % 3], infos[k % 6]
        r[2] = f"rs{k}" if k % 4 == 0 else "."
    own = ["chr2 99999 . A C 7 PASS . GT:FT:X:DP 0|1:PASS:0.5,.:300 1:a_long_name_of_a_filter:.:. ./.:.:1,2,3:70000 .:.:.:1 0/0:.:.:2 2/10:x:4:."]
    text = vcf(" ".join(f"P{k}" for k in range(6)), *(" ".join(r) for r in rows), *own, head=head)
    calls = CallSet.from_lines(spark, text)
    spec = QuerySpec(recode_info_all=True)
    names = bcf.write_records(calls.kept(spec).output("recode", spec), list(calls.header.lines), f"file://{tmp_path / 'out'}")
    (tmp_path / "x.bcf").write_bytes(b"".join((tmp_path / "out" / n).read_bytes() for n in names))
    lines, header = bcf.read_lines(spark, f"file://{tmp_path / 'x.bcf'}")
    assert header.samples == calls.header.samples
    assert [r.value for r in lines.orderBy("ordinal").collect()] == [x for x in text.splitlines() if x[0] != "#"]


def good(site, least: float) -> bool:
    return site.qual != "." and float(site.qual) >= least


def test_command_line(spark, tmp_path):
    text = random_calls(6, 40)
    (tmp_path / "a.vcf").write_text(text)
    (tmp_path / "bed").write_text("chrom start end\nchr1 0 200\n")
    assert main(["--vcf", f"file://{tmp_path / 'a.vcf'}", "--counts", "--missing-indv", "--minQ", "35", "--exclude-bed", f"file://{tmp_path / 'bed'}", "--indv", "P1", "--indv", "P2", "--out", str(tmp_path / "o")], spark) == 0
    kept = [s for s in read(text) if good(s, 35) and not (s.chrom == "chr1" and s.pos <= 200)]
    assert [int(x.split("\t")[1]) for x in (tmp_path / "o.frq.count").read_text().split("\n")[1:-1]] == [s.pos for s in kept] and len(kept) > 5
    assert (tmp_path / "o.imiss").read_text().split("\n")[1].startswith(f"P1\t{len(kept)}\t0\t")
    log = (tmp_path / "o.log").read_text()
    assert f"Kept {len(kept)} of 40 sites read" in log and "Kept 2 of 6 individuals" in log and "min_q = 35.0" in log and "exclude_bed" in log
    # A comparison takes the side files too.
    assert main(["--vcf", f"file://{tmp_path / 'a.vcf'}", "--diff", f"file://{tmp_path / 'a.vcf'}", "--diff-site", "--exclude-bed", f"file://{tmp_path / 'bed'}", "--out", str(tmp_path / "d")], spark) == 0
    found = next(p for p in tmp_path.iterdir() if p.name.startswith("d.diff")).read_text().split("\n")[1:-1]
    assert sorted(int(x.split("\t")[1]) for x in found) == sorted(s.pos for s in read(text) if not (s.chrom == "chr1" and s.pos <= 200))


def test_streamed_sites(spark, tmp_path):
    text = random_calls(6, 40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(text)
    header = CallSet.from_lines(spark, text).header
    query = stream_sites(spark, str(tmp_path / "in"), header, QuerySpec(min_q=35.0, mac=1)).select("pos", "n_chr", "ac").writeStream.format("memory").queryName("sites").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert sorted(r.pos for r in spark.table("sites").collect()) == sorted(s.pos for s in read(text) if good(s, 35) and min(s.counts) >= 1)
