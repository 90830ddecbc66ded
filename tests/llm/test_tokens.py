import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from genomill.llm._chunks import ByteLevelEncoder, WordEncoder
from genomill.llm.packing import closest_fill, pack, patterns
from genomill.llm.token_counts import Counter, count_tokens
from genomill.llm.token_ids import IdStore, PerfectHash, read_ids, round_trip, write_ids

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, n_tokens string"


def texts(n: int = 400) -> list[str]:
    rng = random.Random(3)
    fixed = [
        "", " ", "a   b", "  x  ", "a\n\nb\n", "x\t\n\ty", "don't I'll", "<|endoftext|> a<|endoftext|>b", "日本語 é́", "a" * 3000, "x\n\t\ty", "a\t\t b", "i.d.i.o.t ½ 12ab!? …",
        "İstanbul ǅ", "\x1c a \x1d\x1d b", "a\r\nb", "😀😀", "<|startoftext|>q", "the's 're ''s", "The cat. The cat, the CAT!",
    ]
    made = ["".join(rng.choice("ab  \n\t'sé.,1|<> 　Ⅷß") for _ in range(rng.randint(1, 30))) for _ in range(n)]
    prose = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(5, 900))) for _ in range(40)]
    return fixed + made + prose


@pytest.mark.parametrize(("path", "kind"), [(BYTE, ByteLevelEncoder), (WORD, WordEncoder)])
def test_pieces_give_the_library_ids(path, kind):
    own, library = kind(path), Tokenizer.from_file(path)
    many = [*texts(), None] * 2
    got = [ids[a:b].tolist() for ids, at in own.encode(pa.array(many).slice(1)) for a, b in zip(at, at[1:], strict=False)]
    ends = [ids[a:b].tolist() for ids, at in own.encode(pa.array(many, pa.large_string()), 1) for a, b in zip(at, at[1:], strict=False)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in many]
    assert got == want[1:] and ends == [[*x, 1] for x in want]


def test_merging_counts_what_the_library_gives():
    library = Tokenizer.from_file(BYTE)
    many = [*texts(), "<|endoftext|> a" * 3000]
    assert Counter(BYTE).count(pa.array(many)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in many]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", None) for r in rows], SCHEMA)


def test_counts_of_nulls_and_repeats(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (5, "x " * 700)]
    got = count_tokens(docs(spark, rows), BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    want = sorted((i or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert count_tokens(docs(spark, []), BYTE).count() == 0


def test_fill_is_the_best_there_is():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        capacity = rng.randint(1, 60)
        used = closest_fill(counts, capacity)
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)


def test_patterns_use_every_item_once():
    counts = {1: 5, 7: 3, 40: 2, 63: 4, 20: 11}
    left = dict.fromkeys(counts, 0)
    for used, times in patterns(counts, 64):
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            left[k] += n * times
    assert left == counts


def test_pieces_cover_documents_and_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.choice([0, 3, 50, 400, 2500])))) for i in range(120)] + [(200, None), (201, ""), (7, "again")]
    library = Tokenizer.from_file(BYTE)
    got = pack(docs(spark, rows), BYTE).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    windows = {}
    for r in got:
        assert any(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for ids in want[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total, padding = total + at, padding + (2048 - at if at & (at - 1) else 0)
    assert padding <= 2 * 2048 and padding < 0.05 * total
    assert pack(docs(spark, []), BYTE).count() == 0


def test_perfect_hash_has_a_slot_for_each_key():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    index = PerfectHash.build(keys)
    assert sorted(index.slot(keys)) == list(range(len(keys)))


def test_ids_round_trip_and_keyed_access(spark, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(texts(60))] + [(None, "no key"), (21, "same key"), (-5, None)]
    uri = f"file://{tmp_path / 'ids'}"
    manifest = write_ids(docs(spark, rows), WORD, uri, shards=5)
    library = Tokenizer.from_file(WORD)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = read_ids(spark, uri, manifest).orderBy("start").collect()
    start = 0
    for r, (key, text) in zip(got, order, strict=True):
        v = ids(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(v), zlib.crc32(np.asarray(v, dtype="<u4").tobytes()))
        start += len(v)
    store = IdStore(uri)
    assert store.get(-5)[0].tolist() == [1]
    assert sorted(x.tolist() for x in store.get(21)) == sorted([ids("same key"), ids(texts(60)[3])])
    assert store.get(22) == [] and store.get(10**9) == []
    # Documents of one key go on in further shards.
    hot = [(9, f"text {i}") for i in range(300)] + [(8, "a"), (10, "b")]
    manifest = write_ids(docs(spark, hot), WORD, f"{uri}-hot", shards=4)
    assert sum(p["low"] == 9 or p["high"] == 9 for p in manifest["shards"]) > 2
    store = IdStore(f"{uri}-hot")
    assert sorted(x.tolist() for x in store.get(9)) == sorted(ids(t) for k, t in hot if k == 9) and store.get(10)[0].tolist() == ids("b")
    assert round_trip(docs(spark, []), WORD).count() == 0
