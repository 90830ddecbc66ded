import hashlib
import math
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from genomill.llm import quality_rules
from genomill.llm.fingerprints import BITS, RADIUS, edited_fingerprints, fingerprints, near_counts, search

DATA = Path("/root/testdata/sf0.001/documents.parquet")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no key at all"), (6, "a b c d e f g h " * 5), (7, "Line one here\nLine one here\n\nother line " + "w " * 30), (8, "#$ x " * 40),
    (9, "SHOUT LOUD " * 20), (10, "hey! hm! " * 15), (11, "same same same same other other other other third third third third more more more more last last last last"), (12, "word" * 9000), (13, "é à ü ß " * 8),
    (14, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22"),
]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "w", 1, True) for r in rows], "doc_id long, text string, source string, words string, n_words int, kept boolean")


def verdicts_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return con.sql("SELECT * FROM (" + quality_rules.ORACLE + ") ORDER BY ALL").fetchall()


def test_features_and_verdicts_equal_sql(spark):
    rows = [r for r in dict.fromkeys(ODD) if r[0] is not None]
    if DATA.exists():
        rows += [(i + 100, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}'").fetchall()]
    got = sorted(tuple(r) for r in quality_rules.verdicts(docs(spark, rows)).collect())
    assert got == sorted(verdicts_by_sql(rows))


def test_order_of_rules_changes_no_verdict(spark):
    rules = quality_rules.default_rules()
    ordered = quality_rules.order_rules(docs(spark, ODD), rules)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    a = quality_rules.judge(docs(spark, ODD), rules=rules).where("quality.kept").count()
    b = quality_rules.judge(docs(spark, ODD), rules=rules[::-1]).where("quality.kept").count()
    assert a == b


def test_own_columns_stay_and_repeats_agree(spark):
    out = quality_rules.judge(docs(spark, ODD))
    assert out.columns[:6] == ["doc_id", "text", "source", "words", "n_words", "kept"] and out.count() == len(ODD)
    got = quality_rules.verdicts(docs(spark, ODD)).where("doc_id = 4").distinct().count()
    assert got == 1
    assert quality_rules.verdicts(docs(spark, [])).count() == 0


def test_columns_of_any_name_stay_as_they_are(spark):
    frame = spark.createDataFrame([(1, "a b c", "own", 7, "x.y"), (2, None, None, 8, "z")], "doc_id long, text string, __words string, __text long, `a.b` string")
    out = quality_rules.judge(frame, name="verdict")
    assert out.columns == [*frame.columns, "verdict"] and sorted(map(tuple, out.drop("verdict").collect())) == sorted(map(tuple, frame.collect()))
    with pytest.raises(ValueError):
        quality_rules.judge(frame.withColumn("quality", F.lit(1)))


def test_edited_texts_and_their_prints(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 60)))) for i in range(90)] + [(1, None), (2, "é" * 7), (4, "x"), (50, ""), (5000, "last one here")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in edited_fingerprints(docs(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    prints = {r.doc_id: r for r in fingerprints(docs(spark, rows)).collect()}
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)], len(t) // 2
        edited = t[: len(t) - half] + nxt[1][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[i].fingerprint and len(r.fingerprint) == BITS // 4
        assert 0 <= r.near_edited <= 1 and (edited != t or r.near_edited == 1)
        assert (r.near_next == 1) == (r.fingerprint == prints[nxt[0]].fingerprint)


def plain_simhash(spark, texts):
    """Fingerprints by votes counted one by one; only the terms' hashes come from the engine."""
    terms = [[(w[0],)] if len(w) == 1 else list(zip(w, w[1:], strict=False)) for w in ([x for x in re.split(r"[\x20\x09-\x0D]+", t) if x] for t in texts)]
    rows = sorted({t for x in terms for t in x})
    frame = spark.createDataFrame([(" ".join(t), t[0], t[-1] if len(t) > 1 else None) for t in rows] or [("", "", None)], "name string, a string, b string")
    one = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    hashes = {r.name: (r.h, r.g) for r in frame.select("name", one.alias("h")).select("name", "h", F.xxhash64("h", F.lit("genomill")).alias("g")).collect()}
    out = []
    for x in terms:
        halves = []
        for side in (0, 1):
            votes = [0] * 64
            for t in x:
                h = hashes[" ".join(t)][side]
                for bit in range(64):
                    votes[bit] += 1 if h >> bit & 1 else -1
            halves.append(sum(1 << bit for bit in range(64) if votes[bit] > 0))
        out.append(halves[0] << 64 | halves[1])
    return out


def test_prints_equal_votes_counted_one_by_one(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("the of and to cat river stone".split()) for _ in range(rng.choice([0, 1, 2, 9, 80])))) for i in range(60)]
    rows += [(100, rows[4][1]), (101, "one\ttwo\n three"), (120, rows[20][1])]
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    want, changed = plain_simhash(spark, texts), plain_simhash(spark, edited)
    like = lambda a, b: 1.0 if a == b else max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS))
    got = {r.doc_id: r for r in edited_fingerprints(docs(spark, rows)).collect()}
    for k, (i, _) in enumerate(rows):
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (f"{want[k]:032x}", f"{changed[k]:032x}")
        assert math.isclose(r.near_edited, like(want[k], changed[k]), abs_tol=1e-12) and math.isclose(r.near_next, like(want[k], want[(k + 1) % len(rows)]), abs_tol=1e-12)
        assert r.n_near == (sum((want[k] ^ x).bit_count() <= RADIUS for x in want) if i % 20 == 0 else None)


def test_edges_of_prints(spark):
    one = edited_fingerprints(docs(spark, [(3, "only one text")])).first()
    assert one.near_next == 1
    assert edited_fingerprints(docs(spark, [])).count() == 0
    same = edited_fingerprints(docs(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same if r.doc_id == 1}) == 1


@pytest.mark.parametrize("radius", [3, 6])
def test_block_tables_miss_no_neighbour(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = []
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(128), rng.randint(0, 9)):
                x ^= 1 << bit
            prints.append(x)
    prints += prints[:5]
    half = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, half(x >> 64), half(x & (1 << 64) - 1)) for i, x in enumerate(prints)], "id long, hi long, lo long")
    queries = frame.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id, r.distance) for r in search(queries, frame, radius).collect()}
    want = {(i, j, d) for i in range(0, len(prints), 4) for j, x in enumerate(prints) if (d := (prints[i] ^ x).bit_count()) <= radius}
    assert got == want
    counts = {(r.hi, r.lo): r.n_near for r in near_counts(queries.select("hi", "lo"), frame, radius).collect()}
    assert counts == {(half(prints[i] >> 64), half(prints[i] & (1 << 64) - 1)): sum((prints[i] ^ x).bit_count() <= radius for x in prints) for i in range(0, len(prints), 4)}
