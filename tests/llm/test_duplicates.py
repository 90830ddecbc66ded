import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomill.llm._common import Scratch
from genomill.llm._graph import components
from genomill.llm._shingles import word_hashes
from genomill.llm.ngram_join import BLOCK, choose_bands, overlaps, similarity_classes
from genomill.llm.substring_dedup import REACH, SPAN, WINDOW, Fenwick, K, align, chains, minimizers, passages, repeated_passages, segments, without_passages

SCHEMA = "doc_id long, text string, node string, class_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def changed(rng, w, share):
    return [rng.choice(["zz", "yy", "xx"]) + str(rng.randint(0, 999)) if rng.random() < share else x for x in w]


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, name = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or union and len(sets[i] & sets[j]) / union >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = name[i], name[j]
                name = [min(a, b) if x in (a, b) else x for x in name]
    least = {}
    for n, (i, _) in zip(name, rows, strict=True):
        least[n] = min(least.get(n, i), i)
    return sorted((i, least[n], k) for (i, _), n, k in zip(rows, name, links, strict=True))


def test_classes_and_links_equal_brute_force(spark):
    rng = random.Random(8)
    rows, key = [], 0
    for _ in range(12):
        base = words(rng, rng.randint(3, 120))
        for _ in range(rng.randint(1, 8)):
            rows.append((key, " ".join(changed(rng, base, rng.choice([0, 0.01, 0.03, 0.2])))))
            key += 1
    rows += [(900, None), (901, ""), (902, "two words"), (903, "two words"), (904, "two  words"), (905, "x"), (906, " ".join(words(rng, 9000)))]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity_classes(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_a_group_of_many_blocks_loses_no_link(spark):
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, " ".join(changed(rng, base, 0.015))) for i in range(2 * BLOCK + 30)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity_classes(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_links_of_many_blocks_fill_few_files(spark, monkeypatch):
    plain, files = Scratch.table, {}

    def table(self, df, kind):
        out = plain(self, df, kind)
        files[kind] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "table", table)
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(60 + j))) for i in range(80) for j in range(2)]
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.class_size, r.n_links) for r in got} == {(i, i - i % 2, 2, 1) for i, _ in rows}
    assert files["links"] <= 4


def test_edges_of_the_join(spark):
    assert similarity_classes(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "other text entirely here now"), (3, "a b c d e f")]
    got = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in similarity_classes(docs(spark, rows)).collect())
    assert got == [(-1, 3, 3), (-1, 3, 3), (3, 3, 0), (3, 3, 3), (3, 3, 3)]
    # Near texts without keys are told apart, and linked, all the same.
    rng = random.Random(3)
    base = words(rng, 80)
    near = [(None, " ".join([*base[:-1], f"w{i}"])) for i in range(6)] + [(None, " ".join(words(rng, 30)))]
    got = sorted((r.class_size, r.n_links) for r in similarity_classes(docs(spark, near)).where("class_id is null").collect())
    assert got == [(1, 0)] + [(6, 5)] * 6


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 and bands * rows <= 256


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 1, 40, 200, 90)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    got = overlaps(sets)
    assert all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)


@pytest.mark.parametrize("finish", [0, 1000])
def test_components_of_paths_and_stars(spark, finish):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(1000, 1001), (1001, 1000), (2000, 2000), (1, None)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), finish).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got) == 61 + 55 + 2
    assert len({got[i] for i in range(100, 161)}) == 1 and len({got[i] for i in range(5, 60)}) == 1
    assert len({got[100], got[5], got[1000]}) == 3 and got[1000] == got[1001]
    first = {r.node: r.levels[0] for r in rows}
    assert all(got[x] == got[n] for n, x in first.items()) and len({first[i] for i in range(100, 161)}) > 5
    assert all(r.levels[-1] == r.component for r in rows)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), finish).count() == 0


@pytest.mark.parametrize(("n", "finish"), [(2_000, 0), (50_000, 20_000)])
def test_a_long_path_is_one_component_and_plans_stay_small(spark, n, finish):
    path = spark.range(n).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    got = components(path, finish)
    assert got.count() == n + 1 and got.select("component").distinct().count() == 1
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_a_long_chain_of_candidates_loses_no_link(spark):
    rng = random.Random(10)
    now, rows = words(rng, 60), []
    for i in range(3 * BLOCK):
        rows.append((i, " ".join(now)))
        now = list(now)
        now[rng.randrange(60)] = "".join(words(rng, 2))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity_classes(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_fenwick_and_chain():
    tree = Fenwick(50)
    best, rng = {}, random.Random(1)
    for _ in range(200):
        at, value = rng.randrange(50), (rng.random(), rng.randrange(99))
        tree.put(at, value)
        best[at] = max(best.get(at, value), value)
        upto = rng.randrange(50)
        assert tree.get(upto) == max([(-1e18, -1), *(v for k, v in best.items() if k <= upto)])
    # Two runs on near diagonals make one chain; a run that goes back is another.
    assert chains([[0, 20, 5], [25, 60, 6], [30, 45, -30]])[0] == [0, 1]


@pytest.mark.parametrize("edits", [0, 0.05])
def test_planted_passages_are_found(spark, edits):
    rng = random.Random(11)
    passage = words(rng, 90)
    rows = [(i, words(rng, 60 + 10 * i) + (changed(rng, passage, edits if i else 0) if i % 3 == 0 else []) + words(rng, 40)) for i in range(12)]
    rows += [(50, words(rng, 30)), (51, []), (52, rows[1][1][:55] + words(rng, 5))]
    text = [(i, " ".join(w)) for i, w in rows] + [(60, None)]
    got = repeated_passages(docs(spark, text)).collect()
    assert {r.doc_id for r in got} == {3, 6, 9, 52}
    for r in got:
        if r.doc_id == 52:
            assert (r.first_doc_id, r.start_word) == (1, 0) and 55 <= r.end_word <= 56
        else:
            start = 60 + 10 * r.doc_id
            assert abs(r.start_word - start) <= 3 and abs(r.end_word - start - 90) <= 3 and r.identity >= 0.8


def test_passages_are_cut_and_the_rest_stays(spark):
    rng = random.Random(12)
    passage, a, b = words(rng, 70), words(rng, 20), words(rng, 15)
    rows = [(1, " ".join(passage)), (2, " ".join(a) + "\n" + " ".join(passage) + "\n" + " ".join(b)), (3, " ".join(passage)), (4, None), (5, "  kept as  it is ")]
    frame = docs(spark, rows)
    got = {r.doc_id: r.text for r in without_passages(frame, repeated_passages(frame)).collect()}
    assert got == {1: rows[0][1], 2: " ".join(a) + "\n" + " ".join(b), 3: "", 4: None, 5: "  kept as  it is "}
    assert repeated_passages(docs(spark, [])).count() == 0
    # Rows of one key and text are one document; other texts of the key are other documents; no key comes last.
    text = " ".join(passage)
    same = docs(spark, [(7, text), (7, text), (None, text), (7, " ".join(a) + " " + text), (9, text), (9, text)])
    found = repeated_passages(same)
    rows = sorted((r.doc_id or 99, r.first_doc_id, r.start_word, r.end_word) for r in found.collect())
    assert [r for r in rows if r[0] != 7] == [(9, 7, 0, 70), (99, 7, 0, 70)] and len([r for r in rows if r[0] == 7]) == 1
    left = sorted((r.doc_id or 99, r.text) for r in without_passages(same, found).collect())
    assert [x for x in left if x[0] != 7] == [(9, ""), (9, ""), (99, "")] and sum(text in x for _, x in left) in (1, 2)


def test_own_columns_of_any_name_stay(spark):
    rng = random.Random(5)
    text = " ".join(words(rng, 60))
    names = "doc_id long, text string, key string, h string, spans string, parts string, row string, text_hash string"
    frame = spark.createDataFrame([(1, text, *"abcdef"), (2, text, *"ghijkl")], names)
    out = without_passages(frame, repeated_passages(frame))
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [(1, text, *"abcdef"), (2, "", *"ghijkl")]


def found(rng, n, identity):
    """(whether a passage's edited copy is one by its true alignment, whether seeds, chains and alignment find one)."""
    passage = words(rng, n)
    copy = [x if rng.random() < identity else "zz" + str(rng.randint(0, 99999)) for x in passage]
    a, b = (word_hashes(" ".join(x).encode()) for x in (words(rng, 60) + passage + words(rng, 60), words(rng, 30) + copy + words(rng, 90)))
    both, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    place, h = minimizers(both, bounds, K, WINDOW)
    first = {v: p for p, v in zip(place.tolist(), h.tolist(), strict=True) if p < len(a)}
    at = [(p - len(a), first[v]) for p, v in zip(place.tolist(), h.tolist(), strict=True) if p >= len(a) and v in first]
    true = bool(passages(np.zeros(n, dtype=np.int64), np.array([x == y for x, y in zip(passage, copy, strict=True)]), 50, 0.8))
    segs = segments(*(np.array(x) for x in zip(*at, strict=True)), K) if at else []
    for c in chains(segs) if segs else []:
        if segs[c[-1]][1] - segs[c[0]][0] >= SPAN and passages(*align(b, a, [tuple(segs[i]) for i in c], REACH)[1:], 50, 0.8):
            return true, True
    return true, False


@pytest.mark.parametrize("identity", [0.95, 0.9, 0.85, 0.8])
@pytest.mark.parametrize("n", [60, 80])
def test_recall_of_edited_passages(n, identity):
    rng = random.Random(n + int(identity * 100))
    both = [f for t, f in (found(rng, n, identity) for _ in range(200)) if t]
    assert sum(both) >= 0.9 * len(both)


def test_minimizers_are_the_least_of_each_window():
    rng = random.Random(4)
    texts = [words(rng, n) for n in (0, 3, 5, 9, 60, 45, 12, 300)]
    hashes = [word_hashes(" ".join(x).encode()) for x in texts]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in hashes])))
    for k, window in ((5, 8), (40, 16), (1, 1), (7, 3)):
        place, h = minimizers(np.concatenate(hashes), bounds, k, window)
        of = dict(zip(place.tolist(), h.tolist(), strict=True))
        everything = dict(zip(*(x.tolist() for x in minimizers(np.concatenate(hashes), bounds, k, 1)), strict=True))
        want = set()
        for low, high in zip(bounds.tolist(), bounds.tolist()[1:], strict=False):
            n = high - low - k + 1
            for at in range(low, low + max(n - window, 0) + 1) if n > 0 else ():
                want.add(min(range(at, min(at + window, low + n)), key=lambda i: (everything[i], i)))
        assert of.keys() == want
        grams = {}
        for p, v in everything.items():
            d = int(np.searchsorted(bounds, p, "right")) - 1
            assert grams.setdefault(tuple(texts[d][p - bounds[d] : p - bounds[d] + k]), v) == v
        assert len(set(grams.values())) == len(grams)


def covered(rows, n=50):
    """doc_id to the numbers of its words that stand in n words which an earlier document has, by comparing all of them."""
    seen, out = set(), {}
    for i, w in sorted(rows):
        grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
        if at := {j + x for j, g in enumerate(grams) if g in seen for x in range(n)}:
            out[i] = at
        seen.update(grams)
    return out


def check_covered(spark, rows, slack=0):
    got = {}
    for r in repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        assert r.first_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and r.identity >= 0.8
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = covered(rows)
    assert got.keys() == want.keys()
    for i, at in want.items():
        assert len(at - got[i]) <= slack and len(got[i] - at) <= 6, i


def test_parts_in_smaller_ids_do_not_hide_a_passage(spark):
    rng = random.Random(21)
    passage = words(rng, 80)
    part = {1: passage[:40], 2: passage[40:], 10: passage, 15: passage[:40], 16: passage[40:], 20: passage, 25: passage[20:60], 30: passage}
    check_covered(spark, [(i, words(rng, 30) + p + words(rng, 30)) for i, p in part.items()])


@pytest.mark.parametrize("period", [1, 10, 15, 30])
def test_repeated_lines_are_passages(spark, period):
    rng = random.Random(period)
    line = words(rng, period)
    several = line * (90 // period)
    rows = [(1, words(rng, 40) + several + words(rng, 30)), (2, words(rng, 70)), (3, words(rng, 25) + several + words(rng, 30))]
    rows += [(4, words(rng, 20) + line[:12] + words(rng, 60) + several + words(rng, 10)), (5, words(rng, 10) + several[: len(several) - period] + words(rng, 40))]
    check_covered(spark, rows, slack=period)


def test_alignment_goes_on_while_the_score_grows():
    a = np.arange(200)
    b = np.where((a % 4 == 0) & (abs(a - 100) > 5), -1, a)
    start, diagonal, equal = align(np.concatenate([a, a + 500]), np.concatenate([b, a + 900]), [(98, 103, 0)], 21)
    assert start <= 4 and start + len(equal) == 200 and not diagonal.any()
