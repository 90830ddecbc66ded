import random
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomill.llm import mixing, toxicity
from genomill.llm import html_extract
from genomill.llm.html_extract import Extractor, best_stretch, main_text

SF = "/root/testdata/sf0.1"


def kernel(s, t, order, decay):
    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel_equals_its_definition():
    rng = random.Random(1)
    a = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    b = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    got = toxicity.subsequence_kernel(toxicity.coded(a, -1), toxicity.coded(b, -2))
    want = [kernel(x, y, toxicity.ORDER, toxicity.DECAY) for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, want, rtol=1e-4)


def insults(n, seed):
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        w = [made() for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["grumbok", "Zaddle", "pimwick."])
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxic_words_with_gaps_and_insertions():
    rows = insults(800, 3)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    test = insults(400, 4)
    score = model.score([t for _, t, _ in test])
    wrong = sum((s >= 0.7) != bool(y) for s, (_, _, y) in zip(score, test, strict=True))
    assert wrong <= 8
    plain = "the rain in the end is not so hot {} and the sun is out"
    for w in ("grumbok", "grumxbok", "g.r.u.m.b.o.k", "g r u m b o k", "GRUMBOK!!", "gruumbok"):
        assert model.score([plain.format(w)])[0] > 0.7, w
    assert model.score([plain.format("orchard")])[0] < 0.3
    assert model.score([""]) == model.score(["   "])


def test_without_classes_every_score_is_alike():
    model = toxicity.fit(["a b c"], [0])
    assert len(set(model.score(["x", "", "a b c"]))) == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_held_out_toxicity_and_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count()
    got = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.predicted == (r.score >= 0.7) for r in got)
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.02 * len(clean) and len(toxic) > 100
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "w" * 100_000, 0.0), (2, "w" * 100_000, 0.0)], "doc_id long, text string, score double")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 2}) == 1 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_rates_reach_the_targets_as_brute_force_does(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    n = rng.integers(1, 400, 500)
    slim = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    w = n / n.sum()
    inverse = np.linalg.inv((p * w[:, None]).T @ p)
    for target in ([0.2, 0.5, 0.3], [0.95, 0.05, 0.0]):
        target = np.array(target)

        def miss(r, target=target):
            e = (r * w) @ p - target
            return e @ inverse @ e

        rate = mixing.rates(p, *mixing.solve(slim, target, iterations=300, tolerance=1e-9))
        x = np.ones(500)
        for _ in range(20000):  # plain projected gradient in the metric of the counts
            x = np.maximum(x - 0.9 * (p @ (inverse @ ((x * w) @ p - target)) + mixing.RIDGE * (x - 1)), 0)
        assert (rate >= 0).all() and miss(rate) <= miss(x) + 1e-6


def test_mixture_of_labelled_documents(spark):
    rng = random.Random(5)
    kinds = {"clean": "river stone light", "low": "zz qq #### xx", "toxic": "grumbok zaddle"}
    rows = [(i, " ".join(rng.choice(kinds[d].split()) if rng.random() < 0.4 else rng.choice("the of and to".split()) for _ in range(rng.randint(20, 80))), d) for i in range(300) for d in [rng.choice(["clean", "clean", "low", "toxic"])]]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(999, None, "x", 1.0), (None, "", "x", 1.0)], "doc_id long, text string, p string, rate double")
    labels = spark.createDataFrame([(i, int(d != "low"), int(d == "toxic")) for i, _, d in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    got = out.collect()
    assert len(got) == 302 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    total = sum(r.n_tokens for r in got)
    for d, t in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - t) < 0.05
    assert mixing.resampled(docs, out).count() == sum(r.copies for r in got)
    bare = mixing.mix(docs, labels.limit(0)).collect()
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in bare)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    # With a tokenizer's counts the targets are met in its tokens.
    counted = docs.withColumn("count", F.when(F.col("doc_id") % 3 == 0, 7 * F.length("text")).otherwise(F.length("text")))
    got = mixing.mix(counted, labels, tokens="count").collect()
    total = sum(r.n_tokens for r in got)
    assert total == sum((7 if i % 3 == 0 else 1) * len(t) for i, t, _ in rows)
    for d, t in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - t) < 0.05



@pytest.mark.parametrize("share", [0.003, 0.0003, 0.0])
def test_rare_domains_reach_their_targets(spark, share):
    rng = np.random.default_rng(7)
    n, target = 20_000, np.array([0.92, 0.02, 0.06])
    p = np.eye(3)[rng.choice([0, 2], n, p=[0.8, 0.2])]
    p[: round(share * n)] = [0, 1, 0]
    if not share:  # only a posterior's remainder, in every document
        p = p * 0.9 + 0.1 * rng.dirichlet([1, 0.02, 1], n)
    tokens = rng.integers(20, 400, n)
    slim = spark.createDataFrame([(int(a), b) for a, b in zip(tokens, p.tolist(), strict=True)], "n_tokens long, p array<double>").cache()
    rate = mixing.rates(p, *mixing.solve(slim, target))
    assert rate.min() >= 0 and np.all(abs((tokens * rate) @ p / tokens.sum() - target) <= 0.01 * target)


PAGE = """<!DOCTYPE html><html><head><title>Page title here</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav>
<div class="cookie-notice">We use cookies on this site for all the usual reasons</div><div class="ad">Buy this now and save money today</div>{open}<h1>A &amp; B:
 the   news</h1><p>First para with <b>bold</b> and a <a href="/x">link in it</a> for you.<p>Second one, never closed &lt;here&gt;{inner}<ul><li>one item</li><li>two item</li></ul>{close}
<section class="comments"><p>I liked this article very much indeed, thanks to all of you</p></section><aside class="sidebar"><p>Related reading for you</p></aside><form><p>Subscribe to our letters</p></form><footer>&copy; us</footer></body></html>"""
WANT = "A & B: the news\nFirst para with bold and a link in it for you.\nSecond one, never closed <here>\none item\ntwo item"


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="page"><article class="entry">', "</article></div>")])
@pytest.mark.parametrize("inner", ["", '</p><div class="ad">An advert in the middle of it all</div>', "</p><script>track()</script>", '</p><div class="comments"><p>A reader says things</p></div>'])
def test_article_without_what_surrounds_it(start, end, inner):
    assert Extractor().text(PAGE.format(open=start, close=end, inner=inner)) == WANT


def test_pages_of_every_kind(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "plain text only"), (5, "u", "<html><body><nav>menu</nav></body></html>"), (6, "u", "<article><p>" + "word " * 50_000 + "</article>"), (6, "u", "<article><p>cut off <a hre")]
    got = main_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text[:14] for r in got if r.page_id == 6} == {"word word word", "cut off"}
    assert [r.text for r in got if r.page_id in (1, 2, 5)] == ["", "", ""]


def test_the_scan_finds_the_best_of_all_stretches():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-2.5, -1, -0.25, 0, 0.5, 1, 3]) for _ in range(rng.randint(0, 14))]
        low, high = best_stretch(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[low:high]) == max(best, 0) and (low < high) == (best > 0)


def test_an_article_needs_no_box():
    one, two = "first " * 80, "second " * 90
    assert Extractor().text(f"<html><body><p>{one}</p><p>{two}</p></body></html>") == f"{one.strip()}\n{two.strip()}"
    assert Extractor().text(f"<p>{one}</p><script>{'var x = 1; ' * 400}</script><p>{two}</p>") == f"{one.strip()}\n{two.strip()}"


def test_words_of_pages_that_nothing_was_learnt_from():
    rng, right, found, wanted = random.Random(99), 0, 0, 0
    for _ in range(150):
        parts = html_extract._template(rng)
        want = " ".join(x[1:] for x, is_text in parts if is_text and x[0] == "+").split()
        got = Extractor().text("".join(x[1:] if is_text else x for x, is_text in parts)).split()
        both = sum((Counter(want) & Counter(got)).values())
        right, found, wanted = right + both, found + len(got), wanted + len(want)
    assert right >= 0.97 * found and right >= 0.97 * wanted


HOSTILE = {
    "quotes": "<a '" * 20_000 + '"', "ends": "<div>" * 5000 + "</p>" * 5000, "starts": "<p><article>" + "<span>" * 5000 + "<h1>" * 5000, "classes": "".join(f"<div class=c{i}>" for i in range(6000)), "signs": "<" * 100_000,
    "comments": "<!--" * 25_000, "scripts": "<script>" * 12_000, "items": "<li><b>" * 14_000, "cells": "<table><tr><td>" * 7000, "references": "<p>" + "&" * 100_000, "attributes": '<a class="' * 10_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    Extractor().text("<p>warm")
    began = time.process_time()
    Extractor().text(HOSTILE[name])
    assert time.process_time() - began < 2
