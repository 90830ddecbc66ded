import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from genomill.llm import mixing, quality_rules
from tests.llm.test_duplicates import brute, covered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def staged(spark, name, docs, tmp_path):
    """A stage's rows as run() passes them on."""
    at = str(tmp_path / name)
    STAGES[name](spark, docs, SF).write.parquet(at)
    return spark.read.parquet(at)


def test_each_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = staged(spark, "quality", docs, tmp_path)
    assert kept.columns == COLUMNS
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {i for (i,) in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in want}

    single = staged(spark, "near_duplicates", kept, tmp_path)
    assert single.columns == COLUMNS
    rows = sorted((i, texts[i]) for i in want)
    want = {i for i, least, _ in brute(rows) if i == least}
    assert {r.doc_id: r.text for r in single.collect()} == {i: texts[i] for i in want}

    cut = staged(spark, "repeated_text", single, tmp_path)
    assert cut.columns == COLUMNS
    words = [(i, texts[i].split()) for i in sorted(want)]
    must, may = covered(words, 51), covered(words, 12)
    after = {r.doc_id: r for r in cut.collect()}
    assert after.keys() == want
    for i, before in words:
        assert after[i].n_chars == len(after[i].text)
        if i not in may:
            assert after[i].text == texts[i]
        else:
            left = Counter(after[i].text.split())
            assert not left - Counter(before) and sum(left.values()) <= len(before) - len(must.get(i, ()))
    assert must and not covered([(i, r.text.split()) for i, r in after.items()], 60)

    mixed = staged(spark, "mixture", cut, tmp_path)
    assert mixed.columns == COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rate = {r.doc_id: r for r in mixing.mix(cut, labels, targets=corpus_pipeline.MIXTURE).collect()}
    total = sum(r.n_tokens for r in rate.values())
    for d, t in corpus_pipeline.MIXTURE.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rate.values()) / total - t) <= 0.002 * t
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == Counter({i: r.copies for i, r in rate.items() if r.copies})
    assert all(r.text == after[r.doc_id].text for r in got)
    clean = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0} & want
    assert len(clean - {r.doc_id for r in got}) <= 0.02 * len(clean)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    windows, pieces = {}, Counter()
    for p in STAGES["packing"](spark, mixed, SF).collect():
        ids = [*library.encode(after[p.doc_id].text, add_special_tokens=False).ids, 1]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
        pieces[p.doc_id] += p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    copies = Counter(r.doc_id for r in got)
    assert pieces == Counter({i: n * len([*library.encode(after[i].text, add_special_tokens=False).ids, 1]) for i, n in copies.items()})
    for x in windows.values():
        ends = np.cumsum([0, *(n for _, n in sorted(x))])
        assert [a for a, _ in sorted(x)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_of_nulls_repeats_and_clashing_names(spark, tmp_path):
    prose = "the river runs past an old stone mill and the light of morning falls on its slow wheel while {} children walk along the path to school in the village behind that hill"
    rows = [(1, prose.format("two")), (2, prose.format("two")), (2, prose.format("two")), (3, None), (3, ""), (None, prose.format("many other tall and merry")), (None, None), (5, "x " * 3000), (6, prose.format("no") + " " + prose.format("six"))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, quality string, copies int, key string")
    docs = frame
    for name in list(STAGES)[:-1]:
        docs = staged(spark, name, docs, tmp_path)
        assert docs.columns == frame.columns and all(r.quality == "own" and r.key == "k" for r in docs.collect())
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1]  # 6 repeats itself, so the rules have rejected it
    assert STAGES["packing"](spark, docs, SF).count() >= 1
    docs = frame.limit(0)
    for name in list(STAGES)[:-1]:
        (tmp_path / "none").mkdir(exist_ok=True)
        docs = staged(spark, name, docs, tmp_path / "none")
        assert docs.count() == 0 and docs.columns == frame.columns
    assert STAGES["packing"](spark, docs, SF).count() == 0


def test_registered_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
