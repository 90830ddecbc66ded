import math

import pytest

from genomill.engine import CallSet, compare, write_outputs
from genomill.functions.hwe import exact
from genomill.operators.windows import checked_order
from genomill.spec import QuerySpec, SpecError
from tests.inputs import brute, brute_fst, random_calls, read, vcf


def rows(spark, text, name, spec=None, **sides):
    spec = spec or QuerySpec()
    return [" ".join(x.split("\t")[1:]) for x in list(CallSet.from_lines(spark, text).kept(spec, **sides).lines(name, spec))[1:]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", ["freq", "counts", "missing_site", "site_depth", "site_mean_depth", "site_quality", "site_pi", "depth", "missing_indv"])
def test_outputs_equal_their_definitions(spark, name, seed):
    text = random_calls(seed)
    assert rows(spark, text, name) == brute(text, name)


def test_filters_keep_the_sites_of_their_definitions(spark):
    text = random_calls(3, 120)
    sites = read(text)
    minor = lambda s: min((min(f, 1 - f) for c in s.counts for f in [c / len(s.called)]), default=math.inf)
    rules = {
        QuerySpec(maf=0.2): lambda s: not s.called or minor(s) >= 0.2,
        QuerySpec(max_maf=0.3): lambda s: bool(s.called) and minor(s) <= 0.3,
        QuerySpec(max_missing=0.7): lambda s: len(s.called) >= 0.7 * sum(len(a) for a, *_ in s.calls),
        QuerySpec(mac=2): lambda s: min(s.counts) >= 2,
        QuerySpec(min_mean_dp=20.0): lambda s: sum(s.depths) / len(s.calls) >= 20,
    }
    for spec, keeps in rules.items():
        assert [int(r.split()[0]) for r in rows(spark, text, "site_quality", spec)] == [s.pos for s in sites if keeps(s)]


def test_sums_of_depths_keep_32_bits(spark):
    text = vcf("X Y Z", "chr1 11 . G T 20 PASS . GT:DP 0/1:70000 0/0:90001 1/1:.", "chr1 12 . G T 20 PASS . GT:DP ./.:3 ./.:. ./.:.")
    assert rows(spark, text, "site_depth") == brute(text, "site_depth") == [f"11 160001 {(70000**2 + 90001**2) % 2**32}", "12 3 9"]
    assert rows(spark, text, "site_depth", QuerySpec(corrected_depth=True)) == [f"11 160001 {70000**2 + 90001**2}", "12 3 9"]
    assert rows(spark, text, "site_mean_depth") == brute(text, "site_mean_depth")


@pytest.mark.parametrize("populations", [(("P0", "P1", "P2"), ("P3", "P4", "P5")), (("P0", "P1", "P2", "P3"), ("P2", "P3", "P4")), (("P0", "P1"), ("P2", "P3"), ("P4", "P5", "nobody"))])
def test_fst_of_populations_apart_and_overlapping(spark, populations):
    text = random_calls(4, 120)
    spec = QuerySpec(populations=populations)
    got = [r.split() for r in rows(spark, text, "weir_fst", spec)]
    own = [[int(x[1:]) for x in p if x != "nobody"] for p in populations]
    # Samples of no population are left out before anything else.
    want = [(s.pos, brute_fst(s, own)) for s in read(text) if all(len(s.calls[i][0]) == 2 for p in own for i in p)]
    assert [int(p) for p, _ in got] == [p for p, _ in want] and len(got) > 20
    for (_, x), (_, y) in zip(got, want, strict=True):
        assert x == "-nan" if math.isnan(y) else math.isclose(float(x), y, rel_tol=1e-4, abs_tol=1e-6)


def test_recode_masks_and_sorts(spark):
    text = vcf(
        "X Y Z",
        "chr1 21 . C T 33 weak;Bias N=4 GQ:DP:GT 3:7:0|0 44:9:1 9:.:.",
        "chr1 22 . A G 33 PASS N=1 DP 6 . 2",
        "chr1 25 . A G 33 . N=2;F DP:GT 6:0/0 .:./. 2:1|1",
        "chr1 29 . G C 33 weak N=3 GT:GQ 1/1:12 ./.:. 0|1:2",
    )
    spec = QuerySpec(min_gq=10.0, recode_info_all=True)
    lines = [x.split("\t") for x in list(CallSet.from_lines(spark, text).kept(spec).lines("recode", spec))[-4:]]
    assert [x[6] for x in lines] == ["Bias;weak", "PASS", ".", "weak"] and [x[7] for x in lines] == ["N=4", "N=1", "N=2;F", "N=3"]
    assert [x[9:] for x in lines] == [["3:7:./.", "44:9:1", "9:.:./."], ["6", ".", "2"], ["6:0/0", ".:./.", "2:1|1"], ["1/1:12", "./.:.", "./.:2"]]
    plain = list(CallSet.from_lines(spark, text).kept(QuerySpec()).lines("recode", QuerySpec()))[-1].split("\t")
    assert plain[7] == "." and plain[9:] == ["1/1:12", "./.:.", "0|1:2"]


def test_thinning_counts_from_the_last_kept(spark):
    text = vcf("A", *(f"chr{c} {p} . A C 9 PASS . GT 0/1" for c, p in ((1, 100), (1, 140), (1, 160), (1, 205), (2, 206))))
    assert [r.split()[0] for r in rows(spark, text, "counts", QuerySpec(thin=60))] == ["100", "160", "206"]


def test_first_pass_short_circuits_filter_names(spark):
    text = vcf("A", *(f"chr1 {i + 1} . A C 9 {f} . GT 0/1" for i, f in enumerate((".", "PASS", "q10", "PASS;q10", "q10;PASS"))))
    kept = lambda **o: [r.split()[0] for r in rows(spark, text, "counts", QuerySpec(**o))]
    assert kept(remove_filtered_all=True) == ["1", "2", "4"]
    assert kept(remove_filtered=frozenset({"q10"})) == ["1", "2", "4"]
    assert kept(keep_filtered=frozenset({"q10"})) == ["3", "4", "5"]


def test_order_is_checked(spark):
    back = vcf("A", "chr1 5 . A C 9 PASS . GT 0/1", "chr1 4 . A C 9 PASS . GT 0/1")
    again = vcf("A", "chr1 5 . A C 9 PASS . GT 0/1", "chr2 4 . A C 9 PASS . GT 0/1", "chr1 6 . A C 9 PASS . GT 0/1")
    for text in (back, again):
        with pytest.raises(ValueError):
            checked_order(CallSet.from_lines(spark, text).sites)


def test_polyploid_calls_fail_where_they_are_used(spark):
    text = vcf("A", "chr1 5 . A C 9 PASS . GT 0/1/1")
    with pytest.raises(Exception, match="polyploid"):
        rows(spark, text, "counts")
    assert rows(spark, text, "site_quality") == ["5 9"]


def test_contradictions():
    for options in ({"chroms": frozenset("1"), "not_chroms": frozenset("2")}, {"from_bp": 1}, {"max_missing": 2.0}, {"outputs": ("freq", "freq2")}, {"maf": float("nan")}, {"outputs": ("weir_fst",)}, {"outputs": ("diff_site", "counts")}):
        with pytest.raises(SpecError):
            QuerySpec(**options)


def test_exact_test_sums_to_one():
    for het, a, b in ((0, 0, 0), (3, 4, 2), (1, 9, 0), (10, 0, 0)):
        p, low, high = exact(het, a, b)
        assert 0 < p <= 1 and low + high >= 1 - 1e-9


def test_comparison_of_two_sets(spark):
    first = CallSet.from_lines(spark, vcf("A B", "chr1 1 . A C 9 PASS . GT 0/1 0/0", "chr1 5 . A C 9 PASS . GT 1/0 ./.", "chr1 9 . G C 9 PASS . GT 0/1 0/0", "chr1 20 . AAAA A 9 PASS . GT 0/1 0/1"))
    second = CallSet.from_lines(spark, vcf("B C", "chr1 1 . A C 9 PASS . GT 0/1 0/0", "chr1 7 . A C 9 PASS . GT 0/1 0/1", "chr1 9 . T C 9 PASS . GT 0/1 0/0", "chr1 22 . A C 9 PASS . GT 0/1 0/1"))
    got = compare(first, second, QuerySpec(outputs=("diff_site",)))["diff_site"].orderBy("pos1", "pos2").collect()
    assert sorted((r.pos1 or r.pos2, r.in_file) for r in got) == [(1, "B"), (5, "1"), (7, "2"), (9, "O"), (20, "O")]
    got = compare(first, second, QuerySpec(outputs=("diff_site_discordance",)))["diff_site_discordance"].collect()
    assert sorted((r.pos, r.files, r.n_common_called, r.n_discord) for r in got) == [(1, "B", 1, 1), (5, "1", 0, 0), (7, "2", 0, 0), (20, "1", 0, 0), (22, "2", 0, 0)]
    got = compare(first, second, QuerySpec(outputs=("diff_indv",)))["diff_indv"].collect()
    assert [(r.indv, r.files) for r in got] == [("A", "1"), ("B", "B"), ("C", "2")]


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    calls = CallSet.from_lines(spark, random_calls(5, 20))
    write_outputs(calls, QuerySpec(outputs=("freq", "counts")), str(tmp_path / "a"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.frq", "a.frq.count"]
    bad = CallSet.from_lines(spark, vcf("A", "chr1 5 . A C 9 PASS . GT 0/1/1"))
    with pytest.raises(Exception, match="polyploid"):
        write_outputs(bad, QuerySpec(outputs=("site_quality", "counts")), str(tmp_path / "b"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("b")]


def test_comparison_takes_positions_and_intervals(spark):
    text = vcf("A", *(f"chr1 {p} . A C 9 PASS . GT 0/1" for p in (10, 20, 30, 40)))
    both = CallSet.from_lines(spark, text), CallSet.from_lines(spark, text)
    at = spark.createDataFrame([("chr1", 10), ("chr1", 40)], "chrom string, pos int")
    bed = spark.createDataFrame([("chr1", 15, 33)], "chrom string, start int, end int")
    found = lambda **sides: sorted(r.pos1 for r in compare(*both, QuerySpec(outputs=("diff_site",)), **sides)["diff_site"].collect())
    assert found(positions=at) == [10, 40] and found(exclude_positions=at) == [20, 30]
    assert found(bed=bed) == [20, 30] and found(exclude_bed=bed) == [10, 40]
