"""Hand-computed fixtures of the site, region, cell and differential operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from methloom.functions import stats
from methloom.operators import analysis, cells, dmr, intervals, profile, regionstats, sites
from methloom.schema import cover_c, decode_context, encode_context, encode_strand

SITE = "chrom string, start long, end long, value double, coverage int, strand byte, context byte, meth long"
REGION = "region_id string, chrom string, rs long, re long, strand byte"


def table(spark, rows, schema=SITE):
    return spark.createDataFrame(rows, schema)


def site(start, m, c, ctx=1, strand=0, chrom="c", width=1):
    return (chrom, start, start + width, m / c, c, strand, ctx, m)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_interval_ends(spark):
    s = table(spark, [site(100, 1, 2)])
    r = table(spark, [("a", "c", 100, 110, 2), ("b", "c", 90, 100, 2), ("empty", "c", 100, 100, 2), ("other", "d", 0, 500, 2), ("null", "c", None, 500, 2), ("nochrom", None, 0, 500, 2)], REGION)
    assert rows(intervals.range_join(s, r), "region_id") == [("a",)]
    assert rows(intervals.range_join(s, r, inclusive=True), "region_id") == [("a",), ("b",), ("empty",)]


def test_range_join_against_brute_force(spark):
    rnd = random.Random(1)
    ss = [(rnd.choice("ab"), p := rnd.randint(0, 400), p + rnd.choice([1, 1, 2, 60]), i) for i in range(150)]
    rr = [(f"r{i}", rnd.choice("ab"), p := rnd.randint(0, 400), p + rnd.choice([0, 1, 30, 200])) for i in range(40)]
    s = spark.createDataFrame(ss, "chrom string, start long, end long, k int")
    r = spark.createDataFrame(rr, "region_id string, chrom string, rs long, re long")
    want = sorted((k, n) for c, a, b, k in ss for n, d, x, y in rr if c == d and b > x and a < y and y > x)
    for b in (7, 64, 10_000, None):
        assert rows(intervals.range_join(s, r, bin_size=b), "k", "region_id") == sorted(want, key=repr)
        assert rows(intervals.range_join(s, r, bin_size=b, how="left_semi"), "k") == sorted({(k,) for k, _ in want}, key=repr)
    points = s.drop("end")
    assert intervals.range_join(points, r, how="left_semi").count() == len({k for c, a, b, k in ss for n, d, x, y in rr if c == d and x <= a < y})


def test_weighted_levels_and_rollup(spark):
    s = table(spark, [site(5, 3, 10, 1), site(8, 1, 10, 2), site(50, 1, 2)])
    r = table(spark, [("r", "c", 0, 20, 2), ("single", "c", 40, 60, 2)], REGION)
    out = regionstats.region_stats(s, r, min_sites=2)
    assert rows(out, "region_id", "context", "level") == [("r", 0, 0.2), ("r", 1, 0.3), ("r", 2, 0.1)]
    both = regionstats.region_stats(table(spark, [site(45, 1, 2, strand=0), site(46, 2, 2, strand=1)]), r, min_sites=2, strand=0)
    assert rows(both, "region_id", "level") == [("single", 0.5), ("single", 0.5)]
    mixed = table(spark, [site(1, 1, 2, strand=0), site(2, 2, 2, strand=1), site(3, 0, 4, strand=1)])
    own = table(spark, [("plus", "c", 0, 20, 0), ("minus", "c", 0, 20, 1), ("any", "c", 0, 20, 2)], REGION)
    by_own = regionstats.region_stats(mixed, own, by_region_strand=True, min_sites=3).where("context = 0")
    assert {(x.region_id, x.level, x.n_sites) for x in by_own.collect()} == {("plus", 0.5, 1), ("minus", 2 / 6, 2), ("any", 3 / 8, 3)}
    assert regionstats.region_stats(mixed, own, strand=1, min_sites=4).count() == 0
    dev = regionstats.region_stats(s, r, "dev")
    assert {(x.region_id, x.context): round(x.level, 9) for x in dev.collect()}[("r", 0)] == round(float(np.std([0.3, 0.1], ddof=1)), 9)
    assert {(x.region_id, x.context): x.level for x in dev.collect()}[("single", 0)] == 0.0
    cov = regionstats.region_stats(s, r, "cov")
    assert {(x.region_id, x.context): x.level for x in cov.collect()}[("r", 0)] == 0.1
    with pytest.raises(ValueError):
        regionstats.region_stats(s, r, "nope").collect()


def test_wide_sites_are_clipped(spark):
    s = table(spark, [site(0, 10, 10, width=10), site(12, 0, 10, width=4)])
    r = table(spark, [("r", "c", 5, 14, 2)], REGION)
    out = {x.context: x.level for x in regionstats.region_stats(s, r, "mean").collect()}
    assert out[0] == pytest.approx(5 / 7)


def test_count_precision(spark):
    df = spark.createDataFrame([(0.29, 50)], "v float, c int")
    got = df.select(cover_c(F.col("v"), F.col("c"), "float").alias("a"), cover_c(F.col("v"), F.col("c"), "double").alias("b")).first()
    assert (got.a, got.b) == (15, 14)


def numbered(spark, tables):
    return sites.numbered([table(spark, t) for t in tables])


def test_overlap_and_merge(spark):
    three = numbered(spark, [[site(1, 1, 2), site(9, 1, 2)], [site(1, 1, 2), site(9, 1, 4)], [site(9, 3, 4)]])
    out = sites.overlap_many(three, 3).collect()
    assert [(r.start, [(x.m, x.coverage) for x in r.counts]) for r in out] == [(9, [(1, 2), (1, 4), (3, 4)])]
    pair = lambda c2: numbered(spark, [[site(1, 5, 10)], [site(1, c2 // 10, c2), site(2, 1, 3)]])
    assert {r.start: (r.value, r.coverage) for r in sites.merge(pair(10)).collect()}[1] == (0.3, 20)
    assert {r.start: r.value for r in sites.merge(pair(10), "mean").collect()}[1] == pytest.approx(0.3)
    m = {r.start: (r.value, r.coverage) for r in sites.merge(numbered(spark, [[site(1, 5, 10)], [site(1, 1, 30), site(2, 1, 3)]])).collect()}
    assert m[1] == (0.15, 40) and m[2] == (1 / 3, 3)
    two = sites.overlap_two(table(spark, [site(1, 1, 2)]), table(spark, [site(1, 1, 4), site(3, 1, 1)])).collect()
    assert [(r.start, r.value_1, r.value_2) for r in two] == [(1, 0.5, 0.25)]
    only = sites.merge(numbered(spark, [[site(4, 1, 3)]])).collect()
    assert [(r.start, r.value, r.coverage, r.strand) for r in only] == [(4, 1 / 3, 3, 0)]


def test_histograms(spark):
    s = table(spark, [site(i, 0, c) for i, c in enumerate([1, 1, 3, 20])])
    h = {r.min_coverage: r.n_sites for r in sites.coverage_histogram(s).collect()}
    assert h == {1: 4, 2: 2, 3: 2, **{k: 1 for k in range(4, 17)}}
    v = table(spark, [site(1, 0, 10), site(2, 1, 10), site(3, 5, 10), site(4, 10, 10)])
    assert rows(sites.level_histogram(v), "bin", "n_sites") == sorted([(-1, 1), (0, 1), (4, 1), (9, 1)], key=repr)
    assert all(r.n_sites == 0 for r in sites.coverage_histogram(s.limit(0)).collect())


def test_sliding_windows(spark):
    s = table(spark, [site(10, 1, 1), site(60, 1, 1), site(110, 0, 1), site(119, 0, 1), site(200, 1, 1)]).drop("end")
    ln = spark.createDataFrame([("c", 120)], "chrom string, length long")
    got = {(r.rs, r.re): r.n_sites for r in regionstats.chrom_stats(s, ln, step=100, move=50).where("context = 0").collect()}
    assert got == {(0, 100): 2, (50, 120): 3, (100, 120): 2}


def test_first_match_and_cells(spark):
    regs = spark.createDataFrame([("A", 1, "c", 0, 50), ("B", 2, "c", 20, 80)], "region_id string, region_idx int, chrom string, rs long, re long")
    s = table(spark, [site(30, 1, 2), site(60, 2, 2)]).withColumn("id", F.lit("x"))
    placed = cells.placed_in_regions(s, regs)
    assert rows(placed, "start", "region_id") == [(30, "A"), (60, "B")]
    gm = cells.group_map(spark.createDataFrame([(1, "x", "g1"), (2, "x", "g2"), (3, None, "g")], "map_row long, cell_id string, group_label string"), "map_row")
    agg = cells.group_aggregate(placed, gm).collect()
    assert {(r.grp, r.region_id, r.n_cells, r.n_sites, r.mean_meth) for r in agg} == {("g1", "A", 1, 1, 0.5), ("g1", "B", 1, 1, 1.0)}
    qc = cells.cell_qc(s.unionByName(s.withColumn("id", F.lit(None).cast("string")))).collect()
    assert [(r.id, r.n_sites, r.total_coverage, r.mean_coverage, r.mean_meth) for r in qc] == [("x", 2, 4, 2.0, 0.75)]
    assert cells.cell_rows(s, context=0).count() == 0


def test_first_match_against_brute_force(spark):
    rnd = random.Random(12)
    regs = [(rnd.choice("ab"), s := rnd.randint(0, 200), s + rnd.choice([0, 1, 5, 40, 150]), rnd.randint(0, 9), f"r{i}") for i in range(40)] + [(None, 0, 9, 0, "n"), ("a", None, 9, 0, "m")]
    pts = [(rnd.choice("ab"), rnd.randint(0, 260), i % 50) for i in range(300)] * 2
    r = spark.createDataFrame(regs, "chrom string, rs long, re long, k int, name string")
    p = spark.createDataFrame(pts, "chrom string, start long, id int")

    def best(c, a, z, inclusive):
        hit = [(k, n) for ch, s, e, k, n in regs if ch == c and s is not None and e + inclusive > s and z > s and a < e + inclusive]
        return min(hit) if hit else None

    for inclusive in (False, True):
        want = sorted((c, s, i, *b) for c, s, i in pts if (b := best(c, s, s + 1, inclusive)))
        assert rows(intervals.first_match(p, r, "k", inclusive), "chrom", "start", "id", "k", "name") == sorted(want, key=repr)
    wide = p.withColumn("end", F.col("start") + 7)
    want = sorted((c, s, i, *b) for c, s, i in pts if (b := best(c, s, s + 7, False)))
    assert rows(intervals.first_match(wide, r, "k"), "chrom", "start", "id", "k", "name") == sorted(want, key=repr)
    assert intervals.first_match(p, r.limit(0), "k").count() == 0 and intervals.first_match(p.limit(0), r, "k").count() == 0


def test_repeated_rows_are_kept(spark):
    regs = table(spark, [("A", "c", 0, 50, 0), ("B", "c", 20, 80, 1), ("any", "c", 70, 90, 2)], REGION).withColumn("region_idx", F.when(F.col("region_id") == "A", 1).otherwise(2))
    twice = table(spark, [site(30, 0, 30), site(30, 10, 10), site(30, 10, 10), site(60, 1, 2), site(75, 1, 2)]).withColumn("id", F.lit("x"))
    m = {r.region_id: (r.n_sites, r.total_coverage, r.mean_meth) for r in cells.cell_matrix(cells.placed_in_regions(twice, regs)).collect()}
    assert m["A"] == (3, 50, 0.4) and sum(n for n, *_ in m.values()) == 5
    kept = sites.view(twice.drop("id"), regions=regs, use_region_strand=True)
    assert rows(kept, "start", "meth") == [(30, 0), (30, 10), (30, 10), (75, 1)]
    wide = table(spark, [site(30, 1, 2, width=40), site(30, 1, 2, width=40), site(95, 1, 2)])
    assert rows(sites.view(wide, regions=regs, use_region_strand=True), "start") == [(30,), (30,)]
    clash = intervals.first_match(twice.withColumn("region_idx", F.lit(7)), regs.select("chrom", "rs", "re", "region_idx"), "region_idx")
    assert {r.r_region_idx for r in clash.collect()} == {1, 2} and {r.region_idx for r in clash.collect()} == {7}


def test_overlap_in_regions(spark):
    regs = table(spark, [("p", "c", 0, 10, 0), ("m", "c", 20, 30, 1)], REGION)
    one = table(spark, [site(1, 1, 2, strand=0), site(2, 1, 2, strand=1), site(25, 1, 2, strand=1), site(30, 1, 4, strand=1), site(50, 1, 2)])
    assert rows(sites.overlap_in_regions([one, one], regs), "start") == [(1,), (25,), (30,)]
    assert rows(sites.overlap_in_regions([one, one, one.where("start <> 25")], regs), "start") == [(1,), (30,)]
    assert rows(sites.overlap_in_regions([one, one], regs, strand=1), "start") == [(25,), (30,)]
    assert rows(sites.overlap_in_regions([one, one], regs, use_region_strand=False), "start") == [(1,), (2,), (25,), (30,)]


def test_body_parts_do_not_swap(spark):
    r = table(spark, [("g", "c", 100, 200, 1)], REGION)
    s = table(spark, [site(95, 1, 1), site(150, 0, 1), site(205, 1, 2)])
    assert {(x.part, x.level) for x in regionstats.body_stats(s, r, extend=10).where("context = 0").collect()} == {("up", 1.0), ("body", 0.0), ("down", 0.5)}


def test_profile_bins(spark):
    r = table(spark, [("p", "c", 1000, 1100, 0), ("m", "c", 1000, 1100, 1), ("short", "c", 5, 7, 0)], REGION)
    b = profile.profile_bins(r, extend=50, step=0.2).collect()
    n = profile.bin_count(0.1)
    plus = sorted((x.bin, x.rs, x.re) for x in b if x.region_id == "p")
    assert len(plus) == 3 * n and plus[0] == (0, 950, 960) and plus[n] == (n, 1000, 1020)
    minus = sorted((x.bin, x.rs, x.re) for x in b if x.region_id == "m")
    assert [x[1:] for x in minus] == [x[1:] for x in plus][::-1]
    assert not [x for x in b if x.region_id == "short"]
    tss = {x.region_id: x.rs for x in profile.profile_bins(r, "tss", extend=100, step=0.2).where("bin = 0").collect()}
    assert tss["p"] == 900


def test_fisher_against_direct_sum():
    rnd = np.random.default_rng(3)
    a, b, c, d = rnd.integers(0, 15, (4, 200))
    got = stats.fisher_two_sided(a, b, c, d)
    for i in range(200):
        A, B, C, D = (int(x[i]) for x in (a, b, c, d))
        m, n, k = A + C, B + D, A + B
        ps = {j: math.comb(m, j) * math.comb(n, k - j) / math.comb(m + n, k) for j in range(max(0, k - n), min(k, m) + 1)}
        assert got[i] == pytest.approx(min(1.0, sum(p for p in ps.values() if p <= ps[A] * (1 + 1e-7))), abs=1e-9)
    assert len(stats.fisher_two_sided([], [], [], [])) == 0


def test_fisher_expression_is_the_same(spark):
    df = spark.createDataFrame([(3, 10, 7, 9), (0, 5, 5, 5), (2, 8, 2, 8)], "a long, b long, c long, d long")
    lf = F.array(*(F.lit(float(x)) for x in stats._log_factorials(60)))
    got = [r.p for r in df.select(stats.fisher_expression(F.col("a"), F.col("b"), F.col("c"), F.col("d"), lf).alias("p")).collect()]
    assert got == pytest.approx(list(stats.fisher_two_sided([3, 0, 2], [10, 5, 8], [7, 5, 2], [9, 5, 8])))


def test_likelihood_fit_is_a_maximum():
    rnd = np.random.default_rng(1)
    for _ in range(6):
        n = rnd.integers(5, 60, 4)
        y = rnd.binomial(n, rnd.random(4))
        x = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
        best = stats.fit_beta_binomial(x[None], y[None], n[None])[0]
        grid = max(
            -stats._evaluate(np.array([[a, b, c]]), x[None], y[None], n[None])[0][0]
            for a in np.linspace(-4, 4, 25) for b in np.linspace(-6, 6, 25) for c in np.linspace(-12, 1, 14)
        )
        assert best >= grid - 1e-6
    same = stats.group_lrt([[(1, 5, 10), (1, 5, 10), (2, 5, 10), (2, 5, 10)], [(1, 60, 60), (1, 59, 60), (2, 1, 60), (2, 0, 60)], []])
    assert same[0] == pytest.approx(1, abs=1e-3) and same[1] < 1e-2 and same[2] == 1.0


def test_adjusted_p(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5])], "k int, p_value double")
    assert rows(dmr.adjust(df, 0.05), "k", "adj_p") == [(0, 0.03), (1, 0.03), (2, 0.03)]
    rnd = random.Random(2)
    ps = [rnd.choice([0.001, 0.004, rnd.random() * 0.01]) for _ in range(300)]
    got = {r.k: r.adj_p for r in dmr.adjust(spark.createDataFrame(list(enumerate(ps)), "k int, p_value double"), 1.0).collect()}
    order = sorted(range(300), key=lambda i: ps[i])
    low, want = 1.0, {}
    for rank in range(300, 0, -1):
        i = order[rank - 1]
        low = min(low, ps[i] * 300 / rank)
        want[i] = low
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    assert dmr.adjust(df.limit(0), 0.05).collect() == []


def test_region_calls(spark):
    loci = spark.createDataFrame([("c", p, 9, 10, 1, 10, 0.8) for p in (100, 150, 180, 220, 1000)] + [("d", 150, 9, 10, 1, 10, 0.8)], "chrom string, start long, m1 long, c1 long, m2 long, c2 long, diff double")
    out = dmr.call_regions(loci, 4, 100).collect()
    assert [(r.chrom, r.start, r.end, r.n_sites, r.level_1, r.hyper, r.hypo) for r in out] == [("c", 100, 220, 4, 0.9, 4, 0)]
    cut = dmr.call_regions(loci, 1, 100, max_span=60).collect()
    assert sorted((r.chrom, r.start, r.end) for r in cut) == [("c", 100, 150), ("c", 180, 220), ("c", 1000, 1000), ("d", 150, 150)]
    assert dmr.call_regions(loci.limit(0), 1, 100).collect() == []


def test_islands_across_partitions(spark):
    rnd = random.Random(4)
    pts = [(rnd.choice("xyy"), rnd.randint(0, 3000)) for _ in range(400)]
    out = intervals.islands(spark.createDataFrame(pts, "k string, p long"), "k", "p", 12).collect()
    want, last = {}, None
    for k, p in sorted(pts):
        new = last is None or last[0] != k or p - last[1] > 12
        want[k, p] = len(set(want.values())) + 1 if new else want[last]
        last = (k, p)
    back = {}
    for r in out:
        assert back.setdefault(r.island, want[r.k, r.p]) == want[r.k, r.p]
    assert len(back) == len(set(want.values()))


def test_group_counts(spark):
    s = numbered(spark, [[site(1, 1, 2), site(2, 1, 2)], [site(1, 2, 2)], [site(1, 0, 4), site(2, 0, 4)], [site(1, 1, 4)]])
    g = F.when(F.col("sample") < 2, 1).otherwise(2)
    strict = sites.group_counts(s, g, 2, 2).collect()
    assert [(r.start, r.m1, r.c1, r.m2, r.c2) for r in strict] == [(1, 3, 4, 1, 8)]
    relaxed = {r.start: r.complete for r in sites.group_counts(s, g, 2, 2, relaxed=True).collect()}
    assert relaxed == {1: True, 2: False}


def test_correlations_and_rows(spark):
    rnd = np.random.default_rng(0)
    x = np.round(rnd.random((60, 3)), 1)
    m = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double, c double")
    p = {(r.sample_a, r.sample_b): r.r for r in analysis.pearson(m, ["a", "b", "c"]).collect()}
    assert p["a", "b"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == t)) for t in v])
    s = {(r.sample_a, r.sample_b): r.r for r in analysis.spearman(m, ["a", "b", "c"]).collect()}
    assert s["b", "c"] == pytest.approx(np.corrcoef(rank(x[:, 1]), rank(x[:, 2]))[0, 1])
    top = analysis.sort_rows(m, ["a", "b", "c"], "median", key="k").first()
    assert top.row_stat == np.median(x, axis=1).max()
    assert analysis.most_variable(m, ["a", "b", "c"], 5, "k").count() == 5
    km = analysis.kmeans_rows(m, ["a", "b", "c"], 3).groupBy("cluster").agg(F.avg((F.col("a") + F.col("b") + F.col("c")) / 3).alias("m")).orderBy("cluster").collect()
    assert [r.m for r in km] == sorted((r.m for r in km), reverse=True)
    w = analysis.ward_rows(m, "k", ["a", "b", "c"], 3)
    assert w.select("cluster").distinct().count() == 3 and w.count() == 60
    with pytest.raises(ValueError):
        analysis.ward_rows(m, "k", ["a"], 2, max_rows=10)
    assert len(analysis.principal_components(m, ["a", "b", "c"], 2).first().pc) == 2


def test_codes(spark):
    df = spark.createDataFrame([("+", " cg"), ("-", "CHH"), ("?", "CN"), (None, None)], "s string, c string")
    got = [tuple(r) for r in df.select(encode_strand(F.col("s")), encode_context(F.col("c")), decode_context(encode_context(F.col("c")))).collect()]
    assert got == [(0, 1, "CG"), (1, 3, "CHH"), (None, None, None), (None, None, None)]


def test_zoom(spark):
    s = table(spark, [site(i * 7, i % 5, 5) for i in range(60)])
    a = {(r.win_start): (r.n, round(r.sum_value, 9)) for r in sites.zoom(s, 64).collect()}
    b = {(r.win_start): (r.n, round(r.sum_value, 9)) for r in sites.rezoom(sites.zoom(s, 16), 64).collect()}
    assert a == b and list(sites.zoom_levels(s, 2)) == [16, 64]
    z = sites.zoom_stats(sites.zoom(s, 64), 64, table(spark, [("r", "c", 0, 128, 2)], REGION)).first()
    inside = [(i % 5) / 5 for i in range(60) if i * 7 < 128]
    assert z.mean_value == pytest.approx(np.mean(inside)) and z.dev_value == pytest.approx(np.std(inside, ddof=1)) and z.sum_value == pytest.approx(sum(inside))
    sm = sites.summary(s).first()
    assert (sm.n_bases, sm.min_value, sm.max_value) == (60, 0.0, 0.8)
