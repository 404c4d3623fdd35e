"""Result texts read again; files by prefix; bigWig files; tables in the order of the input."""

import pytest
from pyspark.sql import functions as F

from methloom.operators import analysis, dmr
from methloom.schema import fixed
from methloom.sources import binary, results, sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_parsers(spark):
    m = results.parse_matrix(lines(spark, "g1\t0.5\tnan\t0.25", "", "# head x", "g2 nan NA 1"))
    assert sorted(map(tuple, m.collect()), key=repr) == sorted([("g1", 0, 0.5), ("g1", 1, None), ("g1", 2, 0.25), ("g2", 0, None), ("g2", 1, None), ("g2", 2, 1.0)], key=repr)
    assert {r.level for r in results.parse_matrix(lines(spark, "g nan"), missing=0.0).collect()} == {0.0}
    assert [tuple(r) for r in results.parse_average(lines(spark, "CG 0.1 nan", "zz 1")).orderBy("bin").collect()] == [(1, 0, 0.1), (1, 1, None)]
    assert [tuple(r) for r in results.parse_levels(lines(spark, "c 5 + 0.25 CHH", "c 6 - NA CG", "bad")).collect()] == [("c", 5, 0, 0.25, 3)]
    assert [(r.start, r.meth, r.coverage, r.id, r.value) for r in results.parse_counts(lines(spark, "c 5 + 1 4 i", "c 6 + 2 4 + j", "c 7 + 0 0 k")).orderBy("start").collect()] == [(5, 1, 4, "i", 0.25), (6, 2, 4, "j", 0.5)]
    v = lines(spark, "c 1 2 0.5 9 + CG", "c 2 3 0.5 9 + C", "c 3 4 nan 9 + CHG")
    assert results.parse_view(v).count() == 3 and [r.start for r in results.parse_view(v, "All").orderBy("start").collect()] == [1, 3] and results.parse_view(v, "C").count() == 1
    assert [(r.bin, r["values"]) for r in results.parse_histogram(lines(spark, "bin n pct", "1 10 0.5")).collect()] == [("1", [10.0, 0.5])]
    assert results.parse_matrix(lines(spark)).collect() == []


def test_outer_merge(spark):
    one = spark.createDataFrame([("c", 1, 2, 0.5), ("c", 3, 4, float("nan")), ("c", 5, 6, 0.1), ("c", 5, 6, 0.3)], "chrom string, start long, end long, value double")
    two = spark.createDataFrame([("c", 1, 2, 0.25), ("c", 3, 4, 1.0), ("c", 9, 10, None)], one.schema)
    assert [tuple(r) for r in analysis.outer_merge({"a": one, "b": two}).collect()] == [("c", 1, 2, 0.5, 0.25)]
    whole = {r.start: (r.a, r.b) for r in analysis.outer_merge({"a": one, "b": two}, complete=False).collect()}
    assert whole == {1: (0.5, 0.25), 3: (None, 1.0), 5: (0.2, None)}


def test_numbers_round_by_their_binary_value(spark):
    values = [0.69375, 0.35625, 0.125, 0.375, -0.125, -0.0, 0.0, 2.675, 1e-9, 123456.5, 5e9, 1 / 3, 0.45, 1.005, 0.58625, *(m / 1600 for m in range(1, 1600, 7))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 2, 4):
        assert [r.t for r in df.select(fixed(F.col("v"), d).alias("t")).collect()] == [f"{v:.{d}f}" for v in values]
    assert spark.createDataFrame([(None,)], "v double").select(fixed(F.col("v"), 2).alias("t")).first().t is None


def test_bigwig(spark, tmp_path):
    rows = [("c2", p, p + 2, (p % 7) / 8, p % 2) for p in range(0, 9000, 3)] + [("c1", 5, 6, 1.0, 0), ("zz", 1, 2, 0.5, 0), ("c1", 9, 10, None, 0)]
    s = spark.createDataFrame(rows, "chrom string, start long, end long, value double, strand int").repartition(3)
    sizes = spark.createDataFrame([("c1", 100), ("c2", 10_000)], "chrom string, length long")
    sinks.write_bigwig(s, sizes, str(tmp_path / "x.bw"))
    got = sorted(tuple(r) for r in binary.read_binary(spark, str(tmp_path / "x.bw")).select("chrom", "start", "end", "value").collect())
    assert got == sorted(r[:4] for r in rows if r[0] != "zz" and r[3] is not None)
    assert binary.read_binary(spark, str(tmp_path / "x.bw"), chrom="c2", start=30, end=60).count() == sum(r[0] == "c2" and r[1] < 60 and r[2] > 30 for r in rows)
    assert len(binary.Layout(str(tmp_path / "x.bw")).blocks) == 4 and binary.Layout(str(tmp_path / "x.bw")).levels == 2
    sinks.write_bigwig(s, sizes, str(tmp_path / "m.bw"), merge_strands=True)
    assert binary.read_binary(spark, str(tmp_path / "m.bw")).agg(F.min("value").alias("m")).first().m < 0
    sinks.write_bigwig(s.limit(0), sizes, str(tmp_path / "e.bw"))
    assert binary.read_binary(spark, str(tmp_path / "e.bw")).count() == 0


def test_files_and_orders(spark, tmp_path):
    stats = spark.createDataFrame([("r1", 0, 0.5), ("r1", 1, None), ("r2", 1, 0.25)], "region_id string, context int, level double")
    regs = spark.createDataFrame([("r1", "c", 0, 9), ("r2", "c", 20, 30)], "region_id string, chrom string, rs long, re long")
    sinks.write_prefix_files(sinks.by_context(lambda c: sinks.region_level_lines(stats, regs, c)), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out.cg")).orderBy("value").collect()] == ["c\t0\t9\tNA\tr1", "c\t20\t30\t0.250000\tr2"]
    groups = spark.createDataFrame([("g2", "r1", 1, 2, 10, 5.0, 0.5), ("g1", "r2", 1, 1, 4, 4.0, 1.0)], "grp string, region_id string, n_cells long, n_sites long, total_coverage long, mean_coverage double, mean_meth double")
    assert [r.value for r in sinks.group_lines(groups, regs).collect()][1] == "g1\tc\t20\t30\t1\t1\t4\t4.000000\t1.000000"
    assert [r.value for r in sinks.group_names(groups).collect()] == ["g1", "g2"]
    avg = spark.createDataFrame([(1, 0, 0.5, 3)], "context int, bin int, level double, n_regions long")
    assert [r.value for r in sinks.profile_average_lines(avg, 2).collect()] == ["CG\t0.500000\tnan"]
    (tmp_path / "s").write_text("#c\nb\t5\na\t1\nb\t9\n")
    sizes = spark.createDataFrame([("a", 10), ("b", 20), ("x", 1)], "chrom string, length long")
    by_input = text.chrom_dictionary(sizes, text.first_rows(spark.read.text(str(tmp_path / "s"))), order="at")
    assert [r.chrom for r in by_input.orderBy("tid").collect()] == ["b", "a", "x"]
    loci = spark.createDataFrame([("b", 1, 0.01, 0.02, 1, 2, 1, 2, 0.5), ("a", 9, 0.01, 0.02, 1, 2, 1, 2, 0.5), ("a", 1, 0.001, 0.02, 1, 2, 1, 2, 0.5)], "chrom string, start long, p_value double, adj_p double, m1 long, c1 long, m2 long, c2 long, diff double")
    assert [(r.chrom, r.start) for r in dmr.sites_report(loci, dictionary=by_input).collect()] == [("a", 1), ("b", 1), ("a", 9)]
    with pytest.raises(ValueError):
        text.parse_sites(lines(spark, "x"), "nothing")


def test_ranks_by_either_way(spark, monkeypatch):
    m = spark.createDataFrame([(float(i % 5), float(-i) if i % 7 else None) for i in range(40)], "a double, b double")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    few = key(analysis.average_ranks(m, ["a", "b"]))
    monkeypatch.setattr(analysis, "BROADCAST_ROWS", 3)
    assert key(analysis.average_ranks(m, ["a", "b"])) == few
    assert {r[0] for r in few} == {4.5, 12.5, 20.5, 28.5, 36.5}
    assert analysis.exact_quantiles(m, [F.col("a"), F.lit(None)], 0.5) == [2.0, None]
