"""Brute-force checks of the general data problems."""

import random

from methloom.operators.balanced import balanced_aggregate, heavy_keys
from methloom.operators.imputation import impute_counts, impute_identifiers, with_fills, count_or_null
from methloom.operators.periods import canonical_names, periods_and_gaps

IV = "track string, chrom string, s long, e long, kind string, _s int"


def brute_periods(rows):
    out, by = [], {}
    for t, c, s, e, *_ in rows:
        if s is not None and e is not None and s >= 0 and e > s:
            by.setdefault((t, c), []).append((s, e))
    for (t, c), iv in by.items():
        iv.sort()
        done = [list(iv[0])]
        for s, e in iv[1:]:
            if s > done[-1][1]:
                done.append([s, e])
            else:
                done[-1][1] = max(done[-1][1], e)
        out += [("merged", t, c, s, e) for s, e in done]
        out += [("gap", t, c, a[1], b[0]) for a, b in zip(done, done[1:])]
    return sorted(out, key=repr)


def test_periods_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(700):
        t = rnd.choice(["hot"] * 5 + ["a", "b", None])
        s = rnd.choice([None, -3, *range(0, 900)])
        e = None if rnd.random() < 0.03 else (s or 0) + rnd.randint(-2, 9)
        rows.append((t, rnd.choice(["c1", None]), s, e, "x", i))
    rows += rows[:60]
    df = spark.createDataFrame(rows, IV)
    for block in (7, 1 << 17):
        got = [tuple(r) for r in periods_and_gaps(df, ["track", "chrom"], "s", "e", block_rows=block).collect()]
        assert sorted(got, key=repr) == brute_periods(rows)


def test_periods_empty_and_touching(spark):
    assert periods_and_gaps(spark.createDataFrame([], IV), ["track", "chrom"], "s", "e").collect() == []
    df = spark.createDataFrame([("a", "c", 0, 5, None, 1), ("a", "c", 5, 9, None, 1), ("a", "c", 2, 3, None, 1)], IV)
    assert [tuple(r) for r in periods_and_gaps(df, ["track", "chrom"], "s", "e").collect()] == [("merged", "a", "c", 0, 9)]


def test_canonical_names(spark):
    al = spark.createDataFrame([("1", "chr1"), ("1", "chr1"), ("chr1", "chr1"), (None, "x")], "alias string, chrom string")
    df = spark.createDataFrame([("1", 1), ("zz", 2), (None, 3)], "chrom string, alias int")
    assert {(r.chrom, r.alias) for r in canonical_names(df, "chrom", al, "alias", "chrom").collect()} == {("chr1", 1), (None, 2), (None, 3)}


def test_balanced_aggregate(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", "c", None]), rnd.choice([i, 3, None]), rnd.choice([None, 1, 2, 5]), "n") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v int, _k string")
    got = {r.k: (r.n, r.s, r.lo, r.hi, r.m) for r in balanced_aggregate(df, "k", "o", {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}, 6).collect()}
    for k in {r[0] for r in rows}:
        vs = [r[2] for r in rows if r[0] == k and r[2] is not None]
        assert got[k] == (sum(r[0] == k for r in rows), sum(vs), min(vs), max(vs), sum(vs) / len(vs))
    assert {r.k for r in heavy_keys(df, "k", "o", 3).collect()} == {"hot"}
    # Every partition of the ranged rows holds a like share, although one key has most rows.
    sizes = df.repartitionByRange(6, "k", "o").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert max(sizes) < 250
    assert balanced_aggregate(df.limit(0), "k", "o", {"n": ("count", None)}).collect() == []


def test_impute_counts(spark):
    rnd = random.Random(3)
    rows, truth = [], {}
    for g in range(120):
        depth, level = rnd.choice([8, 40, 200]), rnd.random()
        for _ in range(6):
            t = max(1, int(rnd.gauss(depth, depth / 8)))
            m = sum(rnd.random() < level for _ in range(t))
            k = len(rows)
            truth[k] = (m, t)
            rows.append((k, f"g{g}", m if rnd.random() > 0.15 else rnd.choice([None, -1, -99]), t if rnd.random() > 0.15 else None, "x"))
    rows += [(9000, "alone", None, None, "x"), (9001, None, None, 4, "x"), (9002, "half", None, 7, "x"), (9003, "half", None, None, "x")]
    df = spark.createDataFrame(rows, "id int, g string, m int, t int, m_status string")
    out = {r.id: r for r in impute_counts(df, "id", "g", "m", "t").collect()}
    assert set(out) == {r[0] for r in rows if r[2] is None or r[2] < 0 or r[3] is None}
    assert (out[9000].m, out[9000].m_status, out[9000].t_status) == (None, "missing", "missing")
    assert (out[9001].m_status, out[9001].t, out[9001].t_status) == ("missing", 4, "observed")
    assert (out[9002].m_status, out[9003].t, out[9003].t_status, out[9003].m_status) == ("missing", 7, "filled", "missing")
    err = naive = n = 0
    by = {}
    for r in rows:
        if r[2] is not None and r[2] >= 0:
            by.setdefault(r[1], []).append(r[2])
    everything = [v for vs in by.values() for v in vs]
    for k, r in out.items():
        if k in truth and r.m_status == "filled":
            assert 0 <= r.m and (r.t is None or r.m <= r.t)
            err += abs(r.m - truth[k][0]) / truth[k][1]
            naive += abs(sum(everything) / len(everything) - truth[k][0]) / truth[k][1]
            n += 1
    assert n > 50 and err < 0.35 * naive
    whole = with_fills(df, impute_counts(df, "id", "g", "m", "t"), "id", {"m": count_or_null("m"), "t": count_or_null("t")})
    assert whole.count() == len(rows) and set(whole.columns) == {"id", "g", "m", "t", "m_status", "t_status"}
    assert impute_counts(df.limit(0), "id", "g", "m", "t").collect() == []


def test_impute_identifiers(spark):
    rows = [(1, "l", 1, "A"), (2, "l", 1, " N/A "), (3, "l", 1, "B"), (4, "l", 1, "B"), (5, "l", 2, None), (6, None, 1, ""), (7, None, 1, "Z"), (8, "l", 3, "-"), (9, "l", 3, "D"), (10, "l", 3, "C")]
    df = spark.createDataFrame(rows, "id int, lib string, row int, cell string")
    got = {r.id: (r.cell, r.cell_status) for r in impute_identifiers(df, "id", ["lib", "row"], "cell").collect()}
    assert got == {2: ("B", "filled"), 5: (None, "missing"), 6: (None, "missing"), 8: ("C", "filled")}


def test_identifiers_are_classified_by_their_features(spark):
    rnd = random.Random(6)
    rows, truth = [], {}
    for i in range(400):
        c = "AB"[i % 3 == 0]
        truth[i] = c
        rows.append((i, "l", 1, c if rnd.random() > 0.2 else " none", rnd.gauss(0.2 if c == "A" else 0.8, 0.05) if i % 7 else None, float("nan")))
    rows += [(900, "l", 2, "C", 0.5, 1.0), (901, "l", 2, None, 0.5, 1.0), (902, None, 1, None, 0.8, None), (903, "l", 1, None, None, None)]
    df = spark.createDataFrame(rows, "id int, lib string, row int, cell string, level double, cover double")
    got = {r.id: (r.cell, r.cell_status) for r in impute_identifiers(df, "id", ["lib", "row"], "cell", ("level", "cover")).collect()}
    assert set(got) == {r[0] for r in rows if r[3] in (None, " none")}
    assert got[901] == ("C", "filled") and got[902] == (None, "missing") and got[903] == ("A", "filled")
    assert all(got[i] == (truth[i] if i % 7 else "A", "filled") for i in got if i < 900)
    drawn = {r.id: r.cell for r in impute_identifiers(df, "id", ["lib", "row"], "cell", draw=True).collect() if r.id < 900}
    assert {"A", "B"} == set(drawn.values()) and drawn == {r.id: r.cell for r in impute_identifiers(df, "id", ["lib", "row"], "cell", draw=True).collect() if r.id < 900}


def test_counts_beyond_an_int(spark):
    big = 3 << 32
    df = spark.createDataFrame([(1, "g", big, 2 * big), (2, "g", None, 2 * big), (3, "g", big, None), (4, None, None, 5)], "id int, g string, m long, t long")
    got = {r.id: r for r in impute_counts(df, "id", "g", "m", "t", residual=False).collect()}
    assert got[2].m == big and got[3].t == 2 * big and got[4].m is None


def test_durable_tables_are_released(spark, tmp_path):
    from methloom import core

    core.release(spark)
    t = core.durable(spark.range(5))
    assert t.count() == 5 and core.release(spark) == 1 and core.release(spark) == 0


def test_dense_index(spark):
    from methloom.core import dense_index

    df = spark.createDataFrame([(k % 7, k % 3) for k in range(200)], "a int, b int")
    rows = sorted((r.g, r.a, r.b) for r in dense_index(df, ["a", "b"], "g").collect())
    assert [g for g, *_ in rows] == list(range(200)) and [(a, b) for _, a, b in rows] == sorted((k % 7, k % 3) for k in range(200))
