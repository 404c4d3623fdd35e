"""Groups of cells that the usual inputs leave out: sparse cells, cells without name, mixed groups."""

from pyspark.sql import functions as F
from test_llm import cells_input

from methloom.llm.spectral import cell_pairs, cell_table, purified, spectral_groups


def test_sparse_cells_find_their_mates(spark):
    m, qc, true = cells_input(spark)
    thin = m.where(F.abs(F.xxhash64("cell_row", "region_idx") % 10) >= 4)
    pairs = {(r.cell_id_a, r.cell_id_b) for r in cell_pairs(spectral_groups(cell_table(thin, qc))).collect()}
    expected = {(a, b) for a in true for b in true if a < b and true[a] == true[b]}
    assert pairs <= expected and len(pairs) >= 0.97 * len(expected)


def test_groups_hold_unnamed_cells(spark, tmp_path):
    from methloom.llm.queries import p1_groups

    m, qc, true = cells_input(spark, 6)
    m.write.parquet(f"{tmp_path}/sc_matrix.parquet")
    qc.write.parquet(f"{tmp_path}/sc_qc.parquet")
    rows = p1_groups(spark, str(tmp_path)).collect()
    # Beside the named cells LONELYCELL-00 and row 9999, which no row names.
    assert sum(r.n_cells for r in rows) == len(true) + 2
    assert [r.n_cells for r in rows if r.typical_cells == ["(unnamed) lib:9999"]] == [1]


def test_a_mix_of_many_groups_is_parted(spark):
    rows = [(f"C{g}{k}", "mix", 0.5 - g / 100, 0.5, [g / 6 + k / 100] * 4) for g in range(6) for k in range(3)]
    groups = spark.createDataFrame(rows, "cell_id string, grp string, affinity double, level double, vals array<double>")
    members = {}
    for r in purified(groups).collect():
        members.setdefault(r.grp, set()).add(r.cell_id)
    assert sorted(map(sorted, members.values())) == [[f"C{g}{k}" for k in range(3)] for g in range(6)]
    assert purified(groups.limit(0)).collect() == []


def test_mates_left_under_different_labels_are_compared(spark, tmp_path):
    from methloom.llm.queries import p1_found

    m, qc, true = cells_input(spark)
    m.where(F.abs(F.xxhash64("cell_row", "region_idx") % 10) >= 4).write.parquet(f"{tmp_path}/sc_matrix.parquet")
    qc.write.parquet(f"{tmp_path}/sc_qc.parquet")
    rows = [tuple(r) for r in p1_found(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted((a, b) for a in true for b in true if a < b and true[a] == true[b])
    # No move at all: every pair across two labels that meet.
    g = spark.createDataFrame([("a", "y", 0.0, 0.5, [0.5]), ("b", "x", 0.0, 0.5, [0.5]), ("c", "x", 0.0, 0.9, [0.5])], "cell_id string, grp string, affinity double, level double, vals array<double>")
    meet = spark.createDataFrame([("x", "y")], "ga string, gb string")
    assert [tuple(r) for r in cell_pairs(g, meetings=meet).collect()] == [("a", "b")]


def test_heavy_groups_are_compared_in_blocks(spark):
    from methloom.llm.spectral import groups_and_meetings

    m, qc, true = cells_input(spark, 12)
    groups, meetings = groups_and_meetings(cell_table(m, qc))
    expected = sorted((a, b) for a in true for b in true if a < b and true[a] == true[b])
    for block in (3, 2048):
        assert sorted(tuple(r) for r in cell_pairs(groups, meetings=meetings, block=block).collect()) == expected
    # All cells under one label, and a meeting of two labels that both are split.
    one = groups.withColumn("grp", F.lit(1)).cache()
    assert sorted(tuple(r) for r in cell_pairs(one, block=4).collect()) == expected
    two = groups.withColumn("grp", F.abs(F.xxhash64("cell_id")) % 2)
    meet = spark.createDataFrame([(0, 1)], "ga long, gb long").select(F.col("ga"), F.col("gb"))
    assert sorted(tuple(r) for r in cell_pairs(two, meetings=meet, block=4).collect()) == expected
    assert cell_pairs(one.limit(0), block=4).collect() == []


def test_panel_without_parting_features(spark):
    rows = [(i, "l", c, r, f"C{c}", 0.5 + (c % 2) * 0.01) for i, (c, r) in enumerate((c, r) for c in range(6) for r in range(5))]
    m = spark.createDataFrame(rows, "row_id long, library_id string, cell_row int, region_idx int, cell_id string, mean_meth double")
    qc = spark.createDataFrame([(f"C{c}", 0.2 if c < 4 else 0.9) for c in range(6)], "cell_id string, mean_meth double")
    got = {tuple(r) for r in cell_pairs(spectral_groups(cell_table(m, qc))).collect()}
    assert got == {(f"C{a}", f"C{b}") for a in range(6) for b in range(a + 1, 6) if (a < 4) == (b < 4)}
    assert len({r.grp for r in spectral_groups(cell_table(m, qc)).collect()}) == 2


def test_lloyd_ends_at_the_means():
    import numpy as np

    from methloom.llm.spectral import _lloyd

    rng = np.random.default_rng(2)
    centres = rng.uniform(-1, 1, (30, 4))
    points = np.repeat(centres, 9, axis=0) + rng.normal(0, 0.003, (270, 4))
    near = _lloyd(points, np.ones(len(points)))
    assert len(set(near)) == 30 and all(len(set(near[i : i + 9])) == 1 for i in range(0, 270, 9))
    assert _lloyd(points[:1], np.ones(1)).tolist() == [0]
