"""Queries that give the whole of what their problem asks for."""


def test_p5_cells_filled_has_every_row_with_its_mark(spark, tmp_path):
    from methloom.plans.problems import QUERIES

    rows = [(1, "l", 1, 0, "A"), (2, "l", 1, 1, " N/A "), (3, "l", 1, 2, None), (4, "l", 2, 0, None), (5, None, 1, 0, ""), (6, "l", 1, 1, "A")]
    spark.createDataFrame(rows, "row_id long, library_id string, cell_row int, region_idx int, cell_id string").write.parquet(f"{tmp_path}/sc_matrix.parquet")
    got = {r.row_id: (r.region_idx, r.cell_id, r.cell_id_status) for r in QUERIES["p5_cells_filled"](spark, str(tmp_path)).collect()}
    assert got == {
        1: (0, "A", "observed"), 2: (1, "A", "filled"), 3: (2, "A", "filled"), 4: (0, None, "missing"), 5: (0, None, "missing"), 6: (1, "A", "observed"),
    }
