"""Percentiles of run days and of all days."""


def test_p2_run_days_are_combined_per_chrom_and_context(spark):
    from methloom.llm.queries import PROBS, QUERIES

    d = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{d}/site_proportions.parquet").where("total >= 0").selectExpr(
        "date_format(run_at, 'yyyy-MM-dd') day", "chrom", "context", "total").where("trim(chrom) <> '' and context = 'CG'").collect()
    got = {(r.run_day, r.chrom, r.context, r.prob): (r.n, r.value) for r in QUERIES["p2_day_chrom_percentiles"](spark, d).collect()}
    days = {k[0] for k in got}
    assert "(all)" in days and len(days) > 2 and {r.chrom for r in t} <= {k[1] for k in got}
    # The days of a chrom and context add up to all of them.
    for c in {k[1] for k in got}:
        assert sum(got.get((x, c, "CG", 0.5), (0, 0))[0] for x in days - {"(all)"}) == got.get(("(all)", c, "CG", 0.5), (0, 0))[0]
    whole = {(r.chrom, r.context, r.prob): (r.n, r.value) for r in QUERIES["p2_percentiles"](spark, d).where("sample_id = '(all)'").collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "(all)"} == whole
