"""Queries of the general data problems over the driver tables, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import table
from methloom.operators.balanced import balanced_aggregate, heavy_keys
from methloom.operators.imputation import FILLED, count_or_null, identifier_or_null, impute_counts, impute_identifiers, with_fills
from methloom.operators.periods import canonical_names, periods_and_gaps


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    bed = canonical_names(table(spark, d, "regions_bed").select("track", "chrom", "start_pos", "end_pos"), "chrom", table(spark, d, "chrom_alias"), "alias_name", "chrom")
    return periods_and_gaps(bed, ["track", "chrom"], "start_pos", "end_pos")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def of(tbl: str, key: str, order: str) -> DataFrame:
        return heavy_keys(table(spark, d, tbl), key, order, 40).select(F.lit(tbl).alias("tbl"), F.lit(key).alias("field_name"), F.col(key).alias("key_value"))

    return of("site_proportions", "chrom", "row_id").unionByName(of("sc_qc", "cell_id", "qc_id"))


def p4_chrom_sums(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "site_proportions")
    return balanced_aggregate(t, "chrom", "row_id", {"n_rows": ("count", None), "sum_meth": ("sum", count_or_null("meth")), "sum_total": ("sum", count_or_null("total"))})


def p4_cell_sums(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sc_qc")
    # Levels above 1 are percents; summed as whole millionths, so that the order of addition can't show.
    level = F.round(F.when(F.col("mean_meth") > 1, F.col("mean_meth") / 100).otherwise(F.col("mean_meth")) * 1e6).cast("long")
    out = balanced_aggregate(
        t, "cell_id", "qc_id",
        {"n_rows": ("count", None), "n_sites": ("sum", "n_sites"), "total_coverage": ("sum", "total_coverage"), "_m": ("sum", level), "_n": ("count", level)},
    )
    return out.select("cell_id", "n_rows", "n_sites", "total_coverage", (F.col("_m").cast("double") / F.when(F.col("_n") > 0, F.col("_n")) / 1e6).alias("mean_meth"))


def _site_fills(spark: SparkSession, d: str) -> DataFrame:
    return impute_counts(table(spark, d, "site_proportions"), "row_id", "site_name", "meth", "total")


def _cell_fills(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sc_matrix")
    return impute_identifiers(t, "row_id", ["library_id", "cell_row"], "cell_id", tuple(c for c in ("mean_meth", "coverage") if c in t.columns))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sites, cells = _site_fills(spark, d), _cell_fills(spark, d)
    filled = sites.select(
        "row_id", F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("v"), F.col(f"{c}_status").alias("s")) for c in ("meth", "total")))).alias("x")
    ).where((F.col("x.s") == FILLED) & F.col("x.v").isNotNull())
    a = filled.select(F.lit("site_proportions").alias("tbl"), "row_id", F.col("x.f").alias("field_name"), F.lit("").alias("filled_cell_id"))
    b = cells.where(F.col("cell_id_status") == FILLED).select(F.lit("sc_matrix").alias("tbl"), "row_id", F.lit("cell_id").alias("field_name"), F.col("cell_id").alias("filled_cell_id"))
    return a.unionByName(b)


def p5_sites_filled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "site_proportions")
    return with_fills(t, _site_fills(spark, d), "row_id", {"meth": count_or_null("meth"), "total": count_or_null("total")})


def p5_cells_filled(spark: SparkSession, d: str) -> DataFrame:
    return with_fills(table(spark, d, "sc_matrix"), _cell_fills(spark, d), "row_id", {"cell_id": identifier_or_null("cell_id")})


def p5_site_marks(spark: SparkSession, d: str) -> DataFrame:
    """The marks of all rows with what they hold of observed values; a filled value is a draw, so only its being there is told."""
    f = p5_sites_filled(spark, d)
    seen = lambda c: F.when(F.col(f"{c}_status") == "observed", F.col(c)).alias(f"{c}_observed")
    return f.select("row_id", "site_name", *(c for n in ("meth", "total") for c in (f"{n}_status", seen(n), F.col(n).isNotNull().alias(f"has_{n}"))))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_chrom_sums, p4_cell_sums, p5_found, p5_sites_filled, p5_site_marks, p5_cells_filled)}

_IDENT = "trim(lower(cell_id)) NOT IN ('', '-', 'na', 'n/a', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'missing', 'not available', '?', '.', '--', '#n/a', '<na>', '(none)', '(null)')"

SQL = {
    "p3_found": """
WITH r AS (
  SELECT b.region_id, b.track, a.chrom, b.start_pos AS s, b.end_pos AS e FROM regions_bed b LEFT JOIN chrom_alias a ON b.chrom = a.alias_name
  WHERE b.start_pos >= 0 AND b.end_pos > b.start_pos),
m AS (SELECT *, MAX(e) OVER (PARTITION BY track, chrom ORDER BY s, e, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
i AS (SELECT *, SUM(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY track, chrom ORDER BY s, e, region_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT track, chrom, island, MIN(s) AS s, MAX(e) AS e FROM i GROUP BY 1, 2, 3),
g AS (SELECT track, chrom, e AS s, LEAD(s) OVER (PARTITION BY track, chrom ORDER BY island) AS e FROM p)
SELECT 'merged' AS kind, track, chrom, s AS start_pos, e AS end_pos FROM p
UNION ALL SELECT 'gap', track, chrom, s, e FROM g WHERE e IS NOT NULL""",
    "p4_found": """
SELECT 'site_proportions' AS tbl, 'chrom' AS field_name, chrom AS key_value FROM site_proportions WHERE chrom IS NOT NULL
GROUP BY chrom HAVING COUNT(*) * 40 >= (SELECT COUNT(*) FROM site_proportions)
UNION ALL
SELECT 'sc_qc', 'cell_id', cell_id FROM sc_qc WHERE cell_id IS NOT NULL
GROUP BY cell_id HAVING COUNT(*) * 40 >= (SELECT COUNT(*) FROM sc_qc)""",
    "p4_chrom_sums": """
SELECT chrom, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN meth >= 0 THEN meth END) AS BIGINT) AS sum_meth,
  CAST(SUM(CASE WHEN total >= 0 THEN total END) AS BIGINT) AS sum_total FROM site_proportions GROUP BY chrom""",
    "p4_cell_sums": """
SELECT cell_id, COUNT(*) AS n_rows, CAST(SUM(n_sites) AS BIGINT) AS n_sites, CAST(SUM(total_coverage) AS BIGINT) AS total_coverage,
  CAST(SUM(lv) AS DOUBLE) / NULLIF(COUNT(lv), 0) / 1e6 AS mean_meth
FROM (SELECT *, CAST(ROUND(CASE WHEN mean_meth > 1 THEN mean_meth / 100 ELSE mean_meth END * 1e6) AS BIGINT) AS lv FROM sc_qc) q GROUP BY cell_id""",
    "p5_site_marks": """
WITH s AS (SELECT row_id, site_name, CASE WHEN meth >= 0 THEN meth END AS m, CASE WHEN total >= 0 THEN total END AS t FROM site_proportions),
g AS (SELECT site_name, COUNT(m) AS nm, COUNT(t) AS nt FROM s GROUP BY site_name)
SELECT row_id, s.site_name, CASE WHEN m IS NOT NULL THEN 'observed' WHEN nm > 0 THEN 'filled' ELSE 'missing' END AS meth_status, m AS meth_observed, m IS NOT NULL OR COALESCE(nm, 0) > 0 AS has_meth,
  CASE WHEN t IS NOT NULL THEN 'observed' WHEN nt > 0 THEN 'filled' ELSE 'missing' END AS total_status, t AS total_observed, t IS NOT NULL OR COALESCE(nt, 0) > 0 AS has_total
FROM s LEFT JOIN g ON s.site_name = g.site_name""",
    "p5_cells_filled": f"""
WITH c AS (SELECT *, CASE WHEN {_IDENT} THEN cell_id END AS own FROM sc_matrix),
b AS (SELECT library_id, cell_row, MIN(own) AS best FROM c WHERE library_id IS NOT NULL AND cell_row IS NOT NULL GROUP BY library_id, cell_row)
SELECT c.row_id, c.library_id, c.cell_row, c.region_idx, c.mean_meth, c.coverage, c.loaded_at, COALESCE(own, best) AS cell_id,
  CASE WHEN own IS NOT NULL THEN 'observed' WHEN best IS NOT NULL THEN 'filled' ELSE 'missing' END AS cell_id_status
FROM c LEFT JOIN b ON c.library_id = b.library_id AND c.cell_row = b.cell_row""",
    "p5_found": f"""
WITH s AS (SELECT row_id, site_name, CASE WHEN meth >= 0 THEN meth END AS meth, CASE WHEN total >= 0 THEN total END AS total FROM site_proportions),
g AS (SELECT site_name, COUNT(meth) AS nm, COUNT(total) AS nt FROM s GROUP BY site_name),
c AS (SELECT row_id, library_id, cell_row, CASE WHEN {_IDENT} THEN cell_id END AS cell_id FROM sc_matrix),
v AS (SELECT library_id, cell_row, cell_id, COUNT(*) AS n FROM c WHERE cell_id IS NOT NULL AND library_id IS NOT NULL AND cell_row IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT library_id, cell_row, cell_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY library_id, cell_row ORDER BY n DESC, cell_id) AS k FROM v) x WHERE k = 1)
SELECT 'site_proportions' AS tbl, row_id, 'meth' AS field_name, '' AS filled_cell_id FROM s JOIN g USING (site_name) WHERE meth IS NULL AND nm > 0
UNION ALL SELECT 'site_proportions', row_id, 'total', '' FROM s JOIN g USING (site_name) WHERE total IS NULL AND nt > 0
UNION ALL SELECT 'sc_matrix', c.row_id, 'cell_id', b.cell_id FROM c JOIN b ON c.library_id = b.library_id AND c.cell_row = b.cell_row WHERE c.cell_id IS NULL""",
}
