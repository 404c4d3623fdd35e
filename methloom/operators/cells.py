"""Single cells: quality, cell x region matrices, aggregates by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.core import small_side
from methloom.operators.intervals import first_match, fixed_bins
from methloom.operators.sites import cell_rows


def _level_sum() -> Column:
    return F.sum(F.col("value").cast("double") * F.col("coverage"))


def _level() -> Column:
    return _level_sum() / F.when(F.sum("coverage") > 0, F.sum("coverage"))


def cell_qc(sites: DataFrame, context: int | None = None, min_coverage: int = 1) -> DataFrame:
    """Per cell: sites, summed and mean coverage, level weighted by coverage."""
    return cell_rows(sites, context, min_coverage).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("coverage").cast("long").alias("total_coverage"),
        (F.sum("coverage").cast("double") / F.count(F.lit(1))).alias("mean_coverage"), _level().alias("mean_meth"),
    )


def placed_in_regions(sites: DataFrame, regions: DataFrame, order: str = "region_idx") -> DataFrame:
    """Sites with the first region, in the order of ``order``, that holds their position; repeated rows are kept."""
    return first_match(sites.drop("end"), regions.select("chrom", "rs", "re", order, *(["region_id"] if "region_id" in regions.columns else [])), order)


def placed_in_bins(sites: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    b = fixed_bins(sites, lengths, size)
    return b.withColumn("region_id", F.concat_ws(":", "chrom", F.concat_ws("-", F.col("bin_start").cast("string"), F.col("bin_end").cast("string"))))


def cell_matrix(placed: DataFrame, value: str = "mean-meth", agg: str = "mean", context: int | None = None, min_coverage: int = 1, by: str = "id") -> DataFrame:
    """Long form of the cell x region matrix: one row per pair that has sites.

    ``value`` is 'mean-meth' (level weighted by coverage) or 'coverage' (its mean,
    or with ``agg`` 'sum' its sum).
    """
    rows = cell_rows(placed, context, min_coverage).groupBy(by, "region_id").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("coverage").cast("long").alias("total_coverage"), _level().alias("mean_meth")
    )
    mean_cov = F.col("total_coverage").cast("double") / F.col("n_sites")
    v = F.col("mean_meth") if value == "mean-meth" else (F.col("total_coverage").cast("double") if agg == "sum" else mean_cov)
    return rows.withColumn("value", v)


def group_map(mapping: DataFrame, order: str, cell: str = "cell_id", label: str = "group_label") -> DataFrame:
    """One group per cell: the first mapping by ``order``; null cells and labels are dropped."""
    m = mapping.where(F.col(cell).isNotNull() & F.col(label).isNotNull())
    return m.groupBy(F.col(cell).alias("id")).agg(F.min_by(label, order).alias("grp"))


def group_aggregate(placed: DataFrame, groups: DataFrame, context: int | None = None, min_coverage: int = 1) -> DataFrame:
    """Per (group, region): distinct cells, sites, coverage, level. Unmapped cells are left out.

    The cells are reduced to one row per (group, region, cell) first, so the
    distinct count needs no second pass over the sites.
    """
    rows = cell_rows(placed, context, min_coverage).join(small_side(groups), "id")
    per = rows.groupBy("grp", "region_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").cast("long").alias("c"), _level_sum().alias("s"))
    return per.groupBy("grp", "region_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_sites"), F.sum("c").cast("long").alias("total_coverage"),
        (F.sum("c").cast("double") / F.sum("n")).alias("mean_coverage"), (F.sum("s") / F.when(F.sum("c") > 0, F.sum("c"))).alias("mean_meth"),
    )
