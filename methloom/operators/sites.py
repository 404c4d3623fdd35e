"""Filters, merges, overlaps, histograms and summaries of site tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.operators.intervals import overlaps, range_join
from methloom.schema import ALL_CONTEXTS, BOTH_STRANDS, has, meth_count


def view(
    sites: DataFrame, chrom: str | None = None, regions: DataFrame | None = None, strand: int = BOTH_STRANDS, context: int = ALL_CONTEXTS,
    min_cover: int = 0, max_cover: int = 10_000, use_region_strand: bool = False,
) -> DataFrame:
    """Rows that pass the filters; regions are taken with their end base (inclusive).

    Coverage counts only where the table has it; contexts 0 and above 3 mean all,
    strand 2 means both. The predicates on chrom, start and coverage reach the
    Parquet scan. A row in several regions is given once, repeated rows as often
    as they come. With ``use_region_strand`` a region's strand (0 or 1) must be the site's.
    """
    out = sites
    if chrom is not None:
        out = out.where(F.col("chrom") == chrom)
    if has(out, "coverage"):
        out = out.where(F.col("coverage").between(min_cover, max_cover))
    if has(out, "strand") and strand != BOTH_STRANDS:
        out = out.where(F.col("strand") == strand)
    if has(out, "context") and context in (1, 2, 3):
        out = out.where(F.col("context") == context)
    if regions is None:
        return out
    columns = ["chrom", "rs", "re", *(["strand"] if use_region_strand else [])]
    return range_join(out, regions.select(*columns), inclusive=True, how="left_semi", same_strand=use_region_strand)


def cell_rows(sites: DataFrame, context: int | None = None, min_coverage: int = 1) -> DataFrame:
    """Rows of named cells with enough coverage; here context 0 means code 0 only, None all."""
    out = sites.where(F.col("id").isNotNull() & (F.col("coverage") >= min_coverage))
    return out if context is None else out.where(F.col("context") == context)


def summary(sites: DataFrame) -> DataFrame:
    """One row: bases covered, least and greatest value, sum and sum of squares, each value weighted by its width."""
    w = (F.col("end") - F.col("start")) if has(sites, "end") else F.lit(1)
    v = F.col("value").cast("double")
    return sites.agg(
        F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n_bases"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.sum(v * w).alias("sum_value"), F.sum(v * v * w).alias("sum_squares"),
    )


def header(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per chromosome: length, rows, first and last position, and which columns the table has."""
    per = sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_sites"), F.min("start").alias("first_pos"), F.max("start").alias("last_pos"))
    columns = ",".join(c for c in ("end", "coverage", "strand", "context", "id") if has(sites, c))
    return lengths.join(per, "chrom", "left").select("chrom", "length", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "first_pos", "last_pos", F.lit(columns).alias("columns"))


def zoom(sites: DataFrame, size: int) -> DataFrame:
    """Summaries over fixed windows of ``size`` bases: n, min, max, sum and sum of squares per chrom and window."""
    v = F.col("value").cast("double")
    return sites.groupBy("chrom", (F.floor(F.col("start") / size) * size).cast("long").alias("win_start")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value"), F.sum(v * v).alias("sum_squares")
    )


def zoom_levels(sites: DataFrame, levels: int) -> dict[int, DataFrame]:
    """Zoom tables: the first window is 16 mean widths, at least 10 bases, each further one 4 times the last.

    Each level is computed from the one below, not from the sites.
    """
    mean = sites.agg(F.avg(F.col("end") - F.col("start")) if has(sites, "end") else F.lit(1.0)).first()[0] or 1.0
    size = max(10, int(16 * mean))
    out: dict[int, DataFrame] = {}
    for _ in range(levels):
        out[size] = zoom(sites, size) if not out else rezoom(out[size // 4], size)
        size *= 4
    return out


def rezoom(zoomed: DataFrame, size: int) -> DataFrame:
    """Re-aggregate a zoom table to windows that are a multiple of its own."""
    return zoomed.groupBy("chrom", (F.floor(F.col("win_start") / size) * size).cast("long").alias("win_start")).agg(
        F.sum("n").alias("n"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.sum("sum_value").alias("sum_value"), F.sum("sum_squares").alias("sum_squares"),
    )


def zoom_stats(zoomed: DataFrame, size: int, regions: DataFrame) -> DataFrame:
    """Mean, deviation, min, max, covered share and sum per region from a zoom table; windows cut by a bound count in part."""
    w = zoomed.select("chrom", F.col("win_start").alias("start"), (F.col("win_start") + size).alias("end"), "n", "min_value", "max_value", "sum_value", "sum_squares")
    j = range_join(w, regions.select("chrom", "rs", "re", "region_id"))
    share = (F.least("end", "re") - F.greatest("start", "rs")).cast("double") / size
    n, s, q = F.sum(F.col("n") * share), F.sum(F.col("sum_value") * share), F.sum(F.col("sum_squares") * share)
    var = (q - s * s / n) / F.when(n > 1, n - 1)
    return j.groupBy("region_id").agg(
        (s / n).alias("mean_value"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("dev_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), (n / F.max(F.col("re") - F.col("rs"))).alias("covered"), s.alias("sum_value"),
    )


def coverage_histogram(sites: DataFrame, total: int | None = None, top: int = 16) -> DataFrame:
    """Rows with coverage of at least 1, 2, …, ``top`` (``min_coverage``, ``n_sites``, ``percent``).

    Coverage 0 counts in the top bin, as do all above it. ``total`` replaces the
    number of rows as the whole. One row per bin, also where it is empty.
    """
    c = F.col("coverage")
    per = sites.groupBy(F.when((c < 1) | (c > top), top).otherwise(c).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = sites.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("b"))
    w = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)  # `top` rows
    counted = every.join(F.broadcast(per), "b", "left").select("b", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_sites"))
    whole = F.lit(total) if total else F.max("n_sites").over(Window.partitionBy())
    return counted.select(F.col("b").alias("min_coverage"), "n_sites", (100 * F.col("n_sites").cast("double") / F.when(whole > 0, whole.cast("double"))).alias("percent"))


def level_histogram(sites: DataFrame, bins: int = 10) -> DataFrame:
    """Rows per level bin: ``bin`` -1 for level 0, else (int)(v bins - 0.0001 / bins), 0 at least."""
    v = F.col("value").cast("double")
    b = F.when(v == 0, -1).otherwise(F.greatest(F.floor(v * bins - 0.0001 / bins), F.lit(0)))
    return sites.where(F.col("value").isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_sites"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of all inputs; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def numbered(tables: list[DataFrame], precision: str = "double") -> DataFrame:
    """The inputs as one table with ``sample`` (0, 1, …) and the methylated count ``m``."""
    return union_all([t.withColumn("m", meth_count(t, precision)).withColumn("sample", F.lit(i)) for i, t in enumerate(tables)])


def merge(samples: DataFrame, method: str = "weighted") -> DataFrame:
    """Union of samples (``numbered``) by (chrom, start): summed coverage, and a joint level.

    'weighted' divides the summed methylated counts by the summed coverage;
    'mean' averages the levels. Strand, context and end are those of the first
    sample that has the position. A position in one sample passes unchanged.
    """
    firsts = [c for c in ("end", "strand", "context") if has(samples, c)]
    agg = samples.groupBy("chrom", "start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("coverage").cast("long").alias("coverage"), F.sum("m").cast("long").alias("m"), F.avg(F.col("value").cast("double")).alias("_mean"),
        *(F.min_by(c, F.struct("sample", c)).alias(c) for c in firsts),
    )
    joint = F.col("_mean") if method == "mean" else F.col("m").cast("double") / F.when(F.col("coverage") > 0, F.col("coverage").cast("double"))
    level = F.when(F.col("n") == 1, F.col("_mean")).otherwise(joint)
    return agg.select("chrom", "start", *firsts, level.alias("value"), "coverage", F.col("n").alias("n_samples"))


def overlap_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of both tables: context and strand of the first, values and coverages of both."""
    left = a.select("chrom", "start", *(c for c in ("context", "strand") if has(a, c)), F.col("value").alias("value_1"), F.col("coverage").alias("coverage_1"))
    return left.join(b.select("chrom", "start", F.col("value").alias("value_2"), F.col("coverage").alias("coverage_2")), ["chrom", "start"])


def overlap_in_regions(tables: list[DataFrame], regions: DataFrame, strand: int = BOTH_STRANDS, use_region_strand: bool = True) -> DataFrame:
    """``overlap_two`` of two tables or ``overlap_many`` of more, within regions (end base included).

    Here a region's strand counts: 0 or 1 takes sites of that strand. ``strand``
    keeps one strand of the sites. Each table is cut to the regions before the
    positions are brought together, by a semi-join each.
    """
    cut = [view(t, regions=regions, strand=strand, use_region_strand=use_region_strand, max_cover=(1 << 31) - 1) for t in tables]
    return overlap_two(*cut) if len(cut) == 2 else overlap_many(numbered(cut), len(cut))


def overlap_many(samples: DataFrame, n: int) -> DataFrame:
    """Positions that all ``n`` samples have: ``counts``, an array of (m, coverage) in sample order.

    One aggregation instead of n - 1 joins. Assumes one row per sample and position.
    """
    agg = samples.groupBy("chrom", "start").agg(
        F.countDistinct("sample").alias("k"), *(F.min_by(c, F.struct("sample", c)).alias(c) for c in ("context", "strand") if has(samples, c)),
        F.sort_array(F.collect_list(F.struct("sample", "m", "coverage"))).alias("c"),
    )
    return agg.where(F.col("k") == n).withColumn("counts", F.transform("c", lambda x: F.struct(x.m.alias("m"), x.coverage.alias("coverage")))).drop("k", "c")


def group_counts(samples: DataFrame, group: Column, n1: int, n2: int, relaxed: bool = False) -> DataFrame:
    """Per position the pooled counts of two groups (``group`` 1 or 2): m1, c1, m2, c2, and whether all samples have it.

    Complete positions only, or with ``relaxed`` those with at least one sample of each group.
    """
    g = samples.withColumn("_g", group)
    one, two = F.col("_g") == 1, F.col("_g") == 2
    agg = g.groupBy("chrom", "start").agg(
        *(F.min_by(c, F.struct("sample", c)).alias(c) for c in ("context", "strand") if has(samples, c)),
        F.sum(F.when(one, F.col("m")).otherwise(0)).cast("long").alias("m1"), F.sum(F.when(one, F.col("coverage")).otherwise(0)).cast("long").alias("c1"),
        F.sum(F.when(two, F.col("m")).otherwise(0)).cast("long").alias("m2"), F.sum(F.when(two, F.col("coverage")).otherwise(0)).cast("long").alias("c2"),
        F.count(F.when(one, 1)).alias("n1"), F.count(F.when(two, 1)).alias("n2"),
        F.sort_array(F.collect_list(F.struct("sample", "_g", "m", "coverage"))).alias("counts"),
    )
    complete = (F.col("n1") == n1) & (F.col("n2") == n2)
    keep = (F.col("n1") > 0) & (F.col("n2") > 0) if relaxed else complete
    return agg.where(keep).withColumn("complete", complete)


def in_interval(sites: DataFrame, start: int, end: int, inclusive: bool = False) -> DataFrame:
    """Rows that overlap [start, end), or [start, end] if inclusive."""
    e = F.col("end") if has(sites, "end") else F.col("start") + 1
    return sites.where(overlaps(F.col("start"), e, F.lit(start), F.lit(end), inclusive))
