"""Levels per region, window and chromosome, with the rollup of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import small_side
from methloom.operators.intervals import range_join, sliding_windows
from methloom.schema import ALL_CONTEXTS, BOTH_STRANDS, has, meth_count

#: The additive columns of a rollup.
SUMS = ("n", "sw", "sv", "sv2", "sv1", "m", "c")
METHODS = ("weighted", "mean", "counts", "dev", "min", "max", "cov", "sum")


def _width(df: DataFrame) -> Column:
    """Bases of a site inside its region; 1 for point sites."""
    if has(df, "end", "rs", "re"):
        return (F.least("end", "re") - F.greatest("start", "rs")).cast("long")
    return F.lit(1).cast("long")


def rollup(rows: DataFrame, by: list[str], precision: str = "double", context: int = ALL_CONTEXTS) -> DataFrame:
    """Sums per (``by``, ``context``): every row feeds its own context and context 0, which stands for all.

    Rows are first reduced per (by, own context); only those few partial rows are
    spread to the two buckets. Columns: n, sw (bases), sv, sv2, m, c, lo, hi.
    """
    v, w = F.col("value").cast("double"), _width(rows)
    m = meth_count(rows, precision) if has(rows, "coverage") else F.lit(None).cast("long")
    c = F.col("coverage").cast("long") if has(rows, "coverage") else F.lit(None).cast("long")
    own = F.coalesce(F.col("context").cast("int"), F.lit(0)) if has(rows, "context") else F.lit(0)
    part = rows.groupBy(*by, own.alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(v * w).alias("sv"), F.sum(v * v).alias("sv2"), F.sum(v).alias("sv1"),
        F.sum(m * w).alias("m"), F.sum(c * w).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    buckets = F.when(F.col("_c") != 0, F.array(F.lit(0), F.col("_c"))).otherwise(F.array(F.lit(0)))
    out = part.withColumn("context", F.explode(buckets)).groupBy(*by, "context").agg(
        *(F.sum(x).alias(x) for x in SUMS), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return out if context >= ALL_CONTEXTS else out.where(F.col("context") == context)


def _level(method: str, counted: bool) -> Column:
    mean = F.col("sv") / F.when(F.col("sw") > 0, F.col("sw"))
    if method == "weighted":
        return F.col("m").cast("double") / F.when(F.col("c") > 0, F.col("c").cast("double")) if counted else mean
    if method == "mean":
        return mean
    if method == "dev":
        var = (F.col("sv2") - F.col("sv1") * F.col("sv1") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)
        return F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return {"min": F.col("lo"), "max": F.col("hi"), "sum": F.col("sv")}[method]


def _finish(sums: DataFrame, by: list[str], method: str, counted: bool, length: Column | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; one of {', '.join(METHODS)}")
    if method == "counts":
        return sums.select(*by, "context", F.col("m").cast("long").alias("meth_count"), F.col("c").cast("long").alias("coverage"))
    if method == "cov":
        return sums.select(*by, "context", (F.col("sw").cast("double") / length).alias("level"))
    return sums.select(*by, "context", _level(method, counted).alias("level"), F.col("n").alias("n_sites"))


def region_stats(
    sites: DataFrame, regions: DataFrame, method: str = "weighted", min_sites: int = 1, strand: int = BOTH_STRANDS,
    context: int = ALL_CONTEXTS, by_region_strand: bool = False, precision: str = "double", keys: tuple[str, ...] = ("region_id",),
) -> DataFrame:
    """Level of each region per context, context 0 for all (regions half-open).

    ``method``: weighted (summed methylated counts over summed coverage), mean
    (over covered bases), counts, dev (n - 1; 0 for one site), min, max, cov
    (covered share), sum. A region counts only if at least ``min_sites`` sites of
    any strand and context lie in it. ``strand`` 0 or 1 keeps that strand, 3 gives
    both apart (column ``strand``); ``by_region_strand`` takes the region's own.
    A context without sites gives no row; a sum of coverage of 0 gives null.
    """
    by = list(keys)
    q = regions.select(*by, "chrom", "rs", "re", *(["strand"] if by_region_strand else []))
    j = range_join(sites, q)
    if strand == 3 and not by_region_strand:
        by = [*by, "strand"]
    one_strand = by_region_strand or strand < BOTH_STRANDS
    fine = [*by, *(["strand"] if one_strand else []), *(["r_strand"] if by_region_strand else [])]
    if method == "cov":
        j = j.withColumn("_len", (F.col("re") - F.col("rs")).cast("double"))
        fine = [*fine, "_len"]
    # Strands are told apart in the sums, so that the sites of all strands can be counted without a second join.
    sums = rollup(j, fine, precision)
    if min_sites > 1:
        every = F.sum(F.when(F.col("context") == 0, F.col("n"))).over(Window.partitionBy(*keys))  # a few rows per region
        sums = sums.withColumn("_every", every).where(F.col("_every") >= min_sites).drop("_every")
    if one_strand:
        own = (F.col("r_strand") >= BOTH_STRANDS) | (F.col("r_strand") == F.col("strand")) if by_region_strand else F.col("strand") == strand
        sums = sums.where(own).groupBy(*by, "context", *(["_len"] if method == "cov" else [])).agg(
            *(F.sum(x).alias(x) for x in SUMS), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
    if context < ALL_CONTEXTS:
        sums = sums.where(F.col("context") == context)
    return _finish(sums, by, method, has(sites, "coverage"), F.col("_len"))


def chrom_stats(
    sites: DataFrame, lengths: DataFrame, method: str = "weighted", step: int = 100_000, move: int = 50_000,
    strand: int = BOTH_STRANDS, context: int = ALL_CONTEXTS, precision: str = "double",
) -> DataFrame:
    """Levels of sliding windows [k move, min(k move + step, length)) of each chromosome; strand 3 gives both apart.

    A site is copied into the ceil(step / move) windows that hold it, at most, and
    reduced before the shuffle.
    """
    if has(sites, "end"):
        sites = sites.drop("end")  # windows are taken by the site's position
    rows = sites if strand >= BOTH_STRANDS else sites.where(F.col("strand") == strand)
    by = ["chrom", "rs", "re"] + (["strand"] if strand == 3 else [])
    w = sliding_windows(rows, lengths, step, move)
    return _finish(rollup(w, by, precision, context), by, method, has(sites, "coverage"))


def body_stats(
    sites: DataFrame, regions: DataFrame, extend: int = 2000, method: str = "weighted", strand: int = BOTH_STRANDS,
    context: int = ALL_CONTEXTS, precision: str = "double",
) -> DataFrame:
    """Levels of [rs - extend, rs) (up), [rs, re) (body) and [re, re + extend) (down); sides don't swap on the - strand."""
    part = lambda name, s, e: F.struct(F.lit(name).alias("part"), s.alias("rs"), e.alias("re"))
    rs, re = F.col("rs"), F.col("re")
    parts = regions.select(
        "region_id", "chrom", F.explode(F.array(part("up", F.greatest(rs - extend, F.lit(0)), rs), part("body", rs, re), part("down", re, re + extend))).alias("p")
    ).select("region_id", "chrom", "p.*")
    return region_stats(sites, parts, method, 1, strand, context, precision=precision, keys=("region_id", "part"))


def chrom_levels(sites: DataFrame, chrom: str | None = None, precision: str = "double") -> DataFrame:
    """Mean level per chromosome, strand and context (0 for all)."""
    rows = sites if chrom is None else sites.where(F.col("chrom") == chrom)
    return _finish(rollup(rows.drop("end"), ["chrom", "strand"], precision), ["chrom", "strand"], "mean", has(sites, "coverage"))


#: Chromosomes that serve as unmethylated controls.
CONTROL_CHROMS = ("chrM", "ChrM", "chrC", "ChrC")


def control_level(sites: DataFrame, chrom: str | None = None) -> DataFrame:
    """Level of the control chromosomes (or one): the mean over its strands of the mean over all contexts.

    It is the level, not its complement, which would be the conversion rate.
    """
    names = [chrom] if chrom else list(CONTROL_CHROMS)
    per = chrom_levels(sites.where(F.col("chrom").isin(names))).where("context = 0 and strand < 2")
    return per.groupBy("chrom").agg(F.avg("level").alias("level"))


def context_level(sites: DataFrame, context: int) -> DataFrame:
    """Unweighted mean over chromosomes of their mean level in one context, per strand (0, 1) and pooled (2)."""
    rows = sites.where(F.col("context") == context)
    v = F.col("value").cast("double")
    per = rows.groupBy("chrom", "strand").agg(F.sum(v).alias("s"), F.count(v).alias("n")).where("strand < 2")
    spread = per.withColumn("strand", F.explode(F.array(F.col("strand").cast("int"), F.lit(2)))).groupBy("chrom", "strand").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return spread.groupBy("strand").agg(F.avg(F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias("level"))


def genome_lengths(sites: DataFrame) -> DataFrame:
    """Chromosome lengths implied by the sites: the last position + 1."""
    return small_side(sites.groupBy("chrom").agg((F.max("start") + 1).cast("long").alias("length")))
