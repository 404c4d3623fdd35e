"""Profiles over regions and their flanks: bins, matrix and average."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.operators.intervals import range_join
from methloom.operators.regionstats import rollup
from methloom.schema import BOTH_STRANDS

MODES = ("across", "tss", "tts", "center")


def bin_count(move: float) -> int:
    """Bins of one stretch: ceil(1 / move) - 1."""
    return max(0, math.ceil(1 / move) - 1)


def profile_bins(regions: DataFrame, mode: str = "across", extend: int = 2000, step: float = 0.02, move: float | None = None, body: float = 1.0) -> DataFrame:
    """The bins of each region: region_id, strand, ``bin`` (in reading direction), chrom, rs, re.

    'across' cuts the upstream flank, the body and the downstream flank into bins
    of twice ``(int)(length * move)`` bases at steps of that many; body moves are
    divided by ``body``. 'tss', 'tts' and 'center' cut one window of ``extend``
    bases to either side of the region's first, last or middle base, with halved
    steps. Bins of regions on the - strand are counted from the other end.
    Regions shorter than their number of bins, and stretches too short for a step
    of one base, give no bins.
    """
    move = move if move is not None else step / 2
    rs, re, minus = F.col("rs"), F.col("re"), F.col("strand") == 1
    stretch = lambda s, e, n, mv, first: F.struct(
        s.cast("long").alias("s"), e.cast("long").alias("e"), F.lit(n).alias("n"), F.floor((e - s).cast("double") * mv).cast("long").alias("mv"), F.lit(first).alias("first")
    )
    if mode == "across":
        flank, inner = bin_count(move), bin_count(move / body)
        parts = [
            stretch(F.greatest(rs - extend, F.lit(0)), rs, flank, move, 0),
            stretch(rs, re, inner, move / body, flank),
            stretch(re, re + extend, flank, move, flank + inner),
        ]
        total = 2 * flank + inner
        rows = regions.where(re - rs >= inner)
    elif mode in MODES:
        half = move / 2
        total = bin_count(half)
        start_side, end_side = F.when(minus, re).otherwise(rs), F.when(minus, rs).otherwise(re)
        at = {"tss": start_side, "tts": end_side, "center": F.floor((rs + re) / 2)}[mode]
        parts = [stretch(F.greatest(at - extend, F.lit(0)), at + extend, total, half, 0)]
        rows = regions
    else:
        raise ValueError(f"no mode {mode!r}; one of {', '.join(MODES)}")
    x = rows.select("region_id", "chrom", "strand", F.explode(F.array(*parts)).alias("p")).where("p.n > 0 and p.mv > 0")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)))
    place = F.col("p.first") + F.col("i")
    begin = F.col("p.s") + F.col("i") * F.col("p.mv")
    return x.select(
        "region_id", "strand", F.when(minus, F.lit(total - 1) - place).otherwise(place).alias("bin"), "chrom", begin.alias("rs"), (begin + 2 * F.col("p.mv")).alias("re")
    )


def profile(sites: DataFrame, bins: DataFrame, strand: int = BOTH_STRANDS, precision: str = "float") -> DataFrame:
    """Weighted level per (region_id, bin, context), context 0 for all; bins without coverage give no row.

    ``strand`` 0 or 1 keeps regions of that strand and those without one.
    """
    q = bins if strand >= BOTH_STRANDS else bins.where(F.col("strand").isNull() | F.col("strand").isin(strand, 2))
    j = range_join(sites, q.select("region_id", "bin", "chrom", "rs", "re"))
    sums = rollup(j, ["region_id", "bin"], precision)
    return sums.where(F.col("c") > 0).select("region_id", "bin", "context", (F.col("m").cast("double") / F.col("c").cast("double")).alias("level"))


def profile_average(levels: DataFrame) -> DataFrame:
    """Unweighted mean over regions of each bin's level, per context."""
    return levels.groupBy("context", "bin").agg(F.avg("level").alias("level"), F.count("level").alias("n_regions"))


def matrix_blocks(levels: DataFrame, block: int = 5) -> DataFrame:
    """Mean of the levels present in blocks of ``block`` bins (the last may be short), per region and context."""
    return levels.groupBy("region_id", "context", F.floor(F.col("bin") / block).cast("int").alias("block")).agg(F.avg("level").alias("level"))


def replicate_average(profiles: list[DataFrame]) -> DataFrame:
    """Mean over replicates of their average profiles."""
    from methloom.operators.sites import union_all

    return union_all(profiles).groupBy("context", "bin").agg(F.avg("level").alias("level"), F.count("level").alias("n_replicates"))


def wide_matrix(levels: DataFrame, column: str, n: int, value: Column | str = "level") -> DataFrame:
    """One row per (region_id, context) with ``n`` value columns; for sinks."""
    v = F.col(value) if isinstance(value, str) else value
    return levels.groupBy("region_id", "context").agg(*(F.max(F.when(F.col(column) == i, v)).alias(f"b{i}") for i in range(n)))
