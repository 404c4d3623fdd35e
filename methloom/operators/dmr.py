"""Differential sites and regions between two groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methloom.core import BROADCAST_ROWS, durable, ship, small_side
from methloom.functions.stats import fisher_counts, group_lrt


#: Fits that a worker remembers.
MEMO = 200_000


def level_difference() -> Column:
    """Level of group 1 minus that of group 2; null if a group has no coverage."""
    level = lambda m, c: F.col(m).cast("double") / F.when(F.col(c) > 0, F.col(c).cast("double"))
    return level("m1", "c1") - level("m2", "c2")


def candidates(counts: DataFrame, min_diff: float = 0.25) -> DataFrame:
    """Loci whose pooled levels differ by at least ``min_diff``; only these are tested. No coverage in a group: no locus."""
    return counts.where((F.col("c1") > 0) & (F.col("c2") > 0)).withColumn("diff", level_difference()).where(F.abs("diff") >= min_diff)


def fisher_sites(counts: DataFrame, min_diff: float = 0.25, table: str = "totals") -> DataFrame:
    """Candidates with Fisher's two-sided p (``p_value``), computed over Arrow batches."""
    rows = candidates(counts, min_diff)
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def test(m1: pd.Series, c1: pd.Series, m2: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series(fisher_counts(m1, c1, m2, c2, table))

    return rows.withColumn("p_value", test("m1", "c1", "m2", "c2"))


def lrt_sites(counts: DataFrame, min_diff: float = 0.25, table: str = "totals") -> DataFrame:
    """Candidates with the p of the beta-binomial likelihood-ratio test over the samples.

    ``counts`` is what ``group_counts`` gives. Incomplete loci (relaxed mode) get
    Fisher's test on the pooled counts.
    """
    rows = candidates(counts, min_diff)
    ship(rows.sparkSession)
    schema = rows.drop("counts").schema.add("p_value", "double")
    keep = [f.name for f in schema if f.name != "p_value"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple, float] = {}
        for df in frames:
            if len(memo) > MEMO:
                memo.clear()
            p = np.ones(len(df))
            part = ~df["complete"].to_numpy(bool)
            if part.any():
                q = df[part]
                p[part] = fisher_counts(q["m1"], q["c1"], q["m2"], q["c2"], table)
            keys = {i: tuple(sorted((int(x["_g"]), int(x["m"]), int(x["coverage"])) for x in df["counts"].iat[i])) for i in np.flatnonzero(~part)}
            new = [k for k in dict.fromkeys(keys.values()) if k not in memo]
            memo.update(zip(new, group_lrt([list(k) for k in new])))
            for i, k in keys.items():
                p[i] = memo[k]
            yield df[keep].assign(p_value=p)

    return rows.mapInPandas(run, schema)


def adjust(loci: DataFrame, p_cut: float = 0.01) -> DataFrame:
    """Benjamini-Hochberg over the loci that survive p <= ``p_cut`` (``adj_p``).

    p m / rank, the least of it from the rank upward, 1 at most, m being the
    survivors. Computed without putting all loci in one task: equal p share one
    value, so ranks come from counts per p. One range-partitioned sort of these
    serves both the ranks, summed upward, and the running least, taken downward;
    of a partition only its count and its least value are gathered.
    """
    kept = durable(loci.where(F.col("p_value") <= p_cut))
    b = _blocks(kept.groupBy("p_value").agg(F.count(F.lit(1)).alias("_n")), ["p_value"])
    sums = sorted((r["_b"], r["_s"]) for r in b.groupBy("_b").agg(F.sum("_n").alias("_s")).collect())
    total, before = sum(n for _, n in sums), {}
    at = 0
    for k, n in sums:
        before[k], at = at, at + n
    spark = loci.sparkSession
    offs = spark.createDataFrame(list(before.items()) or [(0, 0)], "_b int, _off long")
    up = Window.partitionBy("_b").orderBy("p_value").rowsBetween(Window.unboundedPreceding, 0)
    # The last locus of equal p has the least p m / rank.
    raw = b.withColumn("_rank", F.sum("_n").over(up)).join(F.broadcast(offs), "_b").withColumn("_raw", F.lit(float(total)) * F.col("p_value") / (F.col("_rank") + F.col("_off")))
    least, above = 1.0, []
    for r in sorted(raw.groupBy("_b").agg(F.min("_raw").alias("_s")).collect(), key=lambda r: -r["_b"]):
        above.append((r["_b"], least))
        least = min(least, r["_s"])
    tops = spark.createDataFrame(above or [(0, 1.0)], "_b int, _top double")
    down = Window.partitionBy("_b").orderBy(F.col("p_value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    low = raw.withColumn("_low", F.min("_raw").over(down)).join(F.broadcast(tops), "_b")
    adj = low.select(F.col("p_value").alias("_p"), F.least("_low", "_top").alias("adj_p"))
    # As many rows as there are distinct p; the sums per partition tell an upper bound of them.
    few = total <= BROADCAST_ROWS
    return kept.join(F.broadcast(adj) if few else adj, F.col("p_value") == F.col("_p")).drop("_p")


def _blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned rows with their partition number, written once."""
    return durable(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))


def running_sum(df: DataFrame, order: str | list[str], value: str, name: str) -> DataFrame:
    """Cumulative sum in the order of columns that are unique together, partition by partition, and the grand total (``_total``)."""
    by = [order] if isinstance(order, str) else order
    b = _blocks(df, by)
    sums = b.groupBy("_b").agg(F.sum(value).alias("_s"))  # one row per partition
    w = Window.orderBy("_b")
    offs = sums.select("_b", (F.sum("_s").over(w) - F.col("_s")).alias("_off"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    run = Window.partitionBy("_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(name, F.sum(value).over(run)).join(F.broadcast(offs), "_b").withColumn(name, F.col(name) + F.col("_off")).drop("_off", "_b")


def sites_report(loci: DataFrame, fdr: float = 1.0, dictionary: DataFrame | None = None) -> DataFrame:
    """Significant loci: position, strand, context, p, adjusted p, counts of both groups, signed difference.

    With ``dictionary`` (tid, chrom) they are sorted by p, then by the place in the genome.
    """
    out = loci.where(F.col("adj_p") <= fdr)
    cols = ["chrom", "start", *(c for c in ("strand", "context") if c in loci.columns), "p_value", "adj_p", "m1", "c1", "m2", "c2", "diff"]
    if dictionary is None:
        return out.select(*cols)
    return out.join(small_side(dictionary.select("chrom", "tid")), "chrom", "left").orderBy("p_value", "tid", "start").select(*cols)


def call_regions(loci: DataFrame, min_sites: int = 4, gap: int = 100, max_span: int | None = None) -> DataFrame:
    """Chain significant loci of a chromosome (any strand and context) into regions.

    Successive loci at most ``gap`` bases apart belong together; regions of at
    least ``min_sites`` loci are kept: chrom, start, end (last locus), pooled
    levels of both groups, loci, and how many are hyper- and hypomethylated in
    the first group. With ``max_span`` a region also ends when the next locus
    would stretch it beyond that many bases; that walk is sequential within a run
    of close loci, so each run (not each chromosome) is a group of its own, of
    distinct positions only, and steps from piece to piece.
    """
    from methloom.operators.intervals import islands

    marked = islands(loci.select("chrom", "start", "m1", "c1", "m2", "c2", "diff"), "chrom", "start", gap)
    by = ["chrom", "island"]
    if max_span is not None:
        ship(marked.sparkSession)
        marked = durable(marked)
        schema = T.StructType([*marked.select(*by, "start").schema.fields, T.StructField("piece", T.LongType())])

        def walk(df: pd.DataFrame) -> pd.DataFrame:
            at = np.sort(df["start"].to_numpy())
            begin = [0] if len(at) else []
            while begin and (k := int(np.searchsorted(at, at[begin[-1]] + max_span, "right"))) < len(at):
                begin.append(k)  # the first locus out of reach begins the next piece
            return pd.DataFrame({"chrom": df["chrom"].iat[0], "island": df["island"].iat[0], "start": at, "piece": np.searchsorted(begin, np.arange(len(at)), "right")})

        pieces = marked.select(*by, "start").distinct().groupBy(*by).applyInPandas(walk, schema)
        marked = marked.join(pieces, [*by, "start"])
        by = [*by, "piece"]
    sums = marked.groupBy(*by).agg(
        F.min("start").alias("region_start"), F.max("start").alias("region_end"), F.count(F.lit(1)).alias("n_sites"),
        *(F.sum(c).cast("long").alias(c) for c in ("m1", "c1", "m2", "c2")), F.count(F.when(F.col("diff") > 0, 1)).alias("hyper"), F.count(F.when(F.col("diff") < 0, 1)).alias("hypo"),
    )
    return sums.where(F.col("n_sites") >= min_sites).select(
        "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end"), (F.col("m1").cast("double") / F.col("c1").cast("double")).alias("level_1"),
        (F.col("m2").cast("double") / F.col("c2").cast("double")).alias("level_2"), "n_sites", "hyper", "hypo",
    )
