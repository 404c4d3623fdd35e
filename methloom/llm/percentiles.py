"""Exact percentiles per group over very many values, from states that can be combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import durable


def value_states(df: DataFrame, by: dict[str, Column | str], value: str | Column) -> DataFrame:
    """The state of each group: how often each value occurs (columns of ``by``, ``value``, ``n``).

    States are exact and can be combined in any order (``combine_states``), so
    those of single samples, days or partitions give the same percentiles as all
    rows at once. Pre-aggregated before the shuffle; a state has at most one row
    per distinct value. Null values and NaN don't count. Null group values are
    groups of their own.
    """
    v = F.col(f"`{value}`") if isinstance(value, str) else value
    keys = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in by.items()]
    rows = df.select(*keys, v.cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def combine_states(states: DataFrame, by: list[str]) -> DataFrame:
    """Sum states (unioned beforehand, or with finer groups) to those of the groups ``by``."""
    return states.groupBy(*by, "value").agg(F.sum("n").cast("long").alias("n"))


def exact_percentiles(states: DataFrame, by: list[str], probs: list[float], partitions: int | None = None) -> DataFrame:
    """Percentiles of each group from its state, with error bound 0.

    The state rows of all groups are sorted together over the cluster by (group,
    value); each partition counts its rows per group, the counts of earlier
    partitions are the offsets, and the rows that hold the target positions are
    located. A percentile p of N values is interpolated linearly between the
    order statistics at floor and ceil of p (N - 1). A group is spread over as
    many partitions as its share of the state asks for; a step keyed by
    (partition, group) is never larger than a partition.

    Returns the group columns, ``prob``, ``n`` (values of the group), ``value``
    and ``max_error`` (0.0). Ties and repeated rows are counted. An empty table
    gives no rows.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must be between 0 and 1")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = states.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), F.col("value").alias("_v"), F.col("n").alias("_n")).where("_n > 0")
    order = [*keys, "_v"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    # Written once: the sorted rows are read for the counts and again for the positions.
    at = durable(ranged.sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = at.groupBy("_p", *keys).agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys)  # one row per partition that holds the group
    offsets = counts.select(
        F.col("_p").alias("_op"), *(F.col(k).alias("_o" + k) for k in keys),
        F.sum("_m").over(group).alias("_total"), (F.sum("_m").over(group.orderBy("_p")) - F.col("_m")).alias("_before"),
    )
    cond = F.col("_p") == F.col("_op")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_o" + k))
    joined = at.join(offsets, cond)
    running = Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("_hi", F.col("_before") + F.sum("_n").over(running)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    # Each row keeps the targets that fall into its positions [_lo, _hi), with their weights.
    targets = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(h)
        weight = h - low
        share = F.when((low >= F.col("_lo")) & (low < F.col("_hi")), 1 - weight).otherwise(0.0) + F.when(
            (weight > 0) & (low + 1 >= F.col("_lo")) & (low + 1 < F.col("_hi")), weight
        ).otherwise(0.0)
        targets.append(F.struct(F.lit(float(p)).alias("prob"), share.alias("w")))
    hits = placed.select(*keys, "_v", "_total", F.explode(F.filter(F.array(*targets), lambda t: t.w > 0)).alias("t"))
    # At most two rows per target: the neighbouring order statistics.
    done = hits.groupBy(*keys, F.col("t.prob").alias("prob")).agg(
        F.max("_total").alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.min_by("t.w", "_v").alias("_wa")
    )
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (1 - F.col("_wa")))
    return done.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), "prob", F.col("n").cast("long").alias("n"), value.alias("value"), F.lit(0.0).alias("max_error"))
