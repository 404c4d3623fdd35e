"""Per-key results without imbalance: range partitions of (key, secondary order), stitched partial states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.core import partitions_for

#: How each aggregate is split: partial over a range, then over the partial states.
_MERGE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def balanced_aggregate(
    df: DataFrame, key: str, order: str, aggs: dict[str, tuple[str, Column | str | None]], partitions: int | None = None
) -> DataFrame:
    """Aggregate per ``key`` with every task doing a like share of the rows.

    Rows are range partitioned on (key, order) at quantiles that Spark samples
    from the data, so a heavy key is split over as many partitions as its share
    asks for. Each partition reduces every key it holds to one partial state; a
    key cut by a boundary has several, which are then stitched. At most
    (partitions + keys) states move in the second step.

    ``aggs`` maps an output name to (kind, column), kind one of count, sum, min,
    max, avg; count with column None counts rows. Null keys form one result row;
    null values are skipped, a key with no value gives null (count: 0). Ties and
    repeated rows in ``order`` are harmless. An empty table gives no rows.
    ``partitions`` defaults to what the size of the input asks for (``partitions_for``).
    """
    n = partitions or partitions_for(df)
    cols: dict[str, Column] = {}
    partial: list[Column] = []
    final: list[Column] = []
    for i, (name, (kind, col)) in enumerate(aggs.items()):
        c = f"_v{i}"
        if col is not None:
            cols[c] = F.col(f"`{col}`") if isinstance(col, str) else col
        value = F.col(c) if col is not None else F.lit(1)
        if kind == "avg":
            partial += [F.sum(value.cast("double")).alias(f"_s{i}"), F.count(value).alias(f"_n{i}")]
            final.append((F.sum(f"_s{i}") / F.when(F.sum(f"_n{i}") > 0, F.sum(f"_n{i}"))).alias(name))
        elif kind in _MERGE:
            partial.append(getattr(F, kind)(value).alias(f"_s{i}"))
            final.append(getattr(F, _MERGE[kind])(f"_s{i}").alias(name))
        else:
            raise ValueError(f"no aggregate {kind!r}; one of count, sum, min, max, avg")
    rows = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{order}`").alias("_o"), *(c.alias(k) for k, c in cols.items()))
    ranged = rows.repartitionByRange(n, "_k", "_o")
    states = ranged.groupBy(F.spark_partition_id().alias("_p"), "_k").agg(*partial)
    return states.groupBy(F.col("_k").alias(key)).agg(*final)


def heavy_keys(df: DataFrame, key: str, order: str, one_in: int, partitions: int | None = None) -> DataFrame:
    """The non-null values of ``key`` that hold at least one in ``one_in`` of all rows (rows with null keys count in the whole)."""
    counted = balanced_aggregate(df, key, order, {"rows": ("count", None)}, partitions)
    return counted.where(F.col(f"`{key}`").isNotNull() & (F.col("rows") * one_in >= F.lit(df.count())))
