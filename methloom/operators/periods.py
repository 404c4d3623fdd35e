"""Continuous periods and gaps of overlapping intervals, by independent ranks of starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import dense_index

#: Rows of one stitching block; bounds what a single task sorts.
BLOCK_ROWS = 1 << 17


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge the half-open intervals of each entity and list the gaps between the periods.

    Starts and ends are sorted independently. Both sorts order entities alike and
    an entity has as many starts as ends, so the place of a row in the whole sort
    stands for its rank in the entity. Where the next-ranked start exceeds the
    current-ranked end, everything before has ended: a gap. Successive boundaries
    pair up to the periods. Ranks are cut into blocks of ``block_rows``, so an
    entity with any share of the rows is spread evenly.

    Returns ``kind`` ('merged' or 'gap'), the entity columns, ``start``, ``end``.

    Rows with a null or negative bound, or an end not above the start, don't
    count. Null entity values form an entity of their own. Touching intervals
    (end = start) and repeated rows fall into one period. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    keys = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)), s.alias("_s"), e.alias("_t"))
    rows = rows.where((F.col("_s") >= 0) & (F.col("_t") > F.col("_s")))
    starts = dense_index(rows.select(*keys, F.col("_s").alias("_v")), [*keys, "_v"])
    ends = dense_index(rows.select(*keys, F.col("_t").alias("_v")), [*keys, "_v"])
    # An end meets the start ranked just after it; the end sorts first within the shared number.
    both = starts.withColumn("_k", F.lit(1)).unionByName(ends.withColumn("_g", F.col("_g") + 1).withColumn("_k", F.lit(0)))
    both = both.withColumn("_b", F.floor(F.col("_g") / block_rows))
    w = Window.partitionBy("_b").orderBy("_g", "_k")
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    prev = F.lag("_v").over(w)
    is_start = F.col("_k") == 1
    # Any start but the first of all has its end row directly before it in the block.
    marked = both.select(
        *keys, "_b", "_g", "_k", "_v",
        F.when(is_start & (F.col("_g") > 0) & same, prev).alias("_prev"),
    ).withColumn("_open", (is_start & (F.col("_prev").isNull() | (F.col("_v") > F.col("_prev")))).cast("int"))
    # The end row of number g closes a period if the start of number g opens one (or there is none).
    nxt = F.lead("_open").over(w)
    marked = marked.withColumn("_close", (~is_start & F.coalesce(nxt == 1, F.lit(True))).cast("int"))
    marked = marked.where("_open = 1 or _close = 1")
    gaps = marked.where("_open = 1 and _prev is not null").select(F.lit("gap").alias("kind"), *keys, F.col("_prev").alias("_s"), F.col("_v").alias("_t"))
    # The j-th opening pairs with the j-th closing; their numbers come from per-block counts.
    counts = marked.groupBy("_b").agg(F.sum("_open").alias("_no"), F.sum("_close").alias("_nc"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offs = counts.select(
        "_b", F.coalesce(F.sum("_no").over(before), F.lit(0)).alias("_oo"), F.coalesce(F.sum("_nc").over(before), F.lit(0)).alias("_oc")
    )
    run = Window.partitionBy("_b").orderBy("_g", "_k").rowsBetween(Window.unboundedPreceding, 0)
    paired = (
        marked.withColumn("_ro", F.sum("_open").over(run)).withColumn("_rc", F.sum("_close").over(run))
        .join(offs, "_b")
        .select(*keys, "_v", "_open", F.when(F.col("_open") == 1, F.col("_oo") + F.col("_ro")).otherwise(F.col("_oc") + F.col("_rc")).alias("_j"))
    )
    # Exactly one opening and one closing per number, both of the same entity.
    merged = paired.groupBy("_j").agg(
        *(F.max(F.when(F.col("_open") == 1, F.col(k))).alias(k) for k in keys),
        F.max(F.when(F.col("_open") == 1, F.col("_v"))).alias("_s"),
        F.max(F.when(F.col("_open") == 0, F.col("_v"))).alias("_t"),
    ).select(F.lit("merged").alias("kind"), *keys, "_s", "_t")
    out = merged.unionByName(gaps)
    return out.select("kind", *(F.col(k).alias(c) for c, k in zip(entity, keys)), F.col("_s").alias(start), F.col("_t").alias(end))


def canonical_names(df: DataFrame, column: str, alias: DataFrame, alias_col: str, name_col: str) -> DataFrame:
    """Replace ``column`` by its name after the alias table; names without an alias become null.

    The alias column is reduced to one row per alias (the smallest name), so no
    row is multiplied. A small alias table is broadcast after a count.
    """
    from methloom.core import small_side

    a = alias.where(F.col(alias_col).isNotNull()).groupBy(F.col(alias_col).alias("_alias")).agg(F.min(name_col).alias("_name"))
    joined = df.join(small_side(a), df[f"`{column}`"] == F.col("_alias"), "left")
    return joined.withColumn(column, F.col("_name")).drop("_alias", "_name")
