"""Correlation, outliers, principal components, clustering and sorting of region matrices."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import BROADCAST_ROWS, durable
from methloom.operators.dmr import running_sum


def present_everywhere(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value (no null, no NaN) in every column."""
    return matrix.where(_all(~(F.col(c).isNull() | F.isnan(c)) for c in columns))


def outer_merge(samples: dict[str, DataFrame], keys: tuple[str, ...] = ("chrom", "start", "end"), value: str = "value", complete: bool = True) -> DataFrame:
    """The samples' values side by side under the samples' names, one row per key; with ``complete`` only keys that have a value in each.

    One union and one aggregation instead of a chain of outer joins. A key that a
    sample repeats takes the mean of its values; NaN counts as no value.
    """
    rows = [df.select(*keys, F.lit(i).alias("_s"), F.col(value).cast("double").alias("_v")) for i, df in enumerate(samples.values())]
    long = reduce(DataFrame.unionByName, rows).where("_v is not null and not isnan(_v)")
    wide = long.groupBy(*keys).agg(*(F.avg(F.when(F.col("_s") == i, F.col("_v"))).alias(name) for i, name in enumerate(samples)))
    return present_everywhere(wide, list(samples)) if complete else wide


def _all(conds) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def drop_flat_rows(matrix: DataFrame, columns: list[str], flat: float = 0.0) -> DataFrame:
    """Without the rows whose every value is ``flat`` (0 or 1)."""
    return matrix.where(~_all(F.col(c) == flat for c in columns))


def _value_counts(matrix: DataFrame, values: list[Column]) -> DataFrame:
    """The values of several expressions with how many rows have them: ``c`` (number of the expression), ``v``, ``_n``; nulls and NaN are left out."""
    each = F.array(*(F.struct(F.lit(i).alias("c"), v.cast("double").alias("v")) for i, v in enumerate(values)))
    return matrix.select(F.explode(each).alias("x")).select("x.*").where("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(matrix: DataFrame, values: list[Column], prob: float) -> list[float | None]:
    """A quantile of each expression over all rows, interpolated linearly; None without a value.

    All expressions share one range-partitioned sort of (expression, value), so no
    task gathers the values of one; the driver sees two values of each.
    """
    ranked = durable(running_sum(_value_counts(matrix, values), ["c", "v"], "_n", "_to"))
    ends = {r.c: (r.a, r.z) for r in ranked.groupBy("c").agg(F.min(F.col("_to") - F.col("_n")).alias("a"), F.max("_to").alias("z")).collect()}
    at = {c: prob * (z - a - 1) for c, (a, z) in ends.items()}
    want = [(c, ends[c][0] + k, k) for c, h in at.items() for k in {math.floor(h), math.ceil(h)}]
    if not want:
        return [None] * len(values)
    w = F.broadcast(matrix.sparkSession.createDataFrame(want, "_c int, _p long, k long"))
    hit = ranked.join(w, (F.col("c") == F.col("_c")) & (F.col("_p") >= F.col("_to") - F.col("_n")) & (F.col("_p") < F.col("_to")))
    got = {(r.c, r.k): r.v for r in hit.select("c", "k", "v").collect()}
    low = lambda c: got[c, math.floor(at[c])]
    return [low(c) + (at[c] - math.floor(at[c])) * (got[c, math.ceil(at[c])] - low(c)) if c in at else None for c in range(len(values))]


def outliers(matrix: DataFrame, columns: list[str], max_deviation: float = 200.0) -> DataFrame:
    """Rows outlying in every column: 0.6745 |x - median| / median(|x|) above the bound.

    The scale is the median of the absolute values, as defined, not that of the
    absolute deviations. A column of scale 0 has no outliers.
    """
    found = exact_quantiles(matrix, [*(F.col(c) for c in columns), *(F.abs(c) for c in columns)], 0.5)
    conds = []
    for c, med, scale in zip(columns, found, found[len(columns) :]):
        conds.append(F.lit(False) if not scale else F.coalesce(F.lit(0.6745) * F.abs(F.col(c) - med) / scale > max_deviation, F.lit(False)))
    return matrix.where(_all(conds))


def pearson(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, in one aggregation (``sample_a``, ``sample_b``, ``r``)."""
    pairs = list(combinations(columns, 2))
    row = matrix.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("sample_a"), F.lit(b).alias("sample_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def average_ranks(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """The average rank (from 1) of each row in each column, under the columns' names; null for nulls and NaN. Other columns are left out.

    All columns are ranked in one range-partitioned sort of their distinct values.
    These are looked up by broadcast where a count shows that they are few, else
    the values are joined as (row, column, value) and put side by side again.
    """
    m = durable(matrix.select(*(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns))).withColumn("_row", F.monotonically_increasing_id()))
    values = [F.col(f"v{i}") for i in range(len(columns))]
    summed = durable(running_sum(_value_counts(m, values), ["c", "v"], "_n", "_to"))
    starts = summed.groupBy("c").agg(F.min(F.col("_to") - F.col("_n")).alias("_at"))  # one row per column
    ranks = summed.join(F.broadcast(starts), "c").select("c", "v", (F.col("_to") - F.col("_at") - (F.col("_n") - 1) / 2.0).alias("r"))
    if summed.count() <= BROADCAST_ROWS:
        out = m
        for i in range(len(columns)):
            one = ranks.where(F.col("c") == i).select(F.col("v").alias("_v"), F.col("r").alias(f"_r{i}"))
            out = out.join(F.broadcast(one), F.col(f"v{i}") == F.col("_v"), "left").drop("_v")
    else:
        each = F.array(*(F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in enumerate(values)))
        wide = m.select("_row", F.explode(each).alias("x")).select("_row", "x.*").join(ranks, ["c", "v"], "left")
        out = wide.groupBy("_row").agg(*(F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"_r{i}") for i in range(len(columns))))
    return out.select(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)))


def spearman(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns."""
    return pearson(average_ranks(matrix, columns), columns)


def principal_components(matrix: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Projection of each row's standardised values on the first k components (``pc``: array of double)."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(matrix)
    s = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v).transform(v)
    return PCA(k=k, inputCol="_s", outputCol="_p").fit(s).transform(s).withColumn("pc", vector_to_array("_p")).drop("_v", "_s", "_p")


def kmeans_rows(matrix: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """Cluster rows; clusters are numbered from 1 by descending mean of their values."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(matrix)
    c = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(v).transform(v)
    mean = sum((F.col(x) for x in columns), F.lit(0.0)) / len(columns)
    order = c.groupBy("_c").agg(F.avg(mean).alias("_m")).select("_c", F.row_number().over(Window.orderBy(F.col("_m").desc())).alias("cluster"))  # k rows
    return c.join(F.broadcast(order), "_c").drop("_c", "_v")


def ward_rows(matrix: DataFrame, key: str, columns: list[str], k: int, max_rows: int = 2000) -> DataFrame:
    """Ward clusters of at most ``max_rows`` rows, numbered by descending mean.

    Agglomeration needs all pairs of rows on the driver, so a larger matrix is
    refused: reduce it with ``kmeans_rows`` first.
    """
    import numpy as np

    rows = matrix.select(key, *columns).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; cluster the centres of kmeans_rows instead")
    x = np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), len(columns))
    groups = {i: [i] for i in range(len(rows))}
    centre = dict(enumerate(x))
    while len(groups) > k:
        ids = list(groups)
        c, n = np.array([centre[i] for i in ids]), np.array([len(groups[i]) for i in ids])
        cost = ((c[:, None] - c[None]) ** 2).sum(2) * (n[:, None] * n[None]) / (n[:, None] + n[None])
        np.fill_diagonal(cost, np.inf)
        a, b = np.unravel_index(int(cost.argmin()), cost.shape)
        i, j = ids[min(a, b)], ids[max(a, b)]
        centre[i] = (centre[i] * len(groups[i]) + centre[j] * len(groups[j])) / (len(groups[i]) + len(groups[j]))
        groups[i] += groups.pop(j)
    ordered = sorted(groups.values(), key=lambda g: -float(np.mean(x[g])))
    label = [(rows[i][key], c + 1) for c, g in enumerate(ordered) for i in g]
    kind = matrix.schema[key].dataType.simpleString()
    return matrix.join(F.broadcast(matrix.sparkSession.createDataFrame(label, f"_k {kind}, cluster int")), F.col(key) == F.col("_k")).drop("_k")


def row_statistic(columns: list[str], using: str = "mean") -> Column:
    cols = [F.col(c) for c in columns]
    if using == "median":
        a = F.array_sort(F.array(*cols))
        n = len(cols)
        return F.element_at(a, n // 2 + 1) if n % 2 else (F.element_at(a, n // 2) + F.element_at(a, n // 2 + 1)) / 2
    total = sum(cols[1:], cols[0])
    return {"mean": total / len(cols), "sum": total, "max": F.greatest(*cols) if len(cols) > 1 else cols[0], "min": F.least(*cols) if len(cols) > 1 else cols[0]}[using]


def sort_rows(matrix: DataFrame, columns: list[str], using: str = "mean", ascending: bool = False, within: str | None = None, key: str | None = None) -> DataFrame:
    """Rows sorted by a statistic over their columns, within groups if given; ties by ``key``."""
    stat = row_statistic(columns, using)
    order = ([F.col(within)] if within else []) + [stat.asc() if ascending else stat.desc()] + ([F.col(key)] if key else [])
    return matrix.withColumn("row_stat", stat).orderBy(*order)


def most_variable(matrix: DataFrame, columns: list[str], n: int, key: str) -> DataFrame:
    """The ``n`` rows of greatest variance (n - 1); a top-k, ties by ``key``."""
    mean = row_statistic(columns, "mean")
    var = sum((F.pow(F.col(c) - mean, 2) for c in columns), F.lit(0.0)) / max(1, len(columns) - 1)
    return matrix.withColumn("row_var", var).orderBy(F.col("row_var").desc(), key).limit(n)
