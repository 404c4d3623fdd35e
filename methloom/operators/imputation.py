"""Filling missing values from rows of the same group by chained equations."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.core import durable

#: Words that stand for "no identifier", compared trimmed and in lower case.
NO_IDENTIFIER = ("", "-", "na", "n/a", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "not available", "?", ".", "--", "#n/a", "<na>", "(none)", "(null)")

OBSERVED, FILLED, MISSING = "observed", "filled", "missing"


def count_or_null(column: str | Column) -> Column:
    """The value if it can be a count (0 or more), else null."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.when(c >= 0, c)


def identifier_or_null(column: str | Column) -> Column:
    """The text if it names something, else null (blank, or a word for "none")."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    # Only a text that begins or ends with something else than a visible ASCII character needs the pattern.
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    bare = F.lower(F.when(plain, c).otherwise(F.regexp_replace(c, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")))
    return F.when(~bare.isin(*NO_IDENTIFIER), c)


def _noise(key: str, salt: str) -> Column:
    """A standard normal draw fixed by the row's key (Box-Muller over two hashes)."""
    unit = lambda s: (F.xxhash64(F.col(key), F.lit(salt + s)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * np.pi * unit("b"))


def _solve(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and residual deviation from the moments of (1, x…, y)."""
    a, b, n = m[:-1, :-1], m[:-1, -1], m[0, 0]
    if n < 1:
        return np.r_[np.zeros(len(b) - 1), 1.0], 0.0
    beta = np.linalg.lstsq(a + 1e-9 * np.diag(np.r_[0, np.ones(len(b) - 1)]) * n, b, rcond=None)[0]
    rss = max(0.0, m[-1, -1] - 2 * beta @ b + beta @ a @ beta)
    return beta, float(np.sqrt(rss / n))


def _moments(row, prefix: str, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"{prefix}{i}{j}"] or 0.0
    return m


def impute_counts(
    df: DataFrame, key: str, group: str, part: str, whole: str, iterations: int = 3, residual: bool = True
) -> DataFrame:
    """Fill missing counts ``part`` and ``whole`` (part <= whole) from rows of the same group.

    Chained equations on log(1 + count): each field is regressed on the other
    field and on the mean of its own field over the *other* rows of the group.
    The moments over complete rows come from per-group sums, so the full table
    is shuffled once; the few incomplete rows are then fitted, predicted and
    refitted ``iterations`` times. Only sums of a 4 x 4 moment matrix reach the
    driver. With ``residual`` a draw fixed by the row's key keeps the spread of
    the residuals; results are clipped to the range seen in the group and to
    part <= whole, and rounded.

    Returns one row per *incomplete* row: ``key``, ``group``, and for each field
    the value after filling and ``<field>_status`` ('observed', 'filled',
    'missing'). A value that no other row of its group can supply stays null and
    'missing'; a null group supplies nothing. Missing means null or negative.
    Repeated rows count as rows of the group. An empty table gives no rows.
    """
    base = df.select(
        F.col(f"`{key}`").alias("_k"), F.col(f"`{group}`").alias("_g"),
        count_or_null(part).cast("long").alias("_p"), count_or_null(whole).cast("long").alias("_w"),
    )
    lp, lw = F.log1p("_p").cast("float"), F.log1p("_w").cast("float")
    both = F.col("_p").isNotNull() & F.col("_w").isNotNull()
    gap = (~both).cast("int")
    sums = durable(
        base.where(F.col("_g").isNotNull()).groupBy("_g").agg(
            F.count(F.when(both, 1)).cast("int").alias("n"), F.count("_p").cast("int").alias("np"), F.count("_w").cast("int").alias("nw"),
            F.sum(F.when(both, lp)).cast("float").alias("cp"), F.sum(F.when(both, lw)).cast("float").alias("cw"),
            F.sum(F.when(both, lp * lp)).cast("float").alias("pp"), F.sum(F.when(both, lw * lw)).cast("float").alias("ww"), F.sum(F.when(both, lp * lw)).cast("float").alias("pw"),
            F.sum(lp).cast("float").alias("sp"), F.sum(lw).cast("float").alias("sw"),
            F.min("_p").alias("lop"), F.max("_p").alias("hip"), F.min("_w").alias("low"), F.max("_w").alias("hiw"),
            F.max(gap).cast("boolean").alias("gap"),
        )
    )
    # Moments of (1, other, mean over the group's other rows, own) over complete rows, from the sums of each group.
    n, cp, cw, pp, ww, pw = (F.col(c).cast("double") for c in ("n", "cp", "cw", "pp", "ww", "pw"))

    def complete(own: Column, oq: Column, other: Column, xq: Column, cross: Column) -> dict[str, Column]:
        d = n - 1
        return {
            "00": n, "01": other, "02": own, "03": own, "11": xq, "12": (own * other - cross) / d, "13": cross,
            "22": (n * own * own - 2 * own * own + oq) / (d * d), "23": (own * own - oq) / d, "33": oq,
        }

    forms = {"p": complete(cp, pp, cw, ww, pw), "w": complete(cw, ww, cp, pp, pw)}
    fixed = sums.where("n >= 2").agg(*(F.sum(c).alias(f + ij) for f, m in forms.items() for ij, c in m.items())).first()
    fixed = {f: _moments(fixed, f, 4) for f in forms}

    need = sums.where("gap").select("_g", "np", "nw", "sp", "sw", "lop", "hip", "low", "hiw")
    # A row without a group meets no other: it isn't brought to the join, where all such rows would come together.
    lone = base.where(~both & F.col("_g").isNull())
    joined = base.where(~both & F.col("_g").isNotNull()).join(need, "_g", "left").unionByName(lone, allowMissingColumns=True)
    rows = joined.select(
        "_k", "_g", "_p", "_w", "lop", "hip", "low", "hiw",
        F.when(F.col("_p").isNotNull(), F.log1p("_p")).alias("lp"), F.when(F.col("_w").isNotNull(), F.log1p("_w")).alias("lw"),
        # The mean over the other rows that have the field; null if there are none.
        F.when(F.col("np") - F.col("_p").isNotNull().cast("int") > 0, (F.col("sp") - F.coalesce(F.log1p("_p"), F.lit(0.0))) / (F.col("np") - F.col("_p").isNotNull().cast("int"))).alias("mp"),
        F.when(F.col("nw") - F.col("_w").isNotNull().cast("int") > 0, (F.col("sw") - F.coalesce(F.log1p("_w"), F.lit(0.0))) / (F.col("nw") - F.col("_w").isNotNull().cast("int"))).alias("mw"),
    )
    rows = rows.withColumn("fp", F.coalesce("lp", "mp")).withColumn("fw", F.coalesce("lw", "mw"))
    rows = durable(rows)

    def predicted(field: str, beta: np.ndarray, sd: float) -> Column:
        own, mean, other = f"l{field}", F.col(f"m{field}"), F.col("fw" if field == "p" else "fp")
        y = F.lit(float(beta[0])) + F.lit(float(beta[1])) * other + F.lit(float(beta[2])) * mean
        y = F.coalesce(y, mean)  # the other field can't be had for this row
        if residual and sd > 0:
            y = y + F.lit(sd) * _noise("_k", field)
        lo, hi = ("lop", "hip") if field == "p" else ("low", "hiw")
        y = F.greatest(F.least(y, F.log1p(hi)), F.log1p(lo))
        return F.coalesce(F.col(own), F.when(mean.isNotNull(), y))

    for _ in range(iterations):
        for f, other in (("w", "fp"), ("p", "fw")):
            # Rows with this field observed and the other one filled take part in the fit.
            x = [F.lit(1.0), F.col(other), F.col(f"m{f}"), F.col(f"l{f}")]
            usable = rows.where(F.col(f"l{f}").isNotNull() & F.col(f"m{f}").isNotNull() & F.col(other).isNotNull())
            more = usable.agg(*(F.sum(x[i] * x[j]).alias(f"{f}{i}{j}") for i in range(4) for j in range(i, 4))).first()
            rows = rows.withColumn(f"f{f}", predicted(f, *_solve(fixed[f] + _moments(more, f, 4))))
        rows = durable(rows)  # keeps the expressions of the rounds from nesting

    back = lambda c: F.round(F.expm1(c)).cast("long")
    fw = F.coalesce("_w", F.greatest(back("fw"), F.coalesce(F.col("_p"), F.lit(0))))
    fp = F.coalesce("_p", F.least(back("fp"), fw))

    def status(raw: str, mean: str) -> Column:
        return F.when(F.col(raw).isNotNull(), OBSERVED).when(F.col(mean).isNotNull(), FILLED).otherwise(MISSING)

    return rows.select(
        F.col("_k").alias(key), F.col("_g").alias(group),
        F.when(F.col("_p").isNotNull() | F.col("mp").isNotNull(), fp).alias(part), status("_p", "mp").alias(f"{part}_status"),
        F.when(F.col("_w").isNotNull() | F.col("mw").isNotNull(), fw).alias(whole), status("_w", "mw").alias(f"{whole}_status"),
    )


def _class_moments(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Rows of each class of each group, and count, sum and sum of squares of each feature in it."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(a for x in features for a in (F.count(x).alias(f"c{x}"), F.sum(x).alias(f"s{x}"), F.sum(F.col(x) * F.col(x)).alias(f"q{x}"))),
    )


def impute_identifiers(df: DataFrame, key: str, groups: list[str], field: str, features: tuple[str, ...] = (), iterations: int = 3, draw: bool = False) -> DataFrame:
    """Fill a missing identifier by a classifier fitted on the observed rows of the same group.

    The categorical step of the chained equations is naive Bayes over the group's
    classes: the frequency of a class times the normal densities of the numeric
    ``features`` that the row has, with the class's mean and a variance drawn
    toward that of the group. The most likely class wins (ties: the smallest), or,
    with ``draw``, one is drawn by its probability, fixed by the row's key. Filled
    rows then take part in the fit, under their mask, which is repeated until no
    row changes its class, ``iterations`` times at most. A group with one class
    leaves nothing to decide, so only rows of other groups meet the classes, and
    only those of their group. Moments are reduced per (group, class) before the shuffle.

    Returns one row per row whose ``field`` is missing (null, blank or a word
    for "none"): ``key``, the groups, ``field`` (null where no row supplies it)
    and ``<field>_status``. A group with a null in its key supplies nothing.
    Null and NaN features count as not seen. An empty table gives no rows.
    """
    names, xs = [f"_g{i}" for i in range(len(groups))], [f"_x{i}" for i in range(len(features))]
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    base = df.select(
        F.col(f"`{key}`").alias("_k"), *(F.col(f"`{c}`").alias(n) for c, n in zip(groups, names)), identifier_or_null(field).alias("_v"), *(number(c).alias(x) for c, x in zip(features, xs))
    )
    stats = durable(_class_moments(base.where(F.col("_v").isNotNull()).dropna(subset=names), [*names, "_v"], xs))
    within = lambda x: F.col(f"q{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.when(F.col(f"c{x}") > 0, F.col(f"c{x}"))
    per = stats.groupBy(*names).agg(F.count(F.lit(1)).alias("k"), F.min("_v").alias("_one"), *((F.sum(within(x)) / F.sum(f"c{x}")).alias(f"v{x}") for x in xs))
    missing = base.where(F.col("_v").isNull()).drop("_v")
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names), F.lit(True))
    found = missing.where(whole).join(per, names, "left").unionByName(missing.where(~whole), allowMissingColumns=True)
    filled = found.where("k is null or k = 1").select("_k", *names, F.col("_one").alias("_best"))
    if not per.where("k > 1").isEmpty():
        filled = filled.unionByName(_classified(durable(found.where("k > 1")), stats, per, names, xs, iterations, draw))
    return filled.select(
        F.col("_k").alias(key), *(F.col(n).alias(c) for c, n in zip(groups, names)), F.col("_best").alias(field),
        F.when(F.col("_best").isNotNull(), FILLED).otherwise(MISSING).alias(f"{field}_status"),
    )


def _classified(rows: DataFrame, stats: DataFrame, per: DataFrame, names: list[str], xs: list[str], iterations: int, draw: bool) -> DataFrame:
    """The class of each row by its group's classes, refitted with the filled rows."""
    fit = stats.join(per.where("k > 1").select(*names), names, "left_semi")
    observed, label = durable(fit), None
    fit = observed
    for _ in range(max(1, iterations)):
        score = F.log("n")
        for x in xs:
            mean = F.col(f"s{x}") / F.when(F.col(f"c{x}") > 0, F.col(f"c{x}"))
            var = (F.greatest(F.col(f"q{x}") - F.col(f"s{x}") * mean, F.lit(0.0)) + F.coalesce(F.col(f"v{x}"), F.lit(0.0)) + 1e-9) / (F.col(f"c{x}") + 1)
            density = -0.5 * F.log(var) - (F.col(x) - mean) * (F.col(x) - mean) / (2 * var)
            score = score + F.coalesce(density, F.lit(0.0))  # not seen in the row or the class
        if draw:
            unit = (F.xxhash64("_k", "_v").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
            score = score - F.log(-F.log(unit))  # the greatest of these is a draw by probability
        scored = rows.join(fit, names).withColumn("_score", F.round(score, 9))
        best = durable(scored.groupBy("_k", *names, *xs).agg(F.min_by("_v", F.struct(-F.col("_score"), F.col("_v"))).alias("_best")))
        if label is not None and best.join(label, ["_k", *names]).where("_best <> _was").isEmpty():
            break
        label = best.select("_k", *names, F.col("_best").alias("_was"))
        more = _class_moments(best.withColumnRenamed("_best", "_v"), [*names, "_v"], xs)
        fit = durable(observed.unionByName(more).groupBy(*names, "_v").agg(*(F.sum(c).alias(c) for c in observed.columns if c not in (*names, "_v"))))
    return best.select("_k", *names, "_best")


def with_fills(df: DataFrame, fills: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """All rows and columns of ``df``, with the filled values and ``<field>_status`` marks of ``fills`` put in.

    ``fields`` maps each field to its cleaned expression (what counts as observed). ``key`` must be unique.
    """
    f = fills.select(F.col(key).alias("_fk"), *(F.col(c).alias(f"_f_{c}") for c in fields), *(F.col(f"{c}_status").alias(f"_s_{c}") for c in fields))
    joined = df.join(f, df[f"`{key}`"] == F.col("_fk"), "left")
    done = {c: F.coalesce(clean, F.col(f"_f_{c}").cast(df.schema[c].dataType)) for c, clean in fields.items()}
    marks = {f"{c}_status": F.coalesce(F.col(f"_s_{c}"), F.lit(OBSERVED)) for c in fields}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in fields and c not in marks]
    return joined.select(*keep, *(v.alias(c) for c, v in (done | marks).items()))
