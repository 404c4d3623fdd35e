"""Groups of similar cells by spectral clustering with power iteration on a sparse, factored affinity.

The affinity is never written as pairs. Every cell falls into a few buckets of
like cells, and A = Z Z' with Z the cell x bucket incidence: the number of buckets
two cells share. Its random-walk normalisation D^-1 A is "mean over my buckets,
weighted by their sizes, of the mean over their members", two sparse products
whose cost is the number of incidences, whatever the size of a group.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import durable, ship, small_side
from methloom.operators.imputation import identifier_or_null

#: Cells are alike if their mean absolute difference over shared features, and that of their levels, is within this.
TOLERANCE = 0.10
TABLES, SPARE_BITS, WILD, LEVEL_WIDTH = 6, 6, 6, 0.12
ROUNDS = 4
#: Most features of a panel; a panel is a fixed list of regions, one array per cell.
PANEL = 20_000
#: Values of a dense block that is worked on at a time.
BLOCK_VALUES = 4_000_000
#: Cells of a group that one task compares; a larger group is split by level and salt.
BLOCK_CELLS = 2048
#: Places of the embedding: points are counted at 1 / FINE; seeds are the occupied places of a grid that lie farther than JOIN from a heavier one.
FINE, _GRID, JOIN = 256, 0.1, 0.04
#: Lloyd's steps end when no centre moves farther than this.
SHIFT = 1e-4
#: The embedding is clustered in boxes of this width, each with the points beyond its edges up to HALO.
BOX, HALO, BOX_POINTS = 0.25, 0.08, 1000


def cell_table(matrix: DataFrame, qc: DataFrame, unnamed: bool = False) -> DataFrame:
    """One row per named cell: ``cell_id``, ``level`` and ``f``, its features (region, sum and number of values).

    A row without identifier belongs to the cell of its (library_id, cell_row), by
    the least name if that has several. Cells that no row names have no level to
    compare; they are left out, or, with ``unnamed``, kept as '(unnamed)
    library_id:cell_row' ('?' for a null). The level is the mean of the non-null QC
    levels, values above 1 taken as percents; null without QC rows. Repeated rows
    are averaged, null values skipped.
    """
    place = ["library_id", "cell_row"]
    part = matrix.select(*place, "region_idx", identifier_or_null("cell_id").alias("cell"), F.col("mean_meth").alias("v")).groupBy(*place, "region_idx", "cell").agg(
        F.sum("v").alias("s"), F.count("v").cast("int").alias("n")
    )
    # A few entries per region and cell at most from here on.
    rows = part.groupBy(*place).agg(
        F.min("cell").alias("cell_id"), F.collect_list(F.when((F.col("n") > 0) & F.col("region_idx").isNotNull(), F.struct(F.col("region_idx").alias("r"), "s", "n"))).alias("f")
    )
    if unnamed:
        at = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in place))
        rows = rows.withColumn("cell_id", F.coalesce("cell_id", F.concat(F.lit("(unnamed) "), at)))
    else:
        rows = rows.where("cell_id is not null")
    cells = rows.groupBy("cell_id").agg(F.flatten(F.collect_list("f")).alias("f"))
    m = F.col("mean_meth")
    levels = qc.where(F.col("cell_id").isNotNull() & m.isNotNull()).groupBy("cell_id").agg(F.avg(F.when(m > 1, m / 100).otherwise(m)).alias("level"))
    return cells.join(levels, "cell_id", "left").select("cell_id", "level", "f")


def _splits(cells: DataFrame) -> tuple[list[int], list[tuple[int, float]], int]:
    """The panel; the features that part cells clearly, best first, with the threshold of best separation (by histogram); the number of cells."""
    bins = 40
    x = cells.select(F.explode("f").alias("x")).select("x.r", F.least(F.floor(F.col("x.s") / F.col("x.n") * bins), F.lit(bins - 1)).cast("int").alias("b"))
    per = x.groupBy("r", "b").agg(F.count(F.lit(1)).alias("c")).groupBy("r").agg(F.collect_list(F.struct("b", "c")).alias("h"))
    rows = per.limit(PANEL + 1).collect()  # one short row per feature of the panel
    if len(rows) > PANEL:
        raise ValueError(f"more than {PANEL} features")
    scored = []
    for r in rows:
        h = np.zeros(bins)
        for e in r.h:
            h[max(0, e.b)] += e.c
        mid, n = (np.arange(bins) + 0.5) / bins, h.sum()
        low, mass = np.cumsum(h)[:-1], np.cumsum(h * mid)[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = (h @ mid - mass) / (n - low) - mass / low
            spread = np.nan_to_num(low * (n - low) / n**2 * gap**2)
        best = np.flatnonzero(spread >= spread.max() * (1 - 1e-9))
        k = int(best[len(best) // 2])
        if spread[k] > 0 and gap[k] > 2 * TOLERANCE and min(low[k], n - low[k]) > 0.02 * n:
            scored.append((float(spread[k]), r.r, (k + 1) / bins))
    scored.sort(reverse=True)
    return sorted(r.r for r in rows), [(r, t) for _, r, t in scored], cells.count()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, well mixed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _dense(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _lists(flat: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list per owner 0 .. n - 1 of the values it owns."""
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), pa.array(flat[order]))


class _Tables:
    """The tables of features whose states make the bucket keys, and their parts, numbered like a heap: 1 is the table, 2 k and 2 k + 1 the halves of part k."""

    def __init__(self, panel: list[int], clear: list[tuple[int, float]], n: int):
        place = {r: i for i, r in enumerate(panel)}
        #: A key's length follows the number of cells; codes have up to 62 bits.
        bits = min(len(clear), 62, SPARE_BITS + max(1, math.ceil(math.log2(n + 1))))
        rng = np.random.default_rng(7)
        deck: list[int] = []
        picks = []
        for _ in range(TABLES):  # tables share as few features as possible
            pick: list[int] = []
            while len(pick) < bits:
                if not deck:
                    deck = rng.permutation(len(clear)).tolist()
                c = deck.pop()
                if c not in pick:
                    pick.append(c)
            picks.append(pick)
        used = sorted({c for p in picks for c in p})
        col = {c: i for i, c in enumerate(used)}
        self.at = np.array([place[clear[c][0]] for c in used], int)
        self.cut = np.array([clear[c][1] for c in used])
        self.parts: dict[tuple[int, int], np.ndarray] = {}
        for t, pick in enumerate(picks):
            todo = [(1, [col[c] for c in pick])]
            while todo:
                k, p = todo.pop()
                self.parts[t, k] = np.array(p, int)
                if len(p) > WILD:
                    todo += [(2 * k, p[: len(p) // 2]), (2 * k + 1, p[len(p) // 2 :])]

    def states(self, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states aren't known or lie close to the threshold, and which of the others are high."""
        x = vals[:, self.at]
        wild = ~(np.abs(x - self.cut) > 0.05)
        return wild, (x > self.cut) & ~wild

    def head(self, t: int, k: int, level: np.ndarray) -> np.ndarray:
        """The part and the bin of the level, shifted from table to table, as one number."""
        return (((k - 1) << 3 | t) << 32) + (np.floor(level / LEVEL_WIDTH + t / TABLES).astype(np.int64) & 0xFFFFFFFF)

    def readings(self, t: int, k: int, level: np.ndarray, wild: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of all readings of the rows' states in a part, a wild state standing for both; no row has more than WILD there."""
        p = self.parts[t, k]
        weight = np.int64(1) << np.arange(len(p), dtype=np.int64)
        base, w = high[:, p] @ weight, wild[:, p]
        many = w.sum(1)
        rows, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(many):
            r = np.flatnonzero(many == n)
            free = weight[np.argsort(~w[r], axis=1, kind="stable")[:, :n]] if n else np.empty((len(r), 0), np.int64)
            choice = np.array(list(itertools.product((0, 1), repeat=int(n))), np.int64).reshape(1 << int(n), int(n))
            rows.append(np.repeat(r, len(choice)))
            codes.append((base[r][:, None] + free @ choice.T).ravel())
        row, code = np.concatenate(rows), np.concatenate(codes)
        # The highest bit but one is that of exact buckets.
        key = _mixed(_mixed(self.head(t, k, level)[row]) ^ _mixed(code + 1)) & np.uint64((1 << 62) - 1)
        return row, key.astype(np.int64)


def _keyed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells, numbered (``cid``), with ``vals`` (dense over the panel, NaN where not seen) and ``buckets``; the exact buckets (``cid``, ``b``).

    A bucket key of a table joins the high/low states of some features and a
    shifted bin of the level. A state that isn't known or lies close to the
    threshold stands for both, so one cell can have several keys in a table. A
    table with more than WILD such states isn't read for the cell: it seeks its
    mates by the halves of the table's features, by the halves of a half that has
    too many again, and so on, down to parts no longer than WILD, which any cell
    can read. Of two cells that differ in no state and share the bin, one is a
    seeker on some part both can read, unless both read the whole table. What
    is found so is checked exactly; a seeker and its mates are one exact bucket.
    Keys are hashes; two that meet by chance only make a bucket larger.
    """
    panel, clear, n = _splits(cells)
    order = np.array(panel, np.int64)
    tables, width = _Tables(panel, clear, n), len(panel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, BLOCK_VALUES // max(1, width))
            for b in (whole.slice(i, step) for i in range(0, len(whole), step)):
                m, f = len(b), b.column("f")
                owner = np.repeat(np.arange(m), f.value_lengths().to_numpy(zero_copy_only=False))
                x = f.flatten()
                at = owner * width + np.searchsorted(order, x.field("r").to_numpy(zero_copy_only=False))
                total = np.bincount(at, x.field("s").to_numpy(zero_copy_only=False), m * width)
                count = np.bincount(at, x.field("n").to_numpy(zero_copy_only=False), m * width)
                with np.errstate(invalid="ignore"):
                    vals = (total / count).reshape(m, width)
                wild, high = tables.states(vals)
                level = b.column("level").to_numpy(zero_copy_only=False).astype(float)
                able = np.isfinite(level) & np.isfinite(vals).any(1)
                mine: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
                sought, heads = list(mine), list(mine)
                todo = [(t, 1, np.flatnonzero(able)) for t in range(TABLES)]
                while todo:
                    t, k, rows = todo.pop()
                    over = wild[np.ix_(rows, tables.parts[t, k])].sum(1) > WILD
                    if over.any():
                        todo += [(t, 2 * k, rows[over]), (t, 2 * k + 1, rows[over])]
                    fit = rows[~over]
                    row, key = tables.readings(t, k, level[fit], wild[fit], high[fit])
                    (mine if k == 1 else sought).append((fit[row], key))
                    if k > 1:
                        heads.append((fit, tables.head(t, k, level[fit])))
                keys, seek, asked = (_lists(np.concatenate([k for _, k in x]), np.concatenate([r for r, _ in x]), m) for x in (mine, sought, heads))
                yield pa.RecordBatch.from_arrays([b.column("cell_id"), b.column("level"), pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(vals.ravel())), keys, seek, asked], names=["cell_id", "level", "vals", "buckets", "seek", "asked"])

    ship(cells.sparkSession)
    made = cells.mapInArrow(run, "cell_id string, level double, vals array<double>, buckets array<long>, seek array<long>, asked array<long>")
    keyed = durable(made.withColumn("cid", F.monotonically_increasing_id()))
    seeks = keyed.select(F.col("cid").alias("s"), F.col("level").alias("_l"), F.explode("seek").alias("b"))
    nothing = keyed.select("cid", F.lit(0).cast("long").alias("b")).limit(0)
    # The parts and bins of the level that are sought at all: at most as many as there are parts of tables, times bins.
    asked = np.array([r.h for r in keyed.select(F.explode("asked").alias("h")).distinct().collect()], np.int64)
    if not len(asked):
        return keyed.drop("seek", "asked"), nothing
    halves = [(t, k) for t, k in tables.parts if k > 1 and (asked >> 32 == (k - 1) << 3 | t).any()]

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wild, high = tables.states(_dense(b.column("vals"), width))
            level, cid = b.column("level").to_numpy(zero_copy_only=False).astype(float), b.column("cid").to_numpy()
            for t, k in halves:
                fit = np.flatnonzero((wild[:, tables.parts[t, k]].sum(1) <= WILD) & np.isin(tables.head(t, k, level), asked))
                row, key = tables.readings(t, k, level[fit], wild[fit], high[fit])
                yield pa.RecordBatch.from_arrays([pa.array(cid[fit[row]]), pa.array(level[fit[row]]), pa.array(key)], names=["cid", "level", "b"])

    offers = keyed.where("level is not null").select("cid", "level", "vals").mapInArrow(offer, "cid long, level double, b long")
    near = (F.col("s") != F.col("cid")) & (F.abs(F.col("level") - F.col("_l")) <= TOLERANCE)
    found = offers.join(small_side(seeks), "b").where(near).select("s", "cid").distinct()
    one = keyed.select("cid", "level", "vals")
    both = found.join(one.select(F.col("cid").alias("s"), F.struct("level", "vals").alias("a")), "s").join(one.select("cid", F.struct("level", "vals").alias("b")), "cid")
    mates = durable(both.where(_alike("a", "b", TOLERANCE)).select("s", "cid"))
    exact = mates.unionByName(mates.select("s", F.col("s").alias("cid"))).distinct()
    # Above all keys of tables.
    return keyed.drop("seek", "asked"), exact.select("cid", F.xxhash64("s").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)).alias("b"))


def _unit(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 39)) - 1


def _lloyd(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """K-means of weighted points by Lloyd's steps, from the occupied grid places, the heaviest first; the centre of each point.

    A place within JOIN of a heavier seed is none. Points go to the nearest
    centre and centres to their points' mean until none moves farther than SHIFT.
    """
    spot, own = np.unique(np.floor(points / _GRID), axis=0, return_inverse=True)
    heavy = np.bincount(own.ravel(), weight)
    mean = np.stack([np.bincount(own.ravel(), weight * points[:, d]) / heavy for d in range(points.shape[1])], 1)
    centres = np.empty((0, points.shape[1]))
    for i in np.argsort(-heavy, kind="stable"):
        if not len(centres) or ((centres - mean[i]) ** 2).sum(1).min() > JOIN**2:
            centres = np.vstack([centres, mean[i]])
    while True:
        near = np.empty(len(points), np.int64)
        step = max(1, BLOCK_VALUES // len(centres))
        for i in range(0, len(points), step):
            near[i : i + step] = (((points[i : i + step] ** 2).sum(1)[:, None] + (centres**2).sum(1)) - 2 * points[i : i + step] @ centres.T).argmin(1)
        mass = np.bincount(near, weight, len(centres))
        moved = np.stack([np.bincount(near, weight * points[:, d], len(centres)) for d in range(points.shape[1])], 1) / np.maximum(mass, 1e-300)[:, None]
        moved = np.where(mass[:, None] > 0, moved, centres)
        shift, centres = np.abs(moved - centres).max(), moved
        if shift <= SHIFT:
            return near


def _embedding_clusters(x: DataFrame, vs: list[str], n: int) -> DataFrame:
    """K-means of the embedding of ``n`` cells at most: ``cid`` and ``grp``, the number of its cluster.

    Like points are counted as one, so that a group of any size is a few weighted
    points. The space is cut into boxes, each clustered with the points around it
    up to HALO, wider than a settled group; a point takes the cluster of its own
    box. A cluster is named by the least of its points, so boxes agree on a
    cluster that both see whole.
    """
    places = [F.floor(F.col(v) * FINE).cast("int").alias(f"p{i}") for i, v in enumerate(vs)]
    names = [f"p{i}" for i in range(len(vs))]
    x = x.select("cid", *vs, *places)
    points = x.groupBy(*names).agg(F.count(F.lit(1)).alias("w"), *(F.avg(v).alias(v) for v in vs)).withColumn("name", F.xxhash64(*names))
    dims = min(len(vs), max(1, math.ceil(math.log(n / BOX_POINTS + 1, 6))))
    box = F.array(F.array().cast("array<int>"))
    for v in vs[:dims]:
        own = F.floor(F.col(v) / BOX).cast("int")
        within = F.col(v) - own * BOX
        box = _product(box, F.when(within < HALO, F.array(own, own - 1)).when(within > BOX - HALO, F.array(own, own + 1)).otherwise(F.array(own)))
    spread = points.select("name", "w", *vs, F.array(*(F.floor(F.col(v) / BOX).cast("int") for v in vs[:dims])).alias("own"), F.explode(box).alias("box"))

    def cluster(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("name", kind="stable")
        name, own = df["name"].to_numpy(), df["mine"].to_numpy(bool)
        near = _lloyd(df[vs].to_numpy(float), df["w"].to_numpy(float))
        label = np.full(near.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(label, near, name)
        return pd.DataFrame({"name": name[own], "grp": label[near][own]})

    labelled = spread.select(F.concat_ws("_", "box").alias("box"), "name", "w", *vs, (F.col("own") == F.col("box")).alias("mine")).groupBy("box").applyInPandas(cluster, "name long, grp long")
    return x.select("cid", F.xxhash64(*names).alias("name")).join(labelled, "name").select("cid", "grp")


def _embedded(cells: DataFrame, rounds: int, vectors: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells with number and values, their shared buckets (``cid``, ``b``, and ``w``, how many cells share it) and their first labels (``cid``, ``grp``)."""
    cells, exact = _keyed(durable(cells))
    z = cells.select("cid", F.explode("buckets").alias("b")).unionByName(exact)
    shared = z.groupBy("b").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    z = durable(z.join(shared, "b").select("cid", "b", "w"))
    n = cells.count()
    if vectors is None:
        vectors = max(5, 2 + math.ceil(math.log(n + 1, 16)))
    vs = [f"x{i}" for i in range(vectors)]
    # The start: one random value per smallest shared bucket, so that large groups keep apart too.
    x = z.groupBy("cid").agg(F.min("b").alias("m")).select("cid", *(_unit(F.col("m"), F.lit(i)).cast("float").alias(v) for i, v in enumerate(vs)))
    for _ in range(rounds):
        y = z.join(x, "cid").groupBy("b").agg(*(F.avg(v).cast("float").alias(v) for v in vs))
        x = z.join(y, "b").groupBy("cid").agg(*((F.sum(F.col("w") * F.col(v)) / F.sum("w")).cast("float").alias(v) for v in vs))
    return cells, z, durable(_embedding_clusters(durable(x), vs, n))


def _meetings(z: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs of labels ``ga`` < ``gb`` that cells of one bucket have."""
    ends = z.join(label.select("cid", "grp"), "cid").select("b", "grp").distinct()
    mixed = ends.groupBy("b").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("b")
    ends = ends.join(mixed, "b")
    return ends.withColumnRenamed("grp", "ga").join(ends.withColumnRenamed("grp", "gb"), "b").where("ga < gb").select("ga", "gb").distinct()


def _settled(z: DataFrame, label: DataFrame, most: int = 20) -> DataFrame:
    """Labels after cells have moved to the group that holds most of their affinity, and ``k``, what of it stays there.

    This joins groups that k-means cut. Moves go to greater names in one round and
    to lesser ones in the next, so that two cells can't just change places; it
    ends when two rounds in a row move none, or after ``most`` rounds.
    """
    quiet, up = 0, True
    while True:
        zl = z.join(label.select("cid", "grp"), "cid")
        inside = zl.groupBy("b", "grp").agg(F.count(F.lit(1)).alias("k"))
        toward = zl.withColumnRenamed("grp", "cur").join(inside, "b").where(F.col("grp") >= F.col("cur") if up else F.col("grp") <= F.col("cur"))
        stays = F.col("grp") == F.col("cur")
        per = toward.groupBy("cid", "cur", "grp").agg(F.sum(F.col("k") - stays.cast("int")).alias("k"))
        label = durable(per.groupBy("cid", "cur").agg(F.max_by("grp", F.struct("k", stays, "grp")).alias("grp"), F.max("k").alias("k")))
        quiet, up, most = (quiet + 1 if label.where("cur <> grp").isEmpty() else 0), not up, most - 1
        if quiet == 2 or most <= 0:
            return label.drop("cur")


def spectral_groups(cells: DataFrame, rounds: int = ROUNDS, vectors: int | None = None) -> DataFrame:
    """Divide cells into groups: ``cell_id``, ``grp``, ``affinity``, ``level``, ``vals``.

    ``cells`` has cell_id (unique), level and f as ``cell_table`` gives them. Power
    iteration of the normalised affinity carries ``vectors`` values per cell
    (default: 2 and one more per factor of 16 in cells, 5 at least, so that groups
    stay apart in the embedding however many there are); after ``rounds`` the
    cells of a group have all but the same embedding, which k-means divides; then
    cells move to the group that most of their affinity goes to. ``affinity`` is the
    share of a cell's affinity that stays in the group. A cell in no shared bucket
    (also: without level or features) is a group of its own. An empty table gives no rows.
    """
    cells, z, label = _embedded(cells, rounds, vectors)
    label = _settled(z, label)
    degree = z.groupBy("cid").agg(F.sum(F.col("w") - 1).alias("w"))
    affinity = degree.join(label, "cid").select("cid", F.concat(F.lit("g"), F.hex("grp")).alias("grp"), (F.col("k") / F.col("w")).alias("affinity"))
    return cells.drop("buckets").join(affinity, "cid", "left").select(
        "cell_id", F.coalesce("grp", F.concat(F.lit("single:"), "cell_id")).alias("grp"), F.coalesce("affinity", F.lit(0.0)).alias("affinity"), "level", "vals"
    )


def groups_and_meetings(cells: DataFrame, rounds: int = ROUNDS, vectors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The clusters of the embedding (``cell_id``, ``grp``, ``level``, ``vals``; cells that share no bucket left out), and the pairs of them that share a bucket (``ga`` < ``gb``).

    No pair of cells that shares a bucket is lost between the two, however
    k-means divides the embedding.
    """
    cells, z, label = _embedded(cells, rounds, vectors)
    return cells.join(label, "cid").select("cell_id", "grp", "level", "vals"), _meetings(z, label)


def _product(rows: Column, side: Column) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.transform(side, lambda s: F.array_append(r, s))))


def _alike(a: str, b: str, tolerance: float) -> Column:
    """Whether the vectors and levels of two cells are within the tolerance; not if they share no feature."""
    diff = F.zip_with(f"{a}.vals", f"{b}.vals", lambda x, y: F.abs(x - y))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    seen = lambda v: v.isNotNull() & ~F.isnan(v)
    mean = F.aggregate(diff, zero, lambda t, v: F.struct((t.s + F.when(seen(v), v).otherwise(0.0)).alias("s"), (t.n + seen(v).cast("int")).alias("n")), lambda t: t.s / F.when(t.n > 0, t.n))
    return (F.abs(F.col(f"{a}.level") - F.col(f"{b}.level")) <= tolerance) & (mean <= tolerance)


def _pairs_of(cells: DataFrame, tolerance: float) -> DataFrame:
    """The alike pairs a < b of the rows (``u``, ``side``, ``cell_id``, ``level``, ``vals``) of one unit ``u``: of side 0 each with each, of side 1 with those of side 2.

    Rows come sorted by unit, side and level, so those of a unit that a cell's
    level allows lie together; only these are compared, in blocks.
    """
    ship(cells.sparkSession)

    def compare(t: pa.Table) -> pa.RecordBatch:
        b = t.combine_chunks()
        u, level, side = b["u"].to_numpy(), b["level"].to_numpy(), b["side"].to_numpy()
        name = b["cell_id"].combine_chunks() if isinstance(b["cell_id"], pa.ChunkedArray) else b["cell_id"]
        vals = b["vals"].combine_chunks() if isinstance(b["vals"], pa.ChunkedArray) else b["vals"]
        v = _dense(vals, len(vals.flatten()) // len(b))
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
        for i, j in zip(edge[:-1], edge[1:]):
            mid = i + int(np.searchsorted(side[i:j], 2))
            of = level[i:mid]
            if side[i] == 0:  # with all that follow
                n = np.searchsorted(level[i:j], of + tolerance + 1e-9, "right") - np.arange(1, j - i + 1)
                first = np.arange(i + 1, j + 1)
            else:
                first = mid + np.searchsorted(level[mid:j], of - tolerance - 1e-9)
                n = mid + np.searchsorted(level[mid:j], of + tolerance + 1e-9, "right") - first
            n = np.maximum(n, 0)
            one.append(np.repeat(np.arange(i, mid), n))
            two.append(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        a, c = np.concatenate(one), np.concatenate(two)
        good = np.zeros(len(a), bool)
        step = max(1, BLOCK_VALUES // max(1, v.shape[1]))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], c[i : i + step]
            d = np.abs(v[x] - v[y])
            seen = ~np.isnan(d)
            n = seen.sum(1)
            good[i : i + step] = (np.abs(level[x] - level[y]) <= tolerance) & (n > 0) & (np.where(seen, d, 0).sum(1) <= tolerance * n * (1 + 1e-12))
        left, right = name.take(pa.array(a[good])), name.take(pa.array(c[good]))
        return pa.RecordBatch.from_arrays([left, right], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            u = b.column("u").to_numpy()
            last = int(np.flatnonzero(u != u[-1])[-1]) + 1 if (u != u[-1]).any() else 0
            if last or held and held[-1].column("u")[-1].as_py() != u[-1]:  # whole units, up to the last one
                held.append(b.slice(0, last))
                yield compare(pa.Table.from_batches([h for h in held if len(h)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield compare(pa.Table.from_batches(held))

    found = cells.sortWithinPartitions("u", "side", "level").select("u", "side", "cell_id", "level", "vals").mapInArrow(run, "a string, b string")
    return found.select(F.least("a", "b").alias("cell_id_a"), F.greatest("a", "b").alias("cell_id_b"))


def cell_pairs(groups: DataFrame, tolerance: float = TOLERANCE, meetings: DataFrame | None = None, block: int = BLOCK_CELLS) -> DataFrame:
    """The pairs a < b of one group, or of two groups of ``meetings``, that an exact check of both differences confirms.

    A group of more than ``block`` cells (fewer where a cell has very many features)
    is parted by bins of the level, as wide as the tolerance, and these by salt, so that no task holds more than two parts of
    about that many cells; parts whose levels can't be within the tolerance don't
    meet. Features travel once per cell and pair of parts, not once per pair of
    cells. The result has as many rows as there are such pairs, which is what is
    asked for. Cells without level have no pair.
    """
    g = groups.where("level is not null").select("cell_id", F.xxhash64("grp").alias("g"), "level", "vals", *([F.col("affinity")] if "affinity" in groups.columns else []))
    g = durable(g)
    one = g.select(F.size("vals").alias("w")).first()
    block = min(block, max(16, 4 * BLOCK_VALUES // max(1, one.w if one else 1)))  # wide panels: fewer cells, so that a block's features stay within 128 MB
    sizes = g.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    heavy = sizes.where(F.col("n") > block)
    many = not heavy.isEmpty()
    lone = F.col("affinity") > 0 if "affinity" in groups.columns else F.lit(True)
    bin_ = F.floor(F.col("level") / tolerance)
    if many:
        per = g.join(heavy.select("g"), "g").groupBy("g", bin_.alias("bin")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("salts"))
        parts = durable(per)
        put = g.withColumn("bin", bin_).join(parts, ["g", "bin"], "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("cell_id"), "salts")))
        put = durable(put.withColumn("bin", F.when(F.col("salts").isNotNull(), F.col("bin"))).withColumn("p", F.when(F.col("salts").isNull(), F.col("g")).otherwise(F.xxhash64("g", "bin", "salt"))).drop("salts"))
    else:
        put = g.withColumn("bin", F.lit(None).cast("long")).withColumn("salt", F.lit(None).cast("long")).withColumn("p", F.col("g"))
    own = put.where(lone).select(F.col("p").alias("u"), F.lit(0).alias("side"), "cell_id", "level", "vals").repartition("u")
    pairs = _pairs_of(own, tolerance)
    blocks = put.select("g", "bin", "p").distinct() if many else sizes.select("g", F.lit(None).cast("long").alias("bin"), F.col("g").alias("p"))
    met = None
    near = (F.col("x.bin") - F.col("y.bin")).between(-1, 1)
    ends = [F.col("x.p").alias("one"), F.col("y.p").alias("two")]
    if many:
        split = durable(blocks.where("bin is not null"))
        met = split.alias("x").join(split.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.p") < F.col("y.p"))).where(near).select(*ends)
    if meetings is not None:
        m = meetings.select(F.xxhash64("ga").alias("ga"), F.xxhash64("gb").alias("gb"))
        across = m.join(blocks.alias("x"), F.col("ga") == F.col("x.g")).join(blocks.alias("y"), F.col("gb") == F.col("y.g")).where(F.coalesce(near, F.lit(True))).select(*ends)
        met = across if met is None else met.unionByName(across)
    if met is None:
        return pairs
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("p"), F.lit(k).alias("side")) for k, c in ((1, "one"), (2, "two")))))
    send = met.select(F.xxhash64("one", "two").alias("u"), ends.alias("x")).select("x.p", "u", "x.side")
    both = send.join(put.select("p", "cell_id", "level", "vals"), "p").select("u", "side", "cell_id", "level", "vals").repartition("u")
    return pairs.unionByName(_pairs_of(both, tolerance))


def purified(groups: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Groups whose members are all alike their most typical cell, by the exact check.

    Members that aren't leave the group and form the next one, under their own
    most typical cell, until no member is left. One join of the members left with
    one row per group a round, no pairs; as many rounds as the most mixed group has
    groups in it.
    """
    rest, done, k = durable(groups), [], 0
    while not rest.isEmpty():  # a round settles the most typical cell of each group at least
        best = rest.groupBy("grp").agg(F.max_by(F.struct("cell_id", "level", "vals"), F.struct("affinity", "cell_id")).alias("m"))
        j = rest.alias("a").join(best.select("grp", "m.*").alias("b"), "grp")
        alike = (F.col("a.cell_id") == F.col("b.cell_id")) | F.coalesce(_alike("a", "b", tolerance), F.lit(False))
        j = durable(j.select("a.cell_id", "grp", "a.affinity", "a.level", "a.vals", alike.alias("ok")))
        done.append(j.where("ok").drop("ok").withColumn("grp", F.concat(F.col("grp"), F.lit(f".{k + 1}"))))
        rest, k = j.where("not ok").drop("ok"), k + 1
    return reduce(DataFrame.unionByName, done, rest)


def group_summary(groups: DataFrame, members: int = 3) -> DataFrame:
    """Each group with its size, mean level and ``members`` most typical cells (highest internal affinity, ties by cell_id).

    Only the best few ranks of a group are kept, by a window that Spark limits before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("affinity").desc(), "cell_id"))
    top = groups.select("grp", "cell_id", "affinity", rank.alias("k")).where(F.col("k") <= members)
    typical = top.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cell_id"))), lambda t: t.cell_id).alias("typical_cells"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("level").alias("mean_level"))
    return sizes.join(typical, "grp").select(F.col("grp").alias("group_id"), "n_cells", "mean_level", "typical_cells")
