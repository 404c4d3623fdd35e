"""Result files: region tables by context, profile matrices, cell matrices, differential reports."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.core import dense_index, durable, partitions_for, ship, small_side
from methloom.sources.binary import BIGWIG, CHROM_TREE, INDEX
from methloom.schema import CONTEXTS, decode_context, fixed


def write_lines(lines: DataFrame, path: str) -> None:
    """A text table of column ``value``, as many files as tasks."""
    lines.write.mode("overwrite").text(path)


def tsv(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns as tab-separated lines; null is NA."""
    return df.select(F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("NA")) for c in columns)).alias("value"))


def write_by_context(stats: DataFrame, path: str, one_table: bool = False) -> None:
    """Region, body or bin statistics: one folder per context (c, cg, chg, chh), or one table with the context as a column."""
    named = stats.withColumn("context", F.lower(decode_context(F.col("context"))))
    w = named.write.mode("overwrite")
    (w if one_table else w.partitionBy("context")).parquet(path)


def matrix_market(cells: DataFrame, cell: str, feature: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix lines, features, barcodes) of a long cell matrix: rows are features, columns cells, both numbered from 1 in sorted order.

    The two head lines are the first partition; the entries follow in ranges of
    (column, row), so no task holds more than its share.
    """
    cells = durable(cells.select(F.col(cell).alias("_c"), F.col(feature).alias("_f"), F.col(value).alias("_v")))
    f = dense_index(cells.select("_f").distinct(), ["_f"], "_g").select("_f", (F.col("_g") + 1).alias("row"))
    c = dense_index(cells.select("_c").distinct(), ["_c"], "_g").select("_c", (F.col("_g") + 1).alias("col"))
    entries = cells.join(f, "_f").join(c, "_c").orderBy("col", "row")
    body = entries.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), fixed(F.col("_v"), 6)).alias("value"))
    head = ["%%MatrixMarket matrix coordinate real general", f"{f.count()} {c.count()} {cells.count()}"]
    lines = cells.sparkSession.createDataFrame([(t,) for t in head], "value string").coalesce(1).unionByName(body)
    return lines, f.orderBy("row").select(F.col("_f").alias("value")), c.orderBy("col").select(F.col("_c").alias("value"))


def dense_matrix(cells: DataFrame, cell: str, feature: str, value: str, features: list[str]) -> DataFrame:
    """One row per cell, one column per feature; missing pairs are 0. ``features`` is the panel, which bounds the width."""
    return cells.groupBy(cell).pivot(feature, features).agg(F.max(value)).fillna(0.0)


def group_lines(groups: DataFrame, regions: DataFrame) -> DataFrame:
    """The groups table with a head line: group, chrom, start, end of the region, cells, sites, total and mean coverage, level.

    ``regions`` has region_id (unique), chrom, rs, re.
    """
    r = small_side(regions.select(F.col("region_id").alias("_id"), "chrom", "rs", "re"))
    rows = groups.join(r, F.col("region_id") == F.col("_id")).orderBy("grp", "chrom", "rs")
    head = groups.sparkSession.createDataFrame([("group\tchrom\tstart\tend\tn_cells\tn_sites\ttotal_coverage\tmean_coverage\tmean_meth",)], "value string").coalesce(1)
    return head.unionByName(tsv(rows, *(F.col(c) for c in ("grp", "chrom", "rs", "re", "n_cells", "n_sites", "total_coverage")), fixed(F.col("mean_coverage"), 6), fixed(F.col("mean_meth"), 6)))


def group_names(groups: DataFrame) -> DataFrame:
    """The names of the groups, one a line, sorted."""
    return groups.select(F.col("grp").alias("value")).where("value is not null").distinct().orderBy("value")


def write_prefix_files(lines: dict[str, DataFrame], prefix: str) -> None:
    """Text tables <prefix>.<name>, one folder each, of lines by name: 'c', 'cg', 'across.chh', 'groups.tsv' and the like."""
    for name, df in lines.items():
        write_lines(df, f"{prefix}.{name}")


def region_level_lines(stats: DataFrame, regions: DataFrame, context: int) -> DataFrame:
    """chrom, start, end, level and region of one context, as region and body statistics are written."""
    r = small_side(regions.select(F.col("region_id").alias("_id"), "chrom", "rs", "re"))
    rows = stats.where(F.col("context") == context).join(r, F.col("region_id") == F.col("_id"))
    part = [F.col("part")] if "part" in stats.columns else []
    return tsv(rows, F.col("chrom"), F.col("rs"), F.col("re"), F.when(F.col("level").isNull(), "NA").otherwise(fixed(F.col("level"), 6)), F.col("region_id"), *part)


def by_context(make, contexts: tuple[int, ...] = tuple(range(len(CONTEXTS))), prefix: str = "") -> dict[str, DataFrame]:
    """``make(code)`` for each context, under the names that ``write_prefix_files`` takes (c, cg, chg, chh)."""
    return {prefix + CONTEXTS[c].lower(): make(c) for c in contexts}


def profile_average_lines(average: DataFrame, bins: int) -> DataFrame:
    """A line per context, 'C' first: its name and the average level of each bin with 6 decimals, 'nan' where there is none."""
    w = average.groupBy("context").agg(*(F.max(F.when(F.col("bin") == i, F.col("level"))).alias(f"b{i}") for i in range(bins)))
    cols = (F.when(F.col(f"b{i}").isNull(), "nan").otherwise(fixed(F.col(f"b{i}"), 6)) for i in range(bins))
    return w.orderBy("context").select(F.concat_ws("\t", decode_context(F.col("context")), *cols).alias("value"))


def profile_matrix_lines(levels: DataFrame, bins: int, context: int) -> DataFrame:
    """Region and its bin levels with 4 decimals, 'nan' where there is none."""
    from methloom.operators.profile import wide_matrix

    w = wide_matrix(levels.where(F.col("context") == context), "bin", bins)
    return w.select(F.concat_ws("\t", "region_id", *(F.when(F.col(f"b{i}").isNull(), "nan").otherwise(fixed(F.col(f"b{i}"), 4)) for i in range(bins))).alias("value"))


def differential_lines(loci: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("chrom", "start", "strand", "context", "p_value", "adj_p", "m1", "c1", "m2", "c2", "diff") if c in loci.columns]
    return tsv(loci, *cols)


def ratio_lines(report: DataFrame) -> DataFrame:
    """The ratio report with its head line: 12 columns, levels with 6 decimals, the effective coverage with one or 'null'."""
    names = "chromsome loci strand context C_count CT_count methRatio eff_CT_count rev_G_count rev_GA_count MethContext 5context".split()
    head = report.sparkSession.createDataFrame([("#" + "\t".join(names),)], "value string").coalesce(1)
    eff = F.coalesce(fixed(F.col("eff_ct"), 1), F.lit("null"))
    return head.unionByName(tsv(report, *(F.col(c) for c in ("chrom", "start", "strand", "context", "meth", "coverage")), fixed(F.col("value"), 6), eff, *(F.col(c) for c in ("rev_g", "rev_ga", "category", "fivemer"))))


def region_lines(regions: DataFrame) -> DataFrame:
    """Differential regions: chrom, start, end, both levels, loci, and hyper,hypo."""
    pair = F.concat_ws(",", F.col("hyper").cast("string"), F.col("hypo").cast("string"))
    return tsv(regions, F.col("chrom"), F.col("start"), F.col("end"), fixed(F.col("level_1"), 6), fixed(F.col("level_2"), 6), F.col("n_sites"), pair)


#: The context codes with a file of their own.
SPLIT = tuple(range(len(CONTEXTS)))


def coverage_lines(counts: DataFrame, context: int) -> DataFrame:
    """Region, methylated count and coverage of one context."""
    return tsv(counts.where(F.col("context") == context), F.col("region_id"), F.col("meth_count"), F.col("coverage"))


#: Fixed values of the bigWig layout: block kinds and the numbers of entries of a node.
_WIG_BLOCK, _NODE, _VERSION = 1, 256, 4
#: Records of a block, and the windows of the two zoom levels, in bases.
WIG_RECORDS, ZOOMS = 1024, (64, 1024)


def _wig_blocks(rows: DataFrame, spec: str) -> DataFrame:
    """Compressed blocks (tid, first, last, n, data) of rows sorted within partitions by tid and start; ``spec`` packs a row's other columns."""

    def run(batches):
        held: list = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 16 * WIG_RECORDS:
                yield from _cut(pa.Table.from_batches(held))
                held = []
        if held:
            yield from _cut(pa.Table.from_batches(held))

    def _cut(t):
        tid, start, end = (t.column(c).to_numpy() for c in ("tid", "start", "end"))
        edge = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1], [True]]))
        out = []
        for i, j in zip(edge[:-1], edge[1:]):
            for a in range(i, j, WIG_RECORDS):
                z = min(a + WIG_RECORDS, j)
                if spec == "wig":
                    rec = np.zeros(z - a, np.dtype([("s", "<u4"), ("e", "<u4"), ("v", "<f4")]))
                    rec["s"], rec["e"], rec["v"] = start[a:z], end[a:z], t.column("value").to_numpy()[a:z]
                    raw = struct.pack("<IIIIIBBH", int(tid[a]), int(start[a]), int(end[z - 1]), 0, 0, _WIG_BLOCK, 0, z - a) + rec.tobytes()
                else:
                    rec = np.zeros(z - a, np.dtype([("t", "<u4"), ("s", "<u4"), ("e", "<u4"), ("n", "<u4"), ("lo", "<f4"), ("hi", "<f4"), ("sum", "<f4"), ("sq", "<f4")]))
                    for f, c in zip(rec.dtype.names, ("tid", "start", "end", "n", "min_value", "max_value", "sum_value", "sum_squares")):
                        rec[f] = t.column(c).to_numpy()[a:z]
                    raw = rec.tobytes()
                out.append((int(tid[a]), int(start[a]), int(end[a:z].max()), z - a, len(raw), zlib.compress(raw)))
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tid", "first", "last", "n", "size", "data"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "tid int, first long, last long, n int, size int, data binary")


def _wig_index(spots: list[tuple[int, int, int, int, int]], at: int, end: int) -> bytes:
    """An R-tree of blocks (tid, first, last, offset, size), written at ``at``."""
    levels = [[(t, a, t, z, o, s) for t, a, z, o, s in spots]]
    while len(levels[-1]) > _NODE:
        up = []
        for i in range(0, len(levels[-1]), _NODE):
            part = levels[-1][i : i + _NODE]
            up.append((*min((p[0], p[1]) for p in part), *max((p[2], p[3]) for p in part), 0, 0))
        levels.append(up)
    first, last = (min((p[0], p[1]) for p in levels[0]), max((p[2], p[3]) for p in levels[0])) if spots else ((0, 0), (0, 0))
    out = struct.pack("<IIQIIIIQII", INDEX, _NODE, len(spots), *first, *last, end, 1, 0)
    place, begin = at + len(out), []
    sizes = [[4 + (32 if k == 0 else 24) * len(level[i : i + _NODE]) for i in range(0, max(len(level), 1), _NODE)] for k, level in enumerate(levels)]
    for k in range(len(levels) - 1, -1, -1):
        begin.insert(0, [place + sum(sizes[k][:i]) for i in range(len(sizes[k]))])
        place += sum(sizes[k])
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        for i in range(0, max(len(level), 1), _NODE):
            part = level[i : i + _NODE]
            out += struct.pack("<BBH", k == 0, 0, len(part))
            for x, p in enumerate(part):
                out += struct.pack("<IIIIQQ", *p) if k == 0 else struct.pack("<IIIIQ", *p[:4], begin[k - 1][i + x])
    return out


def write_bigwig(sites: DataFrame, lengths: DataFrame, path: str, merge_strands: bool = False) -> None:
    """The sites' levels as one bigWig file with two zoom levels; with ``merge_strands`` levels of the - strand are negative.

    Executors sort the sites by ranges and compress the blocks; the driver writes
    them to the file in order as they come, a partition at a time, so it holds a
    partition of compressed blocks and the index, one entry per 1024 sites.
    Sites without level or of no chromosome of ``lengths`` (chrom, length) are left
    out. ``path`` is a file the driver can write; sites should not overlap.
    """
    from methloom.operators.sites import rezoom, zoom

    names = sorted((r.chrom, r.length) for r in lengths.select("chrom", F.col("length").cast("long").alias("length")).collect())
    spark = sites.sparkSession
    tids = F.broadcast(spark.createDataFrame([(c, i) for i, (c, _) in enumerate(names)], "_c string, tid int"))
    value = F.when(F.col("strand") == 1, -F.col("value")).otherwise(F.col("value")) if merge_strands and "strand" in sites.columns else F.col("value")
    end = F.col("end") if "end" in sites.columns else F.col("start") + 1
    named = sites.select("chrom", "start", end.alias("end"), value.cast("float").alias("value")).where("value is not null").join(tids, F.col("chrom") == F.col("_c")).drop("_c")
    rows = durable(named.repartitionByRange(partitions_for(named), "tid", "start").sortWithinPartitions("tid", "start").select("tid", "start", "end", "value", "chrom"))
    whole = rows.agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(F.col("value").cast("double")).alias("s"), F.sum(F.col("value").cast("double") * F.col("value")).alias("q")).first()
    key = max((len(c.encode()) for c, _ in names), default=1)
    tree = struct.pack("<IIIIQII", CHROM_TREE, max(1, len(names)), key, 8, len(names), 0, 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", i, n) for i, (c, n) in enumerate(names))
    head = 64 + 24 * len(ZOOMS)
    summary_at = head
    tree_at = head + 40
    zoomed = zoom(rows, ZOOMS[0])
    with open(path.removeprefix("file://").removeprefix("file:"), "wb") as f:
        f.write(b"\0" * tree_at + tree)
        data_at, largest = f.tell(), 0

        def put(blocks: DataFrame) -> tuple[int, int]:
            """Write the blocks and their index; gives where they begin and where the index does."""
            nonlocal largest
            at, spots = f.tell(), []
            f.write(b"\0" * (8 if at == data_at else 4))  # how many: blocks of data, records of a zoom level
            n = 0
            for b in blocks.toLocalIterator():
                spots.append((b.tid, b["first"], b["last"], f.tell(), len(b.data)))
                largest, n = max(largest, b["size"]), n + (b.n if at != data_at else 1)
                f.write(b.data)
            end = f.tell()
            f.seek(at)
            f.write(struct.pack("<Q" if at == data_at else "<I", n))
            f.seek(end)
            f.write(_wig_index(spots, end, end))
            return at, end

        ordered = rows.orderBy("tid", "start")
        _, index_at = put(_wig_blocks(ordered.select("tid", "start", "end", "value"), "wig"))
        levels = []
        for z in ZOOMS:
            t = zoomed if z == ZOOMS[0] else rezoom(zoomed, z)
            t = t.join(tids, F.col("chrom") == F.col("_c")).select("tid", F.col("win_start").alias("start"), (F.col("win_start") + z).alias("end"), "n", "min_value", "max_value", "sum_value", "sum_squares")
            levels.append((z, *put(_wig_blocks(t.orderBy("tid", "start"), "zoom"))))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", BIGWIG, _VERSION, len(ZOOMS), tree_at, data_at, index_at, 0, 0, 0, summary_at, max(largest, 1), 0))
        for z, at, index in levels:
            f.write(struct.pack("<IIQQ", z, 0, at, index))
        f.write(struct.pack("<Qdddd", whole.n or 0, whole.lo or 0.0, whole.hi or 0.0, whole.s or 0.0, whole.q or 0.0))
