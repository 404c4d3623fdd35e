"""Binary site tables (and bigWig, bigBed) as a Python data source.

    read_binary(spark, "/shared/x.sites", chrom="chr1", start=0, end=10_000)
    read_binary(spark, "/shared/x.sites").where("chrom = 'chr1' and start < 10000")

Both read the blocks of that range only. Used directly, the data source needs
spark.sql.python.filterPushdown.enabled. The file must lie where all executors can open it
(a shared folder, http(s) with ranges, or what pyarrow's file systems know). Blocks are pruned by the
file's own index; a task reads a run of blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from methloom.sources.remote import open_binary

# Fixed values of the file layout: magic numbers and the bits that name the columns of a record.
BIGWIG, BIGBED, CHROM_TREE, INDEX = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
COVERAGE, STRAND, CONTEXT, ID, END, SITES = 0x7, 0x38, 0x1C0, 0xE00, 0x7000, 0x8000

SCHEMA = "chrom string, start long, end long, value float, coverage int, strand byte, context byte, id string"
_TYPES = pa.schema(
    [("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float32()), ("coverage", pa.int32()), ("strand", pa.int8()), ("context", pa.int8()), ("id", pa.string())]
)


class Layout:
    """Header, chromosomes and block index of one file."""

    def __init__(self, path: str):
        self.path = path
        with open_binary(path) as f:
            self.f = f
            head = f.read(64)
            if len(head) < 64:
                raise ValueError(f"{path}: too short for a header")
            self.magic, self.version, self.levels, tree, _, index, _, _, text, self.summary_at, self.buffer, _ = struct.unpack("<IHHQQQHHQQIQ", head)
            if self.magic not in (BIGWIG, BIGBED) and not self.magic & SITES:
                raise ValueError(f"{path}: not a binary site table")
            #: The definition of the columns that a bigBed may carry, '' without one.
            self.definition = ""
            if text:
                f.seek(text)
                while b"\0" not in (part := f.read(4096)) and part:
                    self.definition += part.decode("utf-8", "replace")
                self.definition += part.split(b"\0")[0].decode("utf-8", "replace")
            self.chroms: dict[int, tuple[str, int]] = {}
            f.seek(tree)
            magic, _, key, _, _, _, _ = struct.unpack("<IIIIQII", f.read(32))
            if magic != CHROM_TREE:
                raise ValueError(f"{path}: no chromosome list")
            self._chrom_node(f.tell(), key)
            f.seek(index)
            if struct.unpack("<I", f.read(4))[0] != INDEX:
                raise ValueError(f"{path}: no block index")
            #: (first tid, first base, last tid, last base, offset, size) of each data block.
            self.blocks: list[tuple[int, int, int, int, int, int]] = []
            f.seek(index + 48)
            self._index_node(f.tell())
            del self.f

    def _chrom_node(self, at: int, key: int) -> None:
        self.f.seek(at)
        leaf, _, n = struct.unpack("<BBH", self.f.read(4))
        for i in range(n):
            self.f.seek(at + 4 + i * (key + 8))
            name = self.f.read(key)
            a, b = struct.unpack("<II", self.f.read(8))
            if leaf:
                self.chroms[a] = (name.rstrip(b"\0").decode(), b)
            else:
                self._chrom_node(a | b << 32, key)

    def _index_node(self, at: int) -> None:
        self.f.seek(at)
        leaf, _, n = struct.unpack("<BBH", self.f.read(4))
        size = 32 if leaf else 24
        data = self.f.read(n * size)
        for i in range(n):
            if leaf:
                self.blocks.append(struct.unpack_from("<IIIIQQ", data, i * size))
            else:
                self._index_node(struct.unpack_from("<IIIIQ", data, i * size)[4])

    def overlapping(self, tid: int | None, start: int, end: int) -> list[tuple[int, int]]:
        if tid is None:  # any chromosome; a block that spans several may hold any position
            return [(o, s) for ta, a, tb, b, o, s in self.blocks if ta != tb or a < end and b > start]
        return [(o, s) for ta, a, tb, b, o, s in self.blocks if (ta, a) < (tid, end) and (tb, b) > (tid, start)]


def decode(block: bytes, kind: int, magic: int) -> tuple[int, dict[str, object]]:
    """(tid, columns) of a data block's records."""
    if magic == BIGBED:
        rows, at = [], 0
        while at < len(block):
            tid, s, e = struct.unpack_from("<III", block, at)
            stop = block.index(b"\0", at + 12)
            rows.append((tid, s, e, block[at + 12 : stop].decode()))
            at = stop + 1
        return rows[0][0] if rows else 0, {"tid": [r[0] for r in rows], "start": [r[1] for r in rows], "end": [r[2] for r in rows], "id": [r[3] for r in rows]}
    tid, first, _, step, span, form, _, n = struct.unpack_from("<IIIIIBBH", block)
    body = memoryview(block)[24:]
    if magic == BIGWIG or form != 1:
        if form == 1 and magic == BIGWIG:
            a = np.frombuffer(body, np.dtype([("s", "<u4"), ("e", "<u4"), ("v", "<f4")]), n)
            return tid, {"start": a["s"], "end": a["e"], "value": a["v"]}
        if form == 2:
            a = np.frombuffer(body, np.dtype([("s", "<u4"), ("v", "<f4")]), n)
            return tid, {"start": a["s"], "end": a["s"].astype(np.int64) + span, "value": a["v"]}
        s = first + step * np.arange(n, dtype=np.int64)
        return tid, {"start": s, "end": s + span, "value": np.frombuffer(body, "<f4", n)}
    fields = [("start", "<u4")] + [("end", "<u4")] * bool(kind & END) + [("value", "<f4")] + [("coverage", "<u2")] * bool(kind & COVERAGE)
    fields += [("strand", "u1")] * bool(kind & STRAND) + [("context", "u1")] * bool(kind & CONTEXT)
    dtype = np.dtype(fields)
    if kind & ID:
        parts, ids, at = [], [], 24
        for _ in range(n):
            parts.append(block[at : at + dtype.itemsize])
            stop = block.index(b"\0", at + dtype.itemsize)
            ids.append(block[at + dtype.itemsize : stop].decode())
            at = stop + 1
        a = np.frombuffer(b"".join(parts), dtype, n)
        return tid, {name: a[name] for name, _ in fields} | {"id": ids}
    a = np.frombuffer(body, dtype, n)
    return tid, {name: a[name] for name, _ in fields}


class Blocks(InputPartition):
    """A run of blocks of one file, with what a task needs of its header."""

    def __init__(self, path: str, blocks: list[tuple[int, int]], layout: Layout | None = None):
        self.path, self.blocks = path, blocks
        if layout is not None:
            self.names = {t: n for t, (n, _) in layout.chroms.items()}
            self.version, self.magic, self.buffer = layout.version, layout.magic, layout.buffer


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chrom = options.get("chrom")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 32))
        self.per_task = int(options.get("blockspertask", 2000))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on chrom, start and end narrow the blocks read; Spark still checks them on the rows."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if isinstance(f, EqualTo) and column == "chrom" and self.chrom is None:
                self.chrom = value
            elif column == "start" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, value + isinstance(f, LessThanOrEqual))
            elif column == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, value - isinstance(f, GreaterThanOrEqual))
            elif column == "start" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, value - 1)  # a site of at least one base ends beyond its start
                if isinstance(f, EqualTo):
                    self.end = min(self.end, value + 1)
            yield f

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.path.split(","):
            layout = Layout(path)
            tids = [None] if self.chrom is None else [t for t, (name, _) in layout.chroms.items() if name == self.chrom]
            found = [b for t in tids for b in layout.overlapping(t, self.start, self.end)]
            out += [Blocks(path, found[i : i + self.per_task], layout) for i in range(0, len(found), self.per_task)]
        return out or [Blocks(self.path.split(",")[0], [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        names, version, magic, buffer = partition.names, partition.version, partition.magic, partition.buffer
        with open_binary(partition.path) as f:
            for offset, size in partition.blocks:
                f.seek(offset)
                data = f.read(size)
                tid, cols = decode(zlib.decompress(data) if buffer else data, version, magic)
                n = len(cols["start"])
                if "end" not in cols:
                    cols["end"] = np.asarray(cols["start"], np.int64) + 1
                tids = np.asarray(cols.pop("tid", np.full(n, tid)), np.int64)
                keep = (np.asarray(cols["start"], np.int64) < self.end) & (np.asarray(cols["end"], np.int64) > self.start)
                if self.chrom is not None:
                    keep &= np.isin(tids, [t for t, name in names.items() if name == self.chrom])
                codes, at = np.unique(tids, return_inverse=True)
                cols["chrom"] = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([names[t] for t in codes.tolist()], pa.string())).cast(pa.string())
                batch = pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) if x.name in cols else pa.nulls(n, x.type) for x in _TYPES], schema=_TYPES)
                yield batch if keep.all() else batch.filter(pa.array(keep))


class BinarySites(DataSource):
    """Data source ``binary_sites``; a comma list of paths is read as one table. Columns a file lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "binary_sites"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def read_binary(spark, path: str, **options):
    """A binary site table, bigWig or bigBed as a DataFrame; ``chrom``, ``start`` and ``end`` prune blocks."""
    from methloom.core import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinarySites)
    r = spark.read.format("binary_sites")
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def column_definition(path: str) -> str:
    """The text that defines the columns of a bigBed's entries, '' if the file has none."""
    return Layout(path).definition


def entry_columns(entries, names: list[str]):
    """The tab-separated further fields of bigBed entries (``id``) as columns of the given names; fields that a row lacks are null."""
    from pyspark.sql import functions as F

    f = F.split("id", "\t")
    return entries.select("chrom", "start", "end", *(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))


def chrom_table(spark, path: str):
    """Chromosomes of a file: tid, chrom, length."""
    return spark.createDataFrame([(t, n, ln) for t, (n, ln) in sorted(Layout(path).chroms.items())], "tid int, chrom string, length long")


def per_base(sites, start: int, end: int, fill: bool = False):
    """One row per covered base of [start, end); with ``fill`` also the others, with a null value."""
    from pyspark.sql import functions as F

    rows = sites.where((F.col("start") < end) & (F.col("end") > start)).select(
        "chrom", F.explode(F.sequence(F.greatest("start", F.lit(start)), F.least("end", F.lit(end)) - 1)).alias("pos"), "value"
    )
    if not fill:
        return rows
    every = sites.select("chrom").distinct().withColumn("pos", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
    return every.join(rows, ["chrom", "pos"], "left")
