"""BAM files as a Python data source: ranges of compressed blocks as tasks, regions by the file's index.

    read_bam(spark, "/shared/x.bam")
    read_bam(spark, "/shared/x.bam", chrom="chr1", start=10_000, end=20_000)   # positions from 0, end exclusive

The file must lie where all executors can open it: in a shared folder, behind
http(s) with ranges, or on a file system that pyarrow knows.
"""

from __future__ import annotations

import glob
import gzip
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from methloom.core import ship
from methloom.sources.remote import exists, file_size, open_binary

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, tags string"
_ARROW = pa.schema(
    [
        ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()),
        ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.string()),
    ]
)
#: Compressed bytes of a task, and records of a batch.
TASK_BYTES, BATCH = 64 << 20, 10_000

# Fixed values of the file layout: magic numbers, base and operation letters, sizes of tag values.
MAGIC, BLOCK_MAGIC, INDEX_MAGIC = b"BAM\1", b"\x1f\x8b\x08\x04", b"BAI\1"
LETTERS, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_VALUES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_PAIRS = [a + b for a in LETTERS for b in LETTERS]
_QUALITY = bytes(min(q + 33, 126) for q in range(256))


class Blocks:
    """The decompressed stream of a file from the block at ``offset`` on, with the offset of the block that holds each place."""

    def __init__(self, f, offset: int):
        self.f, self.next = f, offset
        self.data, self.at = b"", 0
        #: (place in ``data``, offset of the block) of the blocks held, and what of a block has been dropped already.
        self.marks: list[tuple[int, int]] = []
        self.skipped: dict[int, int] = {}

    def more(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(18)
        if len(head) < 18:
            return False
        size = block_size(head)
        if size is None:
            raise ValueError(f"no compressed block at {self.next}")
        extra = struct.unpack_from("<H", head, 10)[0]
        body = head[12 + extra :] + self.f.read(size - 18)
        data = zlib.decompress(body[: size - 12 - extra - 8], -15)
        keep = self.data[self.at :]
        held = [(p, o) for i, (p, o) in enumerate(self.marks) if keep and (i + 1 == len(self.marks) or self.marks[i + 1][0] > self.at)]
        self.skipped = {o: self.skipped.get(o, 0) + max(self.at - p, 0) for p, o in held}
        self.marks = [(max(p - self.at, 0), o) for p, o in held] + [(len(keep), self.next)]
        self.data, self.at = keep + data, 0
        self.next += size
        return True

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise EOFError("the BAM ends within a record")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def place(self) -> int:
        """The current place as a virtual offset: that of its block, and the place within (at a block's end: the next one's begin)."""
        if self.at >= len(self.data):
            return self.next << 16
        p, offset = [m for m in self.marks if m[0] <= self.at][-1]
        return offset << 16 | self.at - p + self.skipped.get(offset, 0)


def block_size(head: bytes) -> int | None:
    """Bytes of the compressed block that begins with ``head`` (18 bytes), None if it is none."""
    if head[:4] != BLOCK_MAGIC or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def first_block(f, offset: int, size: int) -> int | None:
    """The first block at or after ``offset``; one must be followed by another or by the end of the file."""
    while offset < size:
        f.seek(offset)
        window = f.read(1 << 17)
        at = window.find(BLOCK_MAGIC)
        while at >= 0:
            n = block_size(window[at : at + 18]) if at + 18 <= len(window) else None
            if n is not None:
                end = offset + at + n
                f.seek(end)
                if end == size or block_size(f.read(18)) is not None:
                    return offset + at
            at = window.find(BLOCK_MAGIC, at + 1)
        if len(window) < 1 << 17:
            return None
        offset += len(window) - 18
    return None


def likely_record(data: bytes, at: int, lengths: list[int]) -> int | None:
    """The end of the record that seems to begin at ``at``; None if none can begin there; beyond the data if it may."""
    if at + 36 > len(data):
        return len(data) + 1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, nref, npos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not 32 <= size < 1 << 28 or not -1 <= ref < len(lengths) or not -1 <= nref < len(lengths) or pos < -1 or npos < -1 or l_name < 1 or l_seq < 0:
        return None
    if ref >= 0 and pos > lengths[ref] or nref >= 0 and npos > lengths[nref] or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    if any(c & 15 > 8 for c in ops[0::4]):
        return None
    return at + 4 + size


def first_record(b: Blocks, lengths: list[int]) -> bool:
    """Move to the first place from which record follows record through the next blocks."""
    for _ in range(3):
        if not b.more():
            break
    for start in range(len(b.data)):
        at, n = start, 0
        while at is not None and at < len(b.data) and n < 200:
            at, n = likely_record(b.data, at, lengths), n + 1
        if at is not None:
            b.at = start
            return True
    return False


def _tags(rec: bytes, at: int) -> str:
    out = []
    while at + 3 <= len(rec):
        name, kind = rec[at : at + 2].decode("ascii", "replace"), chr(rec[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(rec[at])}")
            at += 1
        elif kind in TAG_VALUES:
            code = "<" + TAG_VALUES[kind]
            value = struct.unpack_from(code, rec, at)[0]
            out.append(f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}")
            at += struct.calcsize(code)
        elif kind in "ZH":
            end = rec.index(b"\0", at)
            out.append(f"{name}:{kind}:{rec[at:end].decode('utf-8', 'replace')}")
            at = end + 1
        elif kind == "B" and chr(rec[at]) in TAG_VALUES:
            sub, n = chr(rec[at]), struct.unpack_from("<I", rec, at + 1)[0]
            code = f"<{n}{TAG_VALUES[sub]}"
            out.append(f"{name}:B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in struct.unpack_from(code, rec, at + 5)))
            at += 5 + struct.calcsize(code)
        else:
            break
    return "\t".join(out)


def decode(rec: bytes, names: list[str]) -> tuple:
    """The SAM columns of a record; optional fields as one tab-separated text."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, nref, npos, tlen = struct.unpack_from("<iiBBHHHiiii", rec)
    at = 32 + l_name
    qname = rec[32 : at - 1].decode("ascii", "replace")
    ops = struct.unpack_from(f"<{n_cigar}I", rec, at)
    at += 4 * n_cigar
    seq = "".join(map(_PAIRS.__getitem__, rec[at : at + (l_seq + 1) // 2]))[:l_seq]
    at += (l_seq + 1) // 2
    qual = rec[at : at + l_seq]
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
    name = lambda i: names[i] if i >= 0 else "*"
    return (
        qname, flag, name(ref), pos + 1, mapq, cigar, "=" if nref == ref >= 0 else name(nref), npos + 1, tlen, seq or "*",
        "*" if not qual or qual[0] == 255 else qual.translate(_QUALITY).decode(), _tags(rec, at + l_seq),
    )


def _span(rec: bytes) -> tuple[int, int, int]:
    """(reference, first base, base after the last) of a record."""
    ref, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", rec)
    ops = struct.unpack_from(f"<{n_cigar}I", rec, 32 + l_name)
    return ref, pos, pos + (sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X") or 1)


def header(take) -> tuple[list[str], list[int]]:
    """Names and lengths of the references, read by ``take``."""
    if take(4) != MAGIC:
        raise ValueError("not a BAM")
    take(struct.unpack("<i", take(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        lengths.append(struct.unpack("<i", take(4))[0])
    return names, lengths


def bins_of(start: int, end: int) -> set[int]:
    """The index bins that may hold records of [start, end): one of each of the six levels of the scheme, per stretch."""
    out = {0}
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out |= set(range(first + (start >> shift), first + ((end - 1) >> shift) + 1))
    return out


def index_chunks(path: str, ref: int, start: int, end: int) -> list[tuple[int, int]] | None:
    """The stretches (virtual offsets) that may hold records of a region by the file's .bai index; None without one."""
    found = next((p for p in (path + ".bai", os.path.splitext(path)[0] + ".bai") if exists(p)), None)
    if found is None:
        return None
    with open_binary(found) as f:
        data = f.read()
    if data[:4] != INDEX_MAGIC:
        raise ValueError(f"{found}: not an index")
    wanted, at, chunks, least = bins_of(start, end), 8, [], 0
    for r in range(struct.unpack_from("<i", data, 4)[0]):
        n_bin = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bin):
            number, n = struct.unpack_from("<Ii", data, at)
            if r == ref and number in wanted:
                v = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                chunks += list(zip(v[0::2], v[1::2]))
            at += 8 + 16 * n
        n_linear = struct.unpack_from("<i", data, at)[0]
        if r == ref:
            linear = struct.unpack_from(f"<{n_linear}Q", data, at + 4)
            least = linear[min(start >> 14, n_linear - 1)] if n_linear else 0
        at += 4 + 8 * n_linear
    merged: list[tuple[int, int]] = []
    for a, b in sorted((max(a, least), b) for a, b in chunks if b > least):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Range(InputPartition):
    """Records of a file that begin between two virtual offsets; the first is a record's begin only if ``exact``. ``begin`` None: a file without block sizes, read whole."""

    def __init__(self, path: str, begin: int | None, end: int, exact: bool, names: list[str], lengths: list[int], ref: int | None):
        self.path, self.begin, self.end, self.exact, self.names, self.lengths, self.ref = path, begin, end, exact, names, lengths, ref


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [q for p in options["path"].split(",") for q in (sorted(glob.glob(p)) if glob.has_magic(p) else [p])]
        self.chrom = options.get("chrom")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 29))
        self.task_bytes = int(options.get("bytespertask", TASK_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            size = file_size(path)
            with open_binary(path) as f:
                if block_size(f.read(18)) is None:
                    f.seek(0)
                    names, lengths = header(gzip.GzipFile(fileobj=f).read)
                    out.append(Range(path, None, size, False, names, lengths, self._ref(names)))
                    continue
                b = Blocks(f, 0)
                names, lengths = header(b.take)
                ref = self._ref(names)
                first = b.place()
            chunks = None if self.chrom is None or ref < 0 else index_chunks(path, ref, self.start, self.end)
            if chunks is None:
                cuts = [first, *(c << 16 for c in range(self.task_bytes, size, self.task_bytes) if c << 16 > first), size << 16]
                chunks = list(zip(cuts, cuts[1:]))
                out += [Range(path, a, z, a == first, names, lengths, ref) for a, z in chunks]
            else:
                out += [Range(path, a, z, True, names, lengths, ref) for a, z in chunks]
        return out or [Range("", 0, 0, False, [], [], None)]

    def _ref(self, names: list[str]) -> int | None:
        """The number of the wanted reference; -1 if the file has none of that name."""
        return None if self.chrom is None else names.index(self.chrom) if self.chrom in names else -1

    def records(self, part: Range) -> Iterator[bytes]:
        if not part.path or part.ref == -1:
            return
        with open_binary(part.path) as f:
            if part.begin is None:
                raw = gzip.GzipFile(fileobj=f)
                header(raw.read)
                while len(head := raw.read(4)) == 4:
                    rec = raw.read(struct.unpack("<i", head)[0])
                    if len(rec) < struct.unpack("<i", head)[0]:
                        raise EOFError("the BAM ends within a record")
                    yield rec
                return
            if part.exact:  # begins at a known record
                b = Blocks(f, part.begin >> 16)
                if b.more():
                    b.at = part.begin & 0xFFFF
            else:
                begin = first_block(f, part.begin >> 16, file_size(part.path))
                if begin is None or begin << 16 >= part.end:
                    return
                b = Blocks(f, begin)
                if not first_record(b, part.lengths):
                    return
            while b.need(4) and b.place() < part.end:
                yield b.take(struct.unpack("<i", b.take(4))[0])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for rec in self.records(partition):
            if partition.ref is not None:
                ref, a, z = _span(rec)
                if ref != partition.ref or a >= self.end or z <= self.start:
                    continue
            rows.append(decode(rec, partition.names))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Bam(DataSource):
    """Data source ``bam``; a comma list of paths or patterns is read as one table."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """Alignments of BAM files, a task per range of blocks; ``chrom``, ``start`` and ``end`` (from 0, end exclusive) keep the records that overlap.

    With an index beside the file only the stretches of the region are read. A
    file of plain gzip members has no block sizes and is read by one task.
    """
    ship(spark)
    spark.dataSource.register(Bam)
    r = spark.read.format("bam")
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def bam_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """References of a BAM file: tid, chrom, length."""
    part = Reader({"path": path}).partitions()[0]
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(part.names, part.lengths))], "tid int, chrom string, length long")
