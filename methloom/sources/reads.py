"""Alignments (SAM text, BAM), references (FASTA) and raw reads (FASTQ)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import durable, ship, small_side
from methloom.sources.bam import read_bam  # noqa: F401

SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, tags string"
#: Reference bases per row of a chunked reference, and the flank each row also carries.
CHUNK, FLANK = 10_000, 2


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment lines of SAM text (column ``value``); header lines are skipped, optional fields are kept as one text."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    return lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(
        at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("rname"), at(3).try_cast("long").alias("pos"), at(4).try_cast("int").alias("mapq"),
        at(5).alias("cigar"), at(6).alias("rnext"), at(7).try_cast("long").alias("pnext"), at(8).try_cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        F.concat_ws("\t", F.slice(f, 12, 1000)).alias("tags"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def sam_dictionary(lines: DataFrame) -> DataFrame:
    """Chromosomes and lengths of the @SQ header lines."""
    sq = lines.where(F.col("value").startswith("@SQ"))
    return sq.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def parse_fasta(files: DataFrame) -> DataFrame:
    """Whole FASTA texts (``value``, one row per file) as (chrom, seq); the name ends at the first blank."""
    rec = files.select(F.explode(F.split(F.concat(F.lit("\n"), F.col("value")), "\n>")).alias("r")).where(F.length("r") > 1)
    head = F.substring_index("r", "\n", 1)
    body = F.expr("substring(r, instr(r, '\n') + 1)")
    return rec.where(F.instr("r", "\n") > 0).select(F.split(F.trim(head), r"\s+").getItem(0).alias("chrom"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq")).where("seq <> ''")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file and the stretch of it (``path``, ``block``) that they were read from; in a task, lines of a stretch come in order."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(path, block, lines) of runs of lines of one stretch."""
    for b in batches:
        path, block = b.column("path").dictionary_encode(), b.column("block").to_numpy()
        code = path.indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1]), [True]])) if len(b) else []
        for i, j in zip(edges[:-1], edges[1:]):
            yield path.dictionary[int(code[i])].as_py(), int(block[i]), b.column("value").slice(i, j - i).to_pylist()


#: Bases of a piece of a sequence.
PIECE = 1 << 16


def fasta_pieces(spark: SparkSession, path: str | list[str], piece: int = PIECE) -> DataFrame:
    """FASTA files of any size as (chrom, at, seq): pieces of the sequences in upper case with the 0-based place of their first base.

    A file is read by stretches. What a stretch begins with belongs to the last
    sequence before it: one row per stretch tells how that ended, which is all
    that is gathered. The name ends at the first blank; a sequence without bases
    gives no row. Compressed files are one stretch.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        name: str | None = None
        seg = at = held = 0
        parts: list[str] = []
        rows: list[tuple] = []

        def put() -> None:
            nonlocal at, held, parts
            rows.append((*key, seg, name, at, "".join(parts)))
            at, held, parts = at + held, 0, []

        for p, b, lines in _runs(batches):
            if (p, b) != key:
                if key is not None:
                    put()
                key, name, seg, at = (p, b), None, 0, 0
            for line in lines:
                if line.startswith(">"):
                    put()
                    words = line[1:].split(None, 1)
                    name, seg, at = words[0] if words else "", seg + 1, 0
                    continue
                text = "".join(line.split()).upper()
                while held + len(text) >= piece:
                    cut = piece - held
                    parts.append(text[:cut])
                    held, text = piece, text[cut:]
                    put()
                if text:
                    parts.append(text)
                    held += len(text)
            if len(rows) * piece > 1 << 24 or len(rows) > 10_000:
                yield _arrow(rows)
                rows.clear()
        if key is not None:
            put()
        yield _arrow(rows)

    def _arrow(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "block", "seg", "name", "at", "seq"])

    cut = durable(_lines(spark, path).mapInArrow(run, "path string, block long, seg long, name string, at long, seq string"))
    segs = cut.groupBy("path", "block", "seg").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("n"))
    ends = segs.groupBy("path", "block").agg(F.max_by(F.struct("seg", "name", "n"), "seg").alias("e")).select("path", "block", "e.*").collect()  # one row per stretch
    carry, file, name, at = [], None, "", 0
    for e in sorted(ends, key=lambda e: (e.path, e.block)):
        if e.path != file:
            file, name, at = e.path, None, 0
        carry.append((e.path, e.block, name, at))
        name, at = (name, at + e.n) if e.seg == 0 else (e.name, e.n)
    before = spark.createDataFrame(carry, "path string, block long, _name string, _at long")
    j = cut.join(F.broadcast(before), ["path", "block"])
    chrom, place = F.when(F.col("seg") == 0, F.col("_name")).otherwise(F.col("name")), F.col("at") + F.when(F.col("seg") == 0, F.col("_at")).otherwise(0)
    return j.select(chrom.alias("chrom"), place.alias("at"), "seq").where("chrom is not null and seq <> ''")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA as (chrom, seq), one row per sequence; for sequences that fit a row (2 GB), else use ``fasta_pieces``."""
    p = fasta_pieces(spark, path).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("x"))
    return p.select("chrom", F.array_join(F.transform("x", lambda e: e.seq), "").alias("seq"))


def chunked_reference(fasta: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk, first, seq): rows of ``chunk`` bases with FLANK more to either side, N beyond the ends. ``first`` is the 0-based position of the row's first base.

    ``fasta`` holds whole sequences (chrom, seq) or pieces of them (chrom, at, seq)
    as ``fasta_pieces`` gives them; the time is linear in the bases either way.
    """
    ship(fasta.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chrom, at, seq in zip(b.column("chrom").to_pylist(), b.column("at").to_pylist(), b.column("seq").to_pylist()):
                n = len(seq)
                # The chunks that hold a base of the piece, or have it in their flanks.
                first, last = max(0, at - FLANK) // chunk, (at + n - 1 + FLANK) // chunk
                for i in range(first, last + 1, 1000):
                    cs = range(i, min(i + 1000, last + 1))
                    begin = [max(at, c * chunk - FLANK) for c in cs]
                    cut = [seq[a - at : min(at + n, (c + 1) * chunk + FLANK) - at] for a, c in zip(begin, cs)]
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(cut), pa.string()), pa.array(list(cs), pa.int64()), pa.array(begin, pa.int64()), pa.array(cut, pa.string())], names=["chrom", "chunk", "at", "seq"])

    whole = "at" not in fasta.columns
    rows = fasta.select("chrom", (F.lit(0) if whole else F.col("at")).cast("long").alias("at"), "seq").where("seq <> ''")
    cut = rows.mapInArrow(run, "chrom string, chunk long, at long, seq string")
    if whole:
        sizes = fasta.select(F.col("chrom").alias("_c"), F.length("seq").cast("long").alias("_n"))
        put = cut.withColumn("x", F.array(F.struct("at", "seq")))
    else:
        sizes = fasta.groupBy(F.col("chrom").alias("_c")).agg(F.sum(F.length("seq")).alias("_n"))
        put = cut.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("x"))  # the pieces of one chunk
    j = put.join(small_side(sizes), F.col("chrom") == F.col("_c")).where(F.col("chunk") * chunk < F.col("_n"))
    first = F.col("chunk") * chunk - FLANK
    text = F.array_join(F.transform("x", lambda e: e.seq), "")
    size = F.least(F.lit(chunk + 2 * FLANK), F.col("_n") + FLANK - first).cast("int")
    padded = F.rpad(F.concat(F.when(F.col("chunk") == 0, F.lit("N" * FLANK)).otherwise(""), text), size, "N")
    return j.select("chrom", "chunk", first.alias("first"), padded.alias("seq"))


def base_counts(fasta: DataFrame) -> DataFrame:
    """C, G and C + G per chromosome and its length, without case; of whole sequences or pieces."""
    count = lambda b: F.sum(F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit("")))).cast("long")
    return fasta.groupBy("chrom").agg(F.sum(F.length("seq")).cast("long").alias("length"), count("C").alias("n_c"), count("G").alias("n_g"), (count("C") + count("G")).alias("n_cg"))


def length_lines(fasta: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Text lines (``value``): chromosome and length, or, with ``bin_size``, chromosome, begin and end of its fixed bins, the last clipped."""
    n = base_counts(fasta).select("chrom", "length")
    if bin_size is None:
        return n.select(F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("value"))
    b = n.where("length > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(bin_size).cast("long"))))
    return b.select(F.concat_ws("\t", "chrom", F.col("b").cast("string"), F.least(F.col("b") + bin_size, F.col("length")).cast("string")).alias("value"))


def converted_genome(fasta: DataFrame) -> DataFrame:
    """Both converted forms of every sequence: f<name> with C as T, r<name> with G as A."""
    from methloom.functions.sequence import c_to_t, g_to_a

    form = lambda p, s: F.struct(F.concat(F.lit(p), F.col("chrom")).alias("chrom"), s.alias("seq"))
    return fasta.select(F.explode(F.array(form("f", c_to_t(F.col("seq"))), form("r", g_to_a(F.col("seq"))))).alias("x")).select("x.*")


def fastq_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads (path, record, name, seq, qual) of four-line FASTQ of any size, plain or gzipped; ``record`` numbers a file's reads from 0.

    A file is read by stretches; the lines before a stretch are counted first (one
    row per stretch is gathered), so that each knows which line of a read it
    begins with. Reads across an edge are put together from their lines, the
    others never leave their task. An incomplete last read is dropped.
    """
    ship(spark)
    counts = _lines(spark, path).groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).collect()
    before: dict[tuple[str, int], int] = {}
    file, total = None, 0
    for r in sorted(counts, key=lambda r: (r.path, r.block)):
        file, total = r.path, total if r.path == file else 0
        before[r.path, r.block] = total
        total += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held = None, 0, []
        for p, b, lines in _runs(batches):
            if (p, b) != key:
                if held:
                    yield _fragments(key, at - len(held), held)
                key, at, held = (p, b), before[p, b], []
            begin, lines = at - len(held), held + lines
            at = begin + len(lines)
            lead = min(-begin % 4, len(lines))
            if lead:
                yield _fragments(key, begin, lines[:lead])
            n = (len(lines) - lead) // 4
            cut = lines[lead : lead + 4 * n]
            held = lines[lead + 4 * n :]
            if n:
                yield _reads(p, [(begin + lead) // 4 + i for i in range(n)], cut[0::4], cut[1::4], cut[3::4], [None] * n)
        if held:
            yield _fragments(key, at - len(held), held)

    def _reads(p, record, name, seq, qual, part) -> pa.RecordBatch:
        n = len(record)
        return pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(record, pa.int64()), pa.array(name, pa.string()), pa.array(seq, pa.string()), pa.array(qual, pa.string()), pa.array(part, pa.int32())], names=["path", "record", "name", "seq", "qual", "part"])

    def _fragments(key, begin: int, lines: list[str]) -> pa.RecordBatch:
        at = [begin + i for i in range(len(lines))]
        put = lambda k: [t if a % 4 == k else None for a, t in zip(at, lines)]
        return _reads(key[0], [a // 4 for a in at], put(0), put(1), put(3), [a % 4 for a in at])

    raw = durable(_lines(spark, path).mapInArrow(run, "path string, record long, name string, seq string, qual string, part int"))
    edge = raw.where("part is not null").groupBy("path", "record").agg(F.max("name").alias("name"), F.max("seq").alias("seq"), F.max("qual").alias("qual"), F.countDistinct("part").alias("k")).where("k = 4").drop("k")
    out = raw.where("part is null").drop("part").unionByName(edge)
    return out.withColumn("name", F.regexp_extract("name", r"^@?(\S*)", 1))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads (name, seq, qual) of FASTQ files."""
    return fastq_records(spark, path).select("name", "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str | list[str], second: str | list[str]) -> DataFrame:
    """Pairs (name, seq, qual, seq_2, qual_2) of two lists of files (lists or comma texts) of one length, the k-th read of a file with the k-th of its fellow.

    Reads without a fellow are dropped.
    """
    as_list = lambda p: [x.strip() for x in p.split(",") if x.strip()] if isinstance(p, str) else list(p)
    ones, twos = as_list(first), as_list(second)
    if len(ones) != len(twos):
        raise ValueError("the two lists of files differ in length")
    out = None
    for a, b in zip(ones, twos):
        mate = fastq_records(spark, b).select("record", F.col("seq").alias("seq_2"), F.col("qual").alias("qual_2"))
        pair = fastq_records(spark, a).join(mate, "record").select("name", "seq", "qual", "seq_2", "qual_2")
        out = pair if out is None else out.unionByName(pair)
    return out


def converted_reads(reads: DataFrame, mate: int = 1) -> DataFrame:
    """Reads with C as T (first mates) or G as A (second mates); the original sequence is kept in ``original``."""
    from methloom.functions.sequence import c_to_t, g_to_a

    return reads.withColumn("original", F.col("seq")).withColumn("seq", c_to_t(F.col("seq")) if mate == 1 else g_to_a(F.col("seq")))


def repair_sam(reads: DataFrame) -> DataFrame:
    """Undo the conversion after alignment: contig names lose their leading f or r, the read gets back its original bases.

    The original is in the YS:Z tag; reads on the reverse strand (0x10) get its reverse complement.
    """
    from methloom.functions.sequence import reverse_complement

    strip = lambda c: F.when(F.col(c).isin("*", "="), F.col(c)).otherwise(F.regexp_replace(c, "^[fr]", ""))
    ys = F.regexp_extract("tags", r"(?:^|\t)YS:Z:([^\t]+)", 1)
    seq = F.when(ys == "", F.col("seq")).when(F.col("flag").bitwiseAND(16) != 0, reverse_complement(ys)).otherwise(ys)
    tags = F.regexp_replace("tags", r"(^|\tSA:Z:|;|\tXA:Z:)[fr](?=[^\t;,]+,)", "$1")
    return reads.withColumn("rname", strip("rname")).withColumn("rnext", strip("rnext")).withColumn("seq", seq).withColumn("tags", tags)
