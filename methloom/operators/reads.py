"""From alignments to sites: read filters, mate trimming, pileup, site emission, per-read tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import ship, small_side
from methloom.functions.sequence import corrected_level, cytosine_context, level_category, nome_class, reverse_complement, true_share
from methloom.sources.reads import CHUNK, FLANK


def _bit(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) != 0


def hit_type() -> Column:
    """1 forward read 1, 2 forward read 2, 3 reverse read 2, 4 reverse read 1; single reads 1 or 4; else null."""
    return (
        F.when(~_bit(1) & (F.col("flag") == 0), 1).when(~_bit(1) & (F.col("flag") == 16), 4).when(~_bit(1), F.lit(None))
        .when(~_bit(16) & _bit(64), 1).when(~_bit(16) & _bit(128), 2).when(_bit(16) & _bit(128), 3).when(_bit(16) & _bit(64), 4)
    )


def usable_reads(reads: DataFrame, min_mapq: int = 30, proper_pairs: bool = True) -> DataFrame:
    """Mapped primary reads without failed, duplicate, supplementary or mate-unmapped flags, with ``hit`` and ``read_id``.

    ``proper_pairs`` asks for flag 0x2, which drops single reads too. CIGARs with
    operations other than S, M, I, D reject the read.
    """
    bad = 0x100 | 0x200 | 0x400 | 0x800 | 0x4 | (0x8 if proper_pairs else 0)
    out = reads.where(~_bit(bad) & (F.col("mapq") >= min_mapq) & F.col("cigar").rlike(r"^(\d+[SMID])+$") & (F.col("rname") != "*"))
    if proper_pairs:
        out = out.where(_bit(2))
    return out.withColumn("hit", hit_type()).where("hit is not null").withColumn("read_id", F.xxhash64("qname", "flag", "rname", "pos", "cigar", "seq"))


def without_duplicates(reads: DataFrame) -> DataFrame:
    """One read per (chrom, start, end, strand class): that of the least name.

    The order-dependent rule of marking starts and ends apart is replaced by this
    deterministic key.
    """
    key = ["rname", "pos", F.length("seq").alias("_len"), F.col("hit").isin(1, 3).alias("_cls")]
    keyed = reads.select("*", *key[2:])
    best = keyed.groupBy("rname", "pos", "_len", "_cls").agg(F.min_by(F.struct(*reads.columns), F.struct("qname", "flag", "read_id")).alias("_r"))
    return best.select("_r.*")


def reference_span() -> Column:
    """Reference bases under the CIGAR."""
    return F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MD]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def trim_overlaps(pieces: DataFrame) -> DataFrame:
    """Adds ``skip_to``: bases of the right mate before it are covered by the left mate already (0: none).

    Only mates on one chromosome share a ``pair``; every other read is one of its own.
    """
    mates = _bit(1) & (F.col("rnext") == "=")
    w = Window.partitionBy("pair")
    left = F.max(F.when(mates & (F.col("pos") <= F.col("pnext")), F.col("ref_end"))).over(w)
    first = F.min(F.when(mates & (F.col("pos") <= F.col("pnext")), F.col("pos"))).over(w)
    x = pieces.withColumn("_left", left).withColumn("_first", first)
    right = mates & (F.col("pos") > F.col("pnext")) & (F.col("pos") > F.col("_first"))
    return x.withColumn("skip_to", F.when(right, F.coalesce("_left", F.lit(0))).otherwise(F.lit(0))).drop("_left", "_first")


def aligned_runs() -> Column:
    """The runs of aligned (M) bases under the CIGAR: offsets ``g`` in the reference and ``r`` in the read, both from 0, and length ``n``."""
    n = F.regexp_extract_all("cigar", F.lit(r"(\d+)[SMID]"), 1)
    op = F.regexp_extract_all("cigar", F.lit(r"\d+([SMID])"), 1)
    zero = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<g:bigint,r:bigint,n:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        k, o = x["n"].cast("long"), x["op"]
        return F.struct(
            (acc["g"] + F.when(o.isin("M", "D"), k).otherwise(0)).alias("g"), (acc["r"] + F.when(o.isin("M", "S", "I"), k).otherwise(0)).alias("r"),
            F.when(o == "M", F.array_append(acc["out"], F.struct(acc["g"].alias("g"), acc["r"].alias("r"), k.alias("n")))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op"))), zero, step)["out"]


def aligned_pieces(reads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per run of aligned (M) bases within a reference chunk: 0-based ``ref_at``, ``bases``, ``read_at``.

    ``pair`` is common to the mates on one chromosome, and to nothing else.
    """
    x = reads.withColumn("_m", F.explode(aligned_runs())).withColumn("_s", F.col("pos") - 1 + F.col("_m.g")).withColumn("_e", F.col("_s") + F.col("_m.n"))
    x = x.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_s") / chunk), F.floor((F.col("_e") - 1) / chunk))))
    a, b = F.greatest("_s", F.col("chunk") * chunk), F.least("_e", (F.col("chunk") + 1) * chunk)
    off = F.col("_m.r") + a - F.col("_s")
    mates = _bit(1) & (F.col("rnext") == "=")
    pair = F.concat_ws("\t", F.coalesce("qname", F.lit("")), F.when(mates, F.col("rname")).otherwise(F.hex("read_id")), F.when(mates, "p").otherwise("s"))
    keep = [pair.alias("pair"), "read_id", "qname", "hit", "flag", "rnext", "pos", "pnext", (F.col("pos") + reference_span()).alias("ref_end")]
    return x.select(
        *keep, F.col("rname").alias("chrom"), "chunk", a.alias("ref_at"), off.alias("read_at"), F.length("seq").alias("read_len"),
        F.upper(F.substring("seq", (off + 1).cast("int"), (b - a).cast("int"))).alias("bases"),
    )


def with_reference(pieces: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``ref``: the reference bases under each piece, with FLANK more to either side. Pieces outside the reference are dropped.

    Sequences are cut as bytes, which doesn't walk a chunk from its first letter.
    """
    r = reference.select("chrom", "chunk", "first", F.col("seq").cast("binary").alias("_seq"))
    j = pieces.join(small_side(r, 2000), ["chrom", "chunk"])
    cut = F.substring("_seq", (F.col("ref_at") - F.col("first") - FLANK + 1).cast("int"), (F.length("bases") + 2 * FLANK).cast("int"))
    return j.withColumn("ref", cut.cast("string")).drop("_seq", "first", "chunk")


#: Codes of the bases A, C, G, T; anything else is 4.
_CODE = np.full(256, 4, np.int8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
_A, _C, _G, _T = range(4)


def _bytes_of(column: pa.Array | pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and the length of each; a null has none."""
    texts = [(t or "").encode("ascii", "replace") for t in (column.to_pylist() if isinstance(column, pa.Array) else column)]
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


class _Flat:
    """The aligned bases of many pieces, one after the other: ``piece``, ``place`` in it, ``base``, ``ref`` (codes), within the reference only."""

    def __init__(self, bases, ref):
        raw, n = _bytes_of(bases)
        under, m = _bytes_of(ref)
        piece = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        inside = place + FLANK < m[piece]
        self.under, self.ends = _CODE[under], np.cumsum(m)
        self.piece, self.place, self.base = piece[inside], place[inside], _CODE[raw][inside]
        self.at = (self.ends - m)[self.piece] + self.place + FLANK
        self.ref = self.under[self.at]

    def around(self, k: int) -> np.ndarray:
        """Codes of the reference bases ``k`` further on; 4 beyond the piece's stretch."""
        at = self.at + k
        return np.where(at < self.ends[self.piece], self.under[np.minimum(at, len(self.under) - 1)], 4)


def _mismatches(bases: pd.Series, ref: pd.Series, hit: pd.Series) -> pd.Series:
    """Bases that differ, and not by conversion, of each piece; a base beyond the reference's end is none."""
    f = _Flat(bases, ref)
    plus = hit.isin((1, 3)).to_numpy()[f.piece]
    converted = np.where(plus, (f.base == _T) & (f.ref == _C), (f.base == _A) & (f.ref == _G))
    return pd.Series(np.bincount(f.piece[(f.base != f.ref) & ~converted], minlength=len(bases)).astype("int32"))


def well_aligned(pieces: DataFrame, rate: float = 0.1) -> DataFrame:
    """Pieces of the reads with at most 0.5 + rate * length mismatches, conversion not counted.

    The rows are brought together by ``pair``, which the trimming of mates can use
    again. An unknown base (N) against a known one is a mismatch.
    """
    ship(pieces.sparkSession)
    n = F.pandas_udf(_mismatches, "int")("bases", "ref", "hit")
    # A read has few pieces, so its window is small; a repeated row is the same read and counts once.
    each = F.collect_set(F.struct("ref_at", F.col("_mm").alias("n"))).over(Window.partitionBy("pair", "read_id"))
    counted = pieces.withColumn("_mm", n).repartition("pair").withColumn("mismatches", F.aggregate(each, F.lit(0), lambda acc, p: acc + p.n))
    return counted.where(F.col("mismatches") <= 0.5 + rate * F.col("read_len")).drop("_mm")


def read_bases(pieces: DataFrame) -> DataFrame:
    """One row per aligned base: chrom, 0-based ``at``, ``base``, ``five`` (reference around it) and its middle ``ref``."""
    x = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("bases") - 1)))
    keep = ["pair", "read_id", "qname", "hit", "pos", "ref_end"]
    x = x.withColumn("at", F.col("ref_at") + F.col("i")).select(*keep, "chrom", "at", *(["skip_to"] if "skip_to" in pieces.columns else []), F.substring("bases", F.col("i") + 1, F.lit(1)).alias("base"), F.substring("ref", F.col("i") + 1, F.lit(2 * FLANK + 1)).alias("five"))
    if "skip_to" in pieces.columns:
        x = x.where(F.col("at") + 1 >= F.col("skip_to")).drop("skip_to")
    return x.withColumn("ref", F.substring("five", FLANK + 1, 1)).where("ref <> ''")


#: Counters of a pileup: calls of either strand, and the bases of each read class that tell of the other strand.
COUNTERS = ("plus_m", "plus_u", "neg_m", "neg_u", "plus_g", "plus_a", "neg_c", "neg_t")
#: The counter of (minus class, base, reference base), -1 for none.
_COUNTER = np.full((2, 5, 5), -1, np.int8)
_COUNTER[0, _G, :], _COUNTER[0, _A, :], _COUNTER[1, _C, :], _COUNTER[1, _T, :] = 4, 5, 6, 7
_COUNTER[0, _C, _C], _COUNTER[0, _T, _C], _COUNTER[1, _G, _G], _COUNTER[1, _A, _G] = 0, 1, 2, 3


def pileup(pieces: DataFrame) -> DataFrame:
    """COUNTERS per (chrom, at) of the reference's C and G, ``at`` from 0, with ``five``, the reference around it.

    ``pieces`` as ``pieces_from_reads`` gives them. Each batch of pieces is
    reduced to its positions before the shuffle, so that depth isn't moved; the
    five reference bases travel as one small number. Plus-class G and A tell of the
    - strand's base, minus-class C and T of the + strand's.
    """
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _Flat(b.column("bases"), b.column("ref"))
            minus = np.isin(b.column("hit").to_numpy(zero_copy_only=False), (2, 4)).astype(np.int8)
            at = b.column("ref_at").to_numpy()[f.piece] + f.place
            skip = b.column("skip_to").to_numpy()[f.piece]
            which = _COUNTER[minus[f.piece], f.base, f.ref]
            use = (which >= 0) & ((f.ref == _C) | (f.ref == _G)) & (at + 1 >= skip)
            chrom = b.column("chrom").dictionary_encode()
            key = chrom.indices.to_numpy()[f.piece[use]].astype(np.int64) << 40 | at[use]
            places, first, back = np.unique(key, return_index=True, return_inverse=True)
            counts = np.bincount(back * len(COUNTERS) + which[use], minlength=len(places) * len(COUNTERS)).reshape(-1, len(COUNTERS)).astype(np.int32)
            five = sum((f.around(k)[use][first].astype(np.int16) * 5 ** (FLANK - k) for k in range(-FLANK, FLANK + 1)), np.zeros(len(places), np.int16))
            yield pa.RecordBatch.from_arrays(
                [chrom.dictionary.take(pa.array(places >> 40)), pa.array(places & ((1 << 40) - 1)), pa.array(five.astype(np.int16)), *(pa.array(counts[:, i].copy()) for i in range(len(COUNTERS)))],
                names=["chrom", "at", "five", *COUNTERS],
            )

    cut = pieces.select("chrom", "ref_at", "bases", "ref", "hit", F.col("skip_to").cast("long").alias("skip_to") if "skip_to" in pieces.columns else F.lit(0).cast("long").alias("skip_to"))
    part = cut.mapInArrow(run, "chrom string, at long, five short, " + ", ".join(f"{c} int" for c in COUNTERS))
    sums = part.groupBy("chrom", "at").agg(F.max("five").alias("five"), *(F.sum(c).alias(c) for c in COUNTERS))
    letter = lambda k: F.substring(F.lit("ACGTN"), (F.floor(F.col("five") / 5 ** (FLANK - k)) % 5 + 1).cast("int"), F.lit(1))
    return sums.withColumn("five", F.concat(*(letter(k) for k in range(-FLANK, FLANK + 1))))


def emit_sites(piled: DataFrame, min_cover: int = 4, max_cover: int = 1000, context: str | None = None, nome: bool = False) -> DataFrame:
    """Cytosines of either strand with enough coverage: the 12 columns of the ratio report, positions from 1.

    The reads of the other class show a cytosine's true base, untouched by
    conversion: C (``rev_g`` of them) or, where it is a variant, T on the + strand;
    G or A on the - strand. Where more than 20 were seen, the level is divided by
    the share of true cytosines, 1 at most; ``eff_ct`` is the coverage that this
    share leaves, null without such evidence. ``nome`` adds the WCG / GCH class.
    """
    # A position has calls on the strand of its reference base only, so both strands come from one pass.
    minus = F.col("ref_base") == "G"
    of = lambda m, p: F.when(minus, F.col(m)).otherwise(F.col(p))
    c, t, g, a = of("neg_m", "plus_m"), of("neg_u", "plus_u"), of("plus_g", "neg_c"), of("plus_a", "neg_t")
    five = F.when(minus, reverse_complement(F.col("five"))).otherwise(F.col("five"))
    rows = piled.withColumn("ref_base", F.substring("five", FLANK + 1, 1)).where(F.col("ref_base").isin("C", "G"))
    rows = rows.select("chrom", "at", minus.alias("minus"), c.alias("c"), t.alias("t"), g.alias("g"), a.alias("a"), five.alias("fivemer")).where((F.col("c") + F.col("t")).between(min_cover, max_cover))
    c, t, g, a, five = (F.col(x) for x in ("c", "t", "g", "a", "fivemer"))
    out = rows.select(
        "chrom", (F.col("at") + 1).alias("start"), F.when(F.col("minus"), "-").otherwise("+").alias("strand"), cytosine_context(F.substring(five, FLANK + 2, 2)).alias("context"),
        c.alias("meth"), (c + t).cast("int").alias("coverage"), corrected_level(c, t, g, a).alias("value"), ((c + t) * true_share(g, a)).alias("eff_ct"), g.alias("rev_g"), (g + a).alias("rev_ga"),
        "fivemer", *([nome_class(F.substring(five, FLANK, 3)).alias("nome")] if nome else []),
    ).withColumn("category", level_category(F.col("value")))
    return out if context in (None, "C") else out.where(F.col("context") == context)


def sites_from_reads(reads: DataFrame, reference: DataFrame, min_mapq: int = 30, proper_pairs: bool = True, mismatch_rate: float | None = 0.1, dedup: bool = False, trim: bool = True, chunk: int = CHUNK, **emit) -> DataFrame:
    """The whole path from alignments and a chunked reference to sites."""
    return emit_sites(pileup(pieces_from_reads(reads, reference, min_mapq, proper_pairs, mismatch_rate, dedup, trim, chunk)), **emit)


def pieces_from_reads(reads: DataFrame, reference: DataFrame, min_mapq: int = 30, proper_pairs: bool = True, mismatch_rate: float | None = 0.1, dedup: bool = False, trim: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Aligned pieces of the usable reads with the reference under them; ``chunk`` is the chunk size of the reference."""
    u = usable_reads(reads, min_mapq, proper_pairs)
    if dedup:
        u = without_duplicates(u)
    p = with_reference(aligned_pieces(u, chunk), reference)
    if mismatch_rate is not None:
        p = well_aligned(p, mismatch_rate)
    return trim_overlaps(p) if trim else p


def bases_from_reads(reads: DataFrame, reference: DataFrame, min_mapq: int = 30, proper_pairs: bool = True, mismatch_rate: float | None = 0.1, dedup: bool = False, trim: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Aligned bases of the usable reads, one row each."""
    return read_bases(pieces_from_reads(reads, reference, min_mapq, proper_pairs, mismatch_rate, dedup, trim, chunk))


def _calls(bases: DataFrame) -> DataFrame:
    """Cytosine calls of reads: context and whether methylated."""
    plus = F.col("hit").isin(1, 3)
    five = F.when(plus, F.col("five")).otherwise(reverse_complement(F.col("five")))
    m = F.when(plus, (F.col("base") == "C") & (F.col("ref") == "C")).otherwise((F.col("base") == "G") & (F.col("ref") == "G"))
    u = F.when(plus, (F.col("base") == "T") & (F.col("ref") == "C")).otherwise((F.col("base") == "A") & (F.col("ref") == "G"))
    return bases.withColumn("context", cytosine_context(F.substring(five, FLANK + 2, 2))).withColumn("is_m", m).where(m | u)


def read_tallies(bases: DataFrame) -> DataFrame:
    """Per read: cytosines and methylated ones, in all and per context."""
    n = lambda c: F.count(F.when(c, 1))
    per = [(f"n_{x.lower()}", F.col("context") == x) for x in ("CG", "CHG", "CHH")]
    return _calls(bases).groupBy("pair", "read_id", "qname", "chrom", "pos").agg(
        F.count(F.lit(1)).alias("n_c"), n(F.col("is_m")).alias("m_c"), *(n(c).alias(k) for k, c in per), *(n(c & F.col("is_m")).alias(k.replace("n_", "m_")) for k, c in per)
    )


def context_totals(bases: DataFrame) -> DataFrame:
    """Methylated and unmethylated calls per context over all reads."""
    return _calls(bases).where("context is not null").groupBy("context").agg(F.count(F.when(F.col("is_m"), 1)).alias("methylated"), F.count(F.when(~F.col("is_m"), 1)).alias("unmethylated"))


def methyl_strings(bases: DataFrame) -> DataFrame:
    """Per read its calls in reference order: Z z (CG), X x (CHG), H h (CHH), capitals methylated, with their first position from 1."""
    letter = F.when(F.col("context") == "CG", "Z").when(F.col("context") == "CHG", "X").when(F.col("context") == "CHH", "H").otherwise("U")
    c = _calls(bases).withColumn("l", F.when(F.col("is_m"), letter).otherwise(F.lower(letter)))
    return c.groupBy("pair", "read_id", "qname", "chrom", "pos").agg((F.min("at") + 1).alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "l"))), lambda x: x.l), "").alias("calls"))


def annotated_reads(reads: DataFrame, reference: DataFrame, min_mapq: int = 30, proper_pairs: bool = True, mismatch_rate: float = 0.1, trim: bool = True, letters: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The usable reads with ``nm`` (mismatches), ``md`` (a letter per place of the alignment), ``yc``, ``yd`` and ``before``.

    ``md``: = for an equal base, M a methylated and U an unmethylated cytosine call
    (or, with ``letters``, Z z, X x, H h by context), the reference base where they
    differ otherwise, S, I and D as in the CIGAR; bases that the left mate covers
    are =. ``yc`` is CT for reads 1 and GA for reads 2, ``yd`` f or r. ``before`` is
    the sequence as it was before conversion. A repeated row is kept.
    """
    ship(reads.sparkSession)
    by_context = b"XHZ" if letters else b"MMM"

    def marks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            f = _Flat(b.column("bases"), b.column("ref"))
            plus = np.isin(b.column("hit").to_numpy(zero_copy_only=False), (1, 3))[f.piece]
            mine = np.where(plus, f.ref == _C, f.ref == _G)
            same, turned = f.base == f.ref, np.where(plus, f.base == _T, f.base == _A)
            one, two = np.where(plus, f.around(1), 3 - f.around(-1)), np.where(plus, f.around(2), 3 - f.around(-2))
            kind = np.where(one == _G, 2, np.where(two == _G, 0, 1))
            call = np.frombuffer(by_context, np.uint8)[kind]
            lower = call + 32 if letters else np.full(len(call), ord("U"), np.uint8)
            md = np.where(mine & same, call, np.where(mine & turned, lower, np.where(same, ord("="), np.frombuffer(b"ACGTN", np.uint8)[f.ref])))
            skip = b.column("ref_at").to_numpy()[f.piece] + f.place + 1 < b.column("skip_to").to_numpy()[f.piece]
            md = np.where(skip, ord("="), md).astype(np.uint8)
            was = np.where(mine & turned & ~skip, f.ref, f.base)
            before = np.frombuffer(b"ACGTN", np.uint8)[was]
            n = np.bincount(f.piece, minlength=len(b))
            cut = lambda flat: [bytes(x).decode() for x in np.split(flat, np.cumsum(n)[:-1])] if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column("pair"), b.column("read_id"), b.column("read_at"), b.column("mismatches"), pa.array(cut(md), pa.string()), pa.array(cut(before), pa.string())], names=["pair", "read_id", "read_at", "nm", "md", "before"])

    p = well_aligned(with_reference(aligned_pieces(usable_reads(reads, min_mapq, proper_pairs), chunk), reference), mismatch_rate)
    p = trim_overlaps(p) if trim else p.withColumn("skip_to", F.lit(0))
    cols = ["pair", "read_id", "hit", "read_at", "mismatches", "bases", "ref", "ref_at", F.col("skip_to").cast("long").alias("skip_to")]
    marked = p.select(*cols).mapInArrow(marks, "pair string, read_id long, read_at long, nm int, md string, before string")
    text = lambda f: F.array_join(F.transform(F.array_sort("x"), lambda e: e[f]), "")
    per = marked.groupBy("pair", "read_id").agg(F.max("nm").alias("nm"), F.collect_set(F.struct("read_at", "md", "before")).alias("x")).select(F.col("read_id").alias("_id"), F.split("pair", "\t")[0].alias("_q"), "nm", text("md").alias("_md"), text("before").alias("_before"))
    u = usable_reads(reads, min_mapq, proper_pairs)
    j = u.join(per, (F.coalesce(u.qname, F.lit("")) == per._q) & (u.read_id == per._id))
    ops = F.zip_with(F.regexp_extract_all("cigar", F.lit(r"(\d+)[SMID]"), 1), F.regexp_extract_all("cigar", F.lit(r"\d+([SMID])"), 1), lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))
    zero = F.struct(F.lit(1).alias("m"), F.lit(1).alias("r"), F.lit("").alias("md"), F.lit("").alias("before"))

    def step(acc: Column, x: Column) -> Column:
        aligned, read = x["op"] == "M", x["op"].isin("M", "S", "I")
        return F.struct(
            (acc["m"] + F.when(aligned, x["n"]).otherwise(0)).alias("m"), (acc["r"] + F.when(read, x["n"]).otherwise(0)).alias("r"),
            F.concat(acc["md"], F.when(aligned, F.substring("_md", acc["m"], x["n"])).otherwise(F.repeat(x["op"], x["n"]))).alias("md"),
            F.concat(acc["before"], F.when(aligned, F.substring("_before", acc["m"], x["n"])).when(read, F.substring("seq", acc["r"], x["n"])).otherwise("")).alias("before"),
        )

    walked = j.withColumn("_w", F.aggregate(ops, zero, step))
    first = F.col("hit").isin(1, 4)
    return walked.select(
        *(c for c in reads.columns), "hit", "nm", F.col("_w.md").alias("md"), F.when(first, "CT").otherwise("GA").alias("yc"), F.when(F.col("hit").isin(1, 2), "f").otherwise("r").alias("yd"), F.col("_w.before").alias("before"),
    )


def annotated_lines(annotated: DataFrame) -> DataFrame:
    """SAM lines (``value``) of ``annotated_reads`` with the NM, MD, YC, YD and RA tags."""
    tag = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    eleven = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "before", "qual")
    return annotated.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in eleven), tag("NM:i:", "nm"), tag("MD:Z:", "md"), tag("YC:Z:", "yc"), tag("YD:Z:", "yd"), tag("RA:Z:", "seq")).alias("value"))


def alignment_log(reads: DataFrame, min_mapq: int = 30, proper_pairs: bool = True) -> DataFrame:
    """Numbers of reads, of usable ones, and of these on the forward and the reverse strand (``name``, ``n``), in one pass."""
    bad = 0x100 | 0x200 | 0x400 | 0x800 | 0x4 | (0x8 if proper_pairs else 0)
    good = ~_bit(bad) & (F.col("mapq") >= min_mapq) & hit_type().isNotNull() & (_bit(2) if proper_pairs else F.lit(True))
    n = lambda c: F.count(F.when(c, 1))
    row = reads.agg(F.count(F.lit(1)).alias("a"), n(good).alias("b"), n(good & ~_bit(16)).alias("c"), n(good & _bit(16)).alias("d"))
    names = ("Total_reads", f"Total_Mapped_Q{min_mapq}", "Mapped_forward", "Mapped_reverse")
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("name"), F.col(c).alias("n")) for t, c in zip(names, "abcd")))).alias("x")).select("x.*")


def insert_sizes(reads: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Insert sizes 0..2000 of pairs on one chromosome; the first million is the feature."""
    return reads.where((F.col("rnext") == "=") & F.col("tlen").between(0, 2000)).select("tlen").limit(limit)


def head_motifs(reads: DataFrame, reference: DataFrame, min_mapq: int = -1, proper_pairs: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The four bases at the fragment end of each read, with those of the reference and the insert size.

    The end is the first base of forward reads and the last of reverse ones (whose
    motif is given as on the reference strand). Converted bases are shown as U.
    Reads whose end has no four aligned bases in a row of the reference are left out.
    A repeated row is kept.
    """
    u = usable_reads(reads, min_mapq, proper_pairs)
    # The four places from ``_w``, from 0 as ``_o`` from the read's first one; a chunk holds them all with its flanks if it has the second one.
    x = u.withColumn("_o", F.when(F.col("hit").isin(1, 2), F.lit(0).cast("long")).otherwise(reference_span() - 4)).withColumn("_w", F.col("pos") - 1 + F.col("_o"))

    def under(m: Column) -> Column:
        lo, hi = F.greatest(m["g"], F.col("_o")), F.least(m["g"] + m["n"], F.col("_o") + 4)
        return F.substring("seq", (m["r"] + lo - m["g"] + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))

    x = x.withColumn("_b", F.upper(F.array_join(F.transform(aligned_runs(), under), ""))).where((F.length("_b") == 4) & (F.col("_w") >= 0))
    x = x.select("qname", "hit", F.col("rname").alias("chrom"), "pos", "cigar", F.col("tlen").alias("insert_size"), "_w", "_b", F.floor((F.col("_w") + 1) / chunk).alias("chunk"))
    r = reference.select("chrom", "chunk", "first", F.col("seq").cast("binary").alias("_seq"))
    j = x.join(small_side(r, 2000, otherwise="merge"), ["chrom", "chunk"]).withColumn("ref4", F.substring("_seq", (F.col("_w") - F.col("first") + 1).cast("int"), 4).cast("string"))
    plus = F.col("hit").isin(1, 3)
    at = lambda c, i: F.substring(c, i, 1)
    converted = lambda i: (at("_b", i) == F.when(plus, "T").otherwise("A")) & (at("ref4", i) == F.when(plus, "C").otherwise("G"))
    head = F.concat(*(F.when(converted(i), "U").otherwise(at("_b", i)) for i in range(1, 5)))
    return j.where(F.length("ref4") == 4).select("qname", "hit", "chrom", "pos", "cigar", "insert_size", head.alias("head4"), "ref4")


def motif_counts(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("ref4").agg(F.count(F.lit(1)).alias("n"))
