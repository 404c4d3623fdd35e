"""Parsing of text formats, alignments and references; the read pipeline against brute force; sinks; streams."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from methloom.functions import sequence as seqf
from methloom.operators import reads as R
from methloom.sources import reads as src
from methloom.sources import regions, sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


COLS = ("chrom", "start", "end", "coverage", "strand", "context", "meth")


def parsed(spark, fmt, *rows, **kw):
    return [tuple(r[c] for c in COLS) + (round(r.value, 6) if r.value is not None else None,) for r in text.parse_sites(lines(spark, *rows), fmt, **kw).orderBy("start").collect()]


def test_site_formats(spark):
    assert parsed(spark, "methratio", "#chrom x y", "chr1 100 + CG 4 8", "chr1\t200\t-\tCHH\t0\t3", "bad line here", "") == [("chr1", 100, 101, 8, 0, 1, 4, 0.5)]
    assert parsed(spark, "bedmethyl", "c 99 100 . 15 + 99 100 0,0,0 15 7") == [("c", 100, 101, 15, 0, 0, 1, 0.07)]
    assert parsed(spark, "bedsimple", "c 5 6 site1 - CHG 1 7") == [("c", 5, 6, 7, 1, 2, 1, 0.1429)]
    assert parsed(spark, "bismark", "c 10 + 3 1 CHH CAA") == [("c", 10, 11, 4, 0, 3, 3, 0.75)]
    assert parsed(spark, "simpleme", "c 10 0.833333 6 + CG", "c 11 0.5 6 - CG") == [("c", 10, 11, 6, 0, 1, 5, 0.833333), ("c", 11, 12, 6, 1, 1, 3, 0.5)]
    mod = parsed(spark, "modkit_pileup", "c 1 2 m,CG,0 9 . 1 2 0 10 40.0 4 6", "c 1 2 h,CG,0 9 + 1 2 0 10 40.0 4 6", "c 5 6 m 9 + 1 2 0 10 40.0 4 6")
    assert mod == [("c", 2, 3, 10, 0, 1, 4, 0.4)]
    with pytest.raises(ValueError):
        text.parse_sites(lines(spark, "x"), "nope")


def test_import_filters(spark):
    rows = ("a 1 + CG 1 4", "a 2 - CHG 2 4", "b 3 + CG 3 4", "a 4 + CG 0 3", "a 5 + XX 1 9")
    assert [r[1] for r in parsed(spark, "methratio", *rows, chrom="a")] == [1, 2, 5]
    assert [r[1] for r in parsed(spark, "methratio", *rows, context="CG")] == [1, 3]
    assert {r[1]: r[7] for r in parsed(spark, "methratio", *rows, signed=True)}[2] == -0.5
    assert {r[1]: r[5] for r in parsed(spark, "methratio", *rows)}[5] is None
    assert [r[1] for r in parsed(spark, "methratio", *rows, min_cover=1)] == [1, 2, 3, 4, 5]


def test_view_lines_of_bedmethyl(spark):
    s = text.parse_sites(lines(spark, "chr11 61448 61449 . 15 + 61448 61449 55,255,0 15 7", "chr11 61449 61450 . 5 - 61449 61450 0,255,0 5 0"), "bedmethyl")
    got = [r.value for r in text.site_lines(s.drop("id", "meth")).orderBy("value").collect()]
    assert got == ["chr11\t61449\t61450\t0.070000\t15\t+\tC", "chr11\t61450\t61451\t0.000000\t5\t-\tC"]
    assert [r.value for r in text.bedgraph_lines(s, merge_strands=True).orderBy("value").collect()] == ["chr11\t61449\t61450\t0.070000", "chr11\t61450\t61451\t-0.000000"]


def test_native_table_round_trip(spark, tmp_path):
    s = text.parse_sites(lines(spark, *(f"c{i % 3} {i} + CG {i % 5} 9" for i in range(1, 60))), "methratio")
    text.write_sites(s, str(tmp_path / "t"))
    back = text.read_table(spark, str(tmp_path / "t"))
    key = lambda df: sorted(map(tuple, df.select(*s.columns).collect()), key=repr)
    assert key(back) == key(s)
    plan = back.where("chrom = 'c1' and start > 30")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThan(start,30)" in plan


def test_regions(spark):
    assert [tuple(r) for r in regions.parse_bed(lines(spark, "c 5 9", "#x", "c 7 20 -")).orderBy("rs").select("chrom", "rs", "re", "strand").collect()] == [("c", 5, 9, 2), ("c", 7, 20, 1)]
    b = regions.numbered_regions(regions.parse_bed(lines(spark, "c 5 9 nameA", "c 1 3 nameB").coalesce(1), "name")).orderBy("region_idx").collect()
    assert [(r.region_id, r.name) for r in b] == [("region_000001", "nameA"), ("region_000002", "nameB")]
    g = regions.parse_gtf(lines(spark, 'chr1 xs xx 100 290 . - . gene_id "gene1";')).first()
    assert (g.region_id, g.rs, g.re, g.strand) == ("gene1", 100, 290, 1)
    assert regions.parse_gff(lines(spark, "chr1\txs\txx\t100\t190\t.\t+\t.\tID=gene1;Name=z")).first().region_id == "gene1"
    assert [tuple(r)[1:5] for r in regions.region_string(spark, "chr-1:5-9,-;b:1-2").collect()] == [("chr-1", 5, 9, 1), ("b", 1, 2, 2)]
    with pytest.raises(ValueError):
        regions.region_string(spark, "chr1")
    assert [(r.cell_id, r.group_label) for r in regions.parse_group_map(lines(spark, "cell_id group", "x g1", "y", "z g2")).collect()] == [("x", "g1"), ("z", "g2")]


def test_sizes(spark, tmp_path):
    (tmp_path / "s").write_text("a\t10\nb\t20\n")
    sizes = text.read_sizes(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in text.chrom_dictionary(sizes).orderBy("tid").collect()] == [(0, "a", 10), (1, "b", 20)]


def bam(records, names):
    """A BAM of (qname, flag, ref, pos0, cigar ops, seq) in BGZF-like gzip members."""
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n in names:
        body += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for q, flag, ref, pos, ops, seq in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        rec = struct.pack("<iiBBHHHiiii", ref, pos, len(q) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + q.encode() + b"\0"
        rec += b"".join(struct.pack("<I", (n << 4) | "MIDNSHP=X".index(o)) for n, o in ops) + packed + b"\xff" * len(seq)
        body += struct.pack("<i", len(rec)) + rec
    return gzip.compress(body[:50]) + gzip.compress(body[50:])


def test_alignments(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam([("q1", 0, 0, 4, [(3, "M"), (1, "I"), (2, "M")], "ACGTAC"), ("q2", 16, 1, 0, [(5, "M")], "ACGTN")], ["c1", "c2"]))
    got = [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq) for r in src.read_bam(spark, str(tmp_path / "x.bam")).orderBy("qname").collect()]
    assert got == [("q1", 0, "c1", 5, "3M1I2M", "ACGTAC"), ("q2", 16, "c2", 1, "5M", "ACGTN")]
    sam = lines(spark, "@SQ\tSN:c1\tLN:99", "q\t99\tfc1\t5\t60\t4M\t=\t9\t8\tTTGT\tIIII\tYS:Z:CTGC\tSA:Z:rc1,5,+,4M,60,0;")
    assert [tuple(r) for r in src.sam_dictionary(sam).collect()] == [("c1", 99)]
    fixed = src.repair_sam(src.parse_sam(sam)).first()
    assert (fixed.rname, fixed.rnext, fixed.seq) == ("c1", "=", "CTGC") and "SA:Z:c1," in fixed.tags


def test_fasta_fastq(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 note\nACGTCC\nGG\n>c2\nNNa\n>empty\n")
    fa = src.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {tuple(r) for r in fa.collect()} == {("c1", "ACGTCCGG"), ("c2", "NNA")}
    assert {tuple(r) for r in src.base_counts(fa).collect()} == {("c1", 8, 3, 3, 6), ("c2", 3, 0, 0, 0)}
    assert {tuple(r) for r in src.converted_genome(fa).where("chrom like '%c1'").collect()} == {("fc1", "ATGTTTGG"), ("rc1", "ACATCCAA")}
    chunks = {(r.chunk, r.first): r.seq for r in src.chunked_reference(fa.where("chrom = 'c1'"), 5).collect()}
    assert chunks == {(0, -2): "NNACGTCCG", (1, 3): "TCCGGNN"}
    (tmp_path / "r.fq.gz").write_bytes(gzip.compress(b"@a x\nACC\n+\nIII\n@b\nGGC\n+\nIII\n"))
    fq = src.read_fastq(spark, str(tmp_path / "r.fq.gz"))
    assert [(r.name, r.seq, r.original) for r in src.converted_reads(fq).orderBy("name").collect()] == [("a", "ATT", "ACC"), ("b", "GGT", "GGC")]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTNacg",)], "s string")
    r = df.select(seqf.reverse_complement(F.col("s")).alias("rc"), seqf.c_to_t(F.col("s")).alias("ct"), seqf.centred(F.col("s"), F.lit(0), 2).alias("l"), seqf.centred(F.col("s"), F.lit(7), 2).alias("e")).first()
    assert (r.rc, r.ct, r.l, r.e) == ("cgtNACGT", "ATGTNatg", "NNACG", "ACGNN")
    c = spark.createDataFrame([("GA", "ACG"), ("AG", "GCA"), ("TT", "CCC"), ("NG", "TCG"), ("G", None)], "n string, t string")
    assert [tuple(x) for x in c.select(seqf.cytosine_context(F.col("n")), seqf.nome_class(F.col("t"))).collect()] == [("CG", "WCG"), ("CHG", "GCH"), ("CHH", None), (None, "WCG"), ("CG", None)]
    v = spark.createDataFrame([(8, 2, 15, 15), (8, 2, 5, 5), (0, 0, 30, 0), (1, 9, 0, 30)], "c int, t int, g int, a int")
    assert [x[0] for x in v.select(seqf.corrected_level(*map(F.col, "ctga"))).collect()] == [1.0, 0.8, None, 0.1]


def brute_pileup(genome, reads, min_mapq=30, rate=0.1):
    import re

    good = []
    for x in reads:
        q, flag, chrom, pos, mapq, cigar, rnext, pnext, seq = x
        hit = {0: 1, 16: 4, 99: 1, 163: 2, 147: 3, 83: 4}.get(flag)
        if hit is None or mapq < min_mapq or not re.fullmatch(r"(\d+[SMID])+", cigar):
            continue
        pairs, g, r = [], pos - 1, 0
        for n, op in re.findall(r"(\d+)([SMID])", cigar):
            n = int(n)
            if op == "M":
                pairs += [(g + i, seq[r + i]) for i in range(n)]
            g, r = g + (n if op in "MD" else 0), r + (n if op in "MSI" else 0)
        plus, ref = hit in (1, 3), genome[chrom]
        bad = sum(p < len(ref) and b != ref[p] and not ((b, ref[p]) == (("T", "C") if plus else ("A", "G"))) for p, b in pairs)
        if bad <= 0.5 + rate * len(seq):
            good.append((x, pairs, plus, g + 1))
    out = {}
    for (q, flag, chrom, pos, *_, rnext, pnext, _), pairs, plus, _ in good:
        skip, ref = 0, genome[chrom]
        if rnext == "=" and pos > pnext:
            skip = max((end for y, _, _, end in good if y[0] == q and y[3] <= y[7]), default=0)
        for p, b in pairs:
            if p < len(ref) and p + 1 >= skip and ref[p] == ("C" if plus else "G") and b in ("CT" if plus else "GA"):
                k = (chrom, p + 1, "+" if plus else "-")
                m, c = out.get(k, (0, 0))
                out[k] = (m + (b in "CG"), c + 1)
    return out


def test_pileup_against_brute_force(spark):
    rnd = random.Random(8)
    genome = {c: "".join(rnd.choice("ACGT") for _ in range(230)) for c in ("c1", "c2")}

    def read(k, flag, pos, rnext="*", pnext=0, chrom=None, q=None):
        chrom, plus = chrom or rnd.choice(["c1", "c2"]), flag in (0, 99, 147)
        shape = rnd.choice([[("M", 30)], [("S", 3), ("M", 20), ("I", 2), ("M", 10)], [("M", 15), ("D", 4), ("M", 15)], [("M", 40)]])
        seq, g = "", pos - 1
        for op, n in shape:
            if op == "M":
                for p in range(g, g + n):
                    b = genome[chrom][p] if p < len(genome[chrom]) else "A"
                    if rnd.random() < 0.5 and b == ("C" if plus else "G"):
                        b = "T" if plus else "A"
                    if rnd.random() < (0.3 if k % 9 == 0 else 0.02):
                        b = rnd.choice("ACGT")
                    seq += b
            elif op in "SI":
                seq += "".join(rnd.choice("ACGT") for _ in range(n))
            g += n if op in "MD" else 0
        return (q or f"q{k}", flag, chrom, pos, rnd.choice([60, 60, 60, 29, 30]), "".join(f"{n}{op}" for op, n in shape), rnext, pnext, seq)

    reads = [read(k, rnd.choice([0, 16]), rnd.randint(1, 195)) for k in range(120)]
    for k in range(40):
        a, b = rnd.randint(1, 150), rnd.randint(0, 45)
        c = rnd.choice(["c1", "c2"])
        reads += [read(1000 + k, 99, a, "=", a + b, c, f"p{k}"), read(1001 + k, 147, a + b, "=", a, c, f"p{k}")]
    reads.append(("h", 0, "c1", 5, 60, "5H10M", "*", 0, "ACGTACGTAC"))
    df = spark.createDataFrame([(q, f, c, p, m, cg, rn, pn, 0, s, "*", "") for q, f, c, p, m, cg, rn, pn, s in reads], src.SAM)
    fa = spark.createDataFrame(list(genome.items()), "chrom string, seq string")
    for chunk in (50, 10_000):
        got = R.sites_from_reads(df, src.chunked_reference(fa, chunk), proper_pairs=False, chunk=chunk, min_cover=1).collect()
        assert {(r.chrom, r.start, r.strand): (r.meth, r.coverage) for r in got} == brute_pileup(genome, reads)
    assert all(r.fivemer[2] == "C" for r in got)
    assert R.usable_reads(df, proper_pairs=True).count() == sum(r[1] in (99, 147) and r[4] >= 30 for r in reads)
    usable = R.usable_reads(df, proper_pairs=False)
    one = R.without_duplicates(R.usable_reads(df.unionByName(df), proper_pairs=False)).collect()
    places = {(r.rname, r.pos, len(r.seq), r.hit in (1, 3)) for r in usable.collect()}
    assert len(one) == len(places) < usable.count() and {(r.rname, r.pos, len(r.seq), r.hit in (1, 3)) for r in one} == places
    b = R.bases_from_reads(df, src.chunked_reference(fa), proper_pairs=False)
    tallies = R.read_tallies(b).agg(F.sum("n_c").alias("n"), F.sum("m_c").alias("m")).first()
    want = brute_pileup(genome, reads)
    assert (tallies.n, tallies.m) == (sum(c for _, c in want.values()), sum(m for m, _ in want.values()))
    strings = R.methyl_strings(b).collect()
    assert sum(len(r.calls) for r in strings) == tallies.n and sum(ch.isupper() for r in strings for ch in r.calls) == tallies.m
    heads = R.head_motifs(df, src.chunked_reference(fa, 50), proper_pairs=False, chunk=50).collect()
    assert heads and all(len(h.head4) == 4 for h in heads)
    assert R.insert_sizes(df).count() == sum(r[6] == "=" for r in reads)


def test_evidence_of_the_other_strand(spark):
    """10 calls at level 0.5 and 30 reads of the other class, 20 of them with the true base, on either strand."""
    fa = spark.createDataFrame([("c", "AATTCAATTATTGAATTA")], "chrom string, seq string")
    rows = []
    for base, at, own, other, true, variant, (m, u) in (("C", 4, 0, 16, "C", "T", "CT"), ("G", 12, 16, 0, "G", "A", "GA")):
        rows += [(f"{base}{i}", own, at + 1, m if i < 5 else u) for i in range(10)] + [(f"o{base}{i}", other, at + 1, true if i < 20 else variant) for i in range(30)]
    df = spark.createDataFrame([(q, f, "c", p, 60, "1M", "*", 0, 0, s, "*", "") for q, f, p, s in rows], src.SAM)
    piled = R.pileup(R.pieces_from_reads(df, src.chunked_reference(fa), proper_pairs=False, mismatch_rate=None))
    got = {r.strand: r for r in R.emit_sites(piled, nome=True).where("meth = 5").collect()}
    assert set(got) == {"+", "-"}
    for r in got.values():
        assert (r.meth, r.coverage, r.rev_g, r.rev_ga, r.context, r.category) == (5, 10, 20, 30, "CHH", "Mh")
        assert r.value == pytest.approx(0.75) and r.eff_ct == pytest.approx(10 * 20 / 30)
    assert (got["+"].fivemer, got["-"].fivemer) == ("TTCAA", "TTCAA")
    # The other class's reads are calls of the other strand where the reference has the other base: none here.
    assert R.emit_sites(piled).count() == 2


def test_annotated_reads(spark):
    fa = spark.createDataFrame([("c", "AACGTTCAGGAACCGGTT")], "chrom string, seq string")
    rows = [("a", 0, "c", 1, 60, "2S6M", "*", 0, 0, "GGAATGTT", "*", ""), ("b", 16, "c", 7, 60, "3M1I2M2D2M", "*", 0, 0, "CAAAGACC", "*", ""), ("low", 0, "c", 1, 10, "4M", "*", 0, 0, "AACG", "*", "")]
    df = spark.createDataFrame(rows, src.SAM)
    got = {r.qname: r for r in R.annotated_reads(df, src.chunked_reference(fa), proper_pairs=False, mismatch_rate=1.0).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].md, got["a"].before, got["a"].nm, got["a"].yc, got["a"].yd) == ("SS==U===", "GGAACGTT", 0, "CT", "f")
    assert (got["b"].md, got["b"].before) == ("==UIM=DD=G", "CAGAGACC")
    assert R.annotated_reads(df, src.chunked_reference(fa), proper_pairs=False, letters=True).where("qname = 'a'").first().md == "SS==z==="
    line = R.annotated_lines(R.annotated_reads(df, src.chunked_reference(fa), proper_pairs=False)).where("value like 'a%'").first().value
    assert line.split("\t")[9:] == ["GGAACGTT", "*", "NM:i:0", "MD:Z:SS==U===", "YC:Z:CT", "YD:Z:f", "RA:Z:GGAATGTT"]
    assert R.annotated_reads(df.limit(0), src.chunked_reference(fa), proper_pairs=False).collect() == []
    assert {r.name: r.n for r in R.alignment_log(df, proper_pairs=False).collect()} == {"Total_reads": 3, "Total_Mapped_Q30": 2, "Mapped_forward": 1, "Mapped_reverse": 1}


def test_sinks(spark):
    m = spark.createDataFrame([("b", "r2", 0.5), ("a", "r1", 0.25)], "id string, region_id string, value double")
    lines_, feats, cells = sinks.matrix_market(m, "id", "region_id", "value")
    assert [r.value for r in lines_.collect()][:2] == ["%%MatrixMarket matrix coordinate real general", "2 2 2"]
    assert {r.value for r in lines_.collect()} >= {"1 1 0.250000", "2 2 0.500000"}
    assert [r.value for r in feats.collect()] == ["r1", "r2"] and [r.value for r in cells.collect()] == ["a", "b"]
    dense = {r.id: (r.r1, r.r2) for r in sinks.dense_matrix(m, "id", "region_id", "value", ["r1", "r2"]).collect()}
    assert dense == {"a": (0.25, 0.0), "b": (0.0, 0.5)}
    p = spark.createDataFrame([("g", 0, 0, 0.5)], "region_id string, bin int, context int, level double")
    assert sinks.profile_matrix_lines(p, 2, 0).first().value == "g\t0.5000\tnan"


def test_stream_ingest(spark, tmp_path):
    from methloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("c 5 + CG 4 8\nc 105 - CHH 1 9\nc 7 + CG 1 2\n")
    s = ingest.stream_sites(spark, str(tmp_path / "in"), "methratio")
    q = ingest.append_table(s, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    w = ingest.window_counts(ingest.stream_sites(spark, str(tmp_path / "in"), "methratio"), 100)
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.win_start, r.meth, r.coverage) for r in spark.table("w").collect()} == {(0, 4, 8), (100, 1, 9)}


def binary_file(path, kind, blocks, magic=None, chroms=("c1", "c22"), zipped=True):
    """A file of the documented layout: blocks are (tid, first, last, records as bytes, form, span, step, n)."""
    import zlib

    magic = 0x8000 if magic is None else magic
    key = max(map(len, chroms))
    tree = struct.pack("<IIIIQII", 0x78CA8C91, 1, key, 8, len(chroms), 0, 0) + struct.pack("<BBH", 1, 0, len(chroms))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", i, 1000) for i, c in enumerate(chroms))
    data, at, spots = b"", 64 + len(tree), []
    for tid, a, b, body, form, span, step, n in blocks:
        raw = body if magic == 0x8789F2EB else struct.pack("<IIIIIBBH", tid, a, b, step, span, form, 0, n) + body
        raw = zlib.compress(raw) if zipped else raw
        spots.append((tid, a, tid, b, at + len(data), len(raw)))
        data += raw
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(spots), 0, 0, 9, 9, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(spots)) + b"".join(struct.pack("<IIIIQQ", *s) for s in spots)
    head = struct.pack("<IHHQQQHHQQIQ", magic, kind, 0, 64, at, at + len(data), 0, 0, 0, 0, 1 << 15 if zipped else 0, 0)
    path.write_bytes(head + tree + data + index)


def test_binary_sites(spark, tmp_path):
    from methloom.sources import binary as B

    kind = B.SITES | B.END | B.COVERAGE | B.STRAND | B.CONTEXT
    rec = lambda s, v, c, st, cx, ident=None: struct.pack("<IIfHBB", s, s + 1, v, c, st, cx) + (ident.encode() + b"\0" if ident is not None else b"")
    binary_file(tmp_path / "a.sites", kind, [(0, 5, 8, rec(5, 0.5, 8, 0, 1) + rec(7, 0.25, 4, 1, 3), 1, 0, 0, 2), (1, 9, 10, rec(9, 1.0, 3, 2, 2), 1, 0, 0, 1)])
    got = sorted(tuple(r) for r in B.read_binary(spark, str(tmp_path / "a.sites")).collect())
    assert got == [("c1", 5, 6, 0.5, 8, 0, 1, None), ("c1", 7, 8, 0.25, 4, 1, 3, None), ("c22", 9, 10, 1.0, 3, 2, 2, None)]
    assert [r.start for r in B.read_binary(spark, str(tmp_path / "a.sites"), chrom="c1", start=6, end=8).collect()] == [7]
    assert B.read_binary(spark, str(tmp_path / "a.sites"), chrom="zz").count() == 0
    assert sorted(r.start for r in B.read_binary(spark, str(tmp_path / "a.sites"), start=6, end=10).collect()) == [7, 9]
    pushed = B.read_binary(spark, str(tmp_path / "a.sites"))
    assert [r.start for r in pushed.where("chrom = 'c1' and start >= 6 and end <= 9").collect()] == [7] and [r.start for r in pushed.where("start = 9").collect()] == [9]
    one = B.Reader({"path": str(tmp_path / "a.sites")})
    list(one.pushFilters([B.EqualTo(("chrom",), "c22"), B.LessThan(("start",), 20)]))
    assert [len(p.blocks) for p in one.partitions()] == [1]
    binary_file(tmp_path / "b.sites", kind | B.ID, [(0, 5, 8, rec(5, 0.5, 8, 0, 1, "cellA") + rec(7, 0.25, 4, 1, 3, ""), 1, 0, 0, 2)])
    assert sorted((r.start, r.id) for r in B.read_binary(spark, str(tmp_path / "b.sites")).collect()) == [(5, "cellA"), (7, "")]
    binary_file(tmp_path / "c.bw", 4, [(0, 10, 30, struct.pack("<ff", 1.5, 2.5), 3, 5, 10, 2), (1, 1, 4, struct.pack("<If", 1, 9.0), 2, 3, 0, 1)], magic=B.BIGWIG)
    assert sorted((r.chrom, r.start, r.end, r.value) for r in B.read_binary(spark, str(tmp_path / "c.bw")).collect()) == [("c1", 10, 15, 1.5), ("c1", 20, 25, 2.5), ("c22", 1, 4, 9.0)]
    binary_file(tmp_path / "d.bb", 4, [(0, 1, 9, struct.pack("<III", 0, 1, 9) + b"geneA\t0\t+\0", 1, 0, 0, 1)], magic=B.BIGBED, zipped=False)
    assert [(r.start, r.end, r.id) for r in B.read_binary(spark, str(tmp_path / "d.bb")).collect()] == [(1, 9, "geneA\t0\t+")]
    assert [tuple(r) for r in B.chrom_table(spark, str(tmp_path / "a.sites")).collect()] == [(0, "c1", 1000), (1, "c22", 1000)]
    wide = B.read_binary(spark, str(tmp_path / "c.bw"), chrom="c1")
    assert sorted(r.pos for r in B.per_base(wide, 12, 22).collect()) == [12, 13, 14, 20, 21] and B.per_base(wide, 12, 22, fill=True).count() == 10
    (tmp_path / "x").write_bytes(b"\0" * 80)
    with pytest.raises(ValueError):
        B.Layout(str(tmp_path / "x"))
