"""Readers of files by stretches: FASTA, FASTQ and BAM cut at any byte give what one reading of the whole gives."""

import gzip
import random
import struct
import zlib
from contextlib import contextmanager

import pytest
from test_sources import bam

from methloom.sources import bam as B
from methloom.sources import reads as src


@contextmanager
def stretches(spark, n):
    """Files are cut every ``n`` bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def test_fasta_by_stretches(spark, tmp_path):
    rnd = random.Random(1)
    seqs = {f"c{i}": "".join(rnd.choice("ACGTacgtN") for _ in range(rnd.choice([1, 7, 60, 61, 400]))) for i in range(12)}
    text = "".join(f">{n} note {n}\n" + "".join(s[i : i + 20] + "\n" for i in range(0, len(s), 20)) for n, s in seqs.items())
    (tmp_path / "g.fa").write_text(">empty\n" + text[: len(text) // 2] + text[len(text) // 2 :] + ">last\n")
    (tmp_path / "h.fa").write_text(">z\nAC\n\nG T\n")
    want = {n: s.upper() for n, s in seqs.items()} | {"z": "ACGT"}
    for size in (211, 1 << 20):
        with stretches(spark, size):
            pieces = src.fasta_pieces(spark, [str(tmp_path / "g.fa"), str(tmp_path / "h.fa")], piece=16)
            got = {}
            for r in sorted(pieces.collect(), key=lambda r: r.at):
                assert len(got.setdefault(r.chrom, "")) == r.at and len(r.seq) <= 16
                got[r.chrom] += r.seq
            assert got == want
            assert {r.chrom: r.seq for r in src.read_fasta(spark, str(tmp_path / "*.fa")).collect()} == want
            whole = spark.createDataFrame(list(want.items()), "chrom string, seq string")
            for chunk in (5,) if size < 1000 else (50,):
                key = lambda df: sorted(map(tuple, df.collect()))
                assert key(src.chunked_reference(pieces, chunk)) == key(src.chunked_reference(whole, chunk))
            assert sorted(map(tuple, src.base_counts(pieces).collect())) == sorted(map(tuple, src.base_counts(whole).collect()))
    assert sorted(r.value for r in src.length_lines(whole.where("chrom = 'z'"), 3).collect()) == ["z\t0\t3", "z\t3\t4"]
    assert [r.value for r in src.length_lines(whole.where("chrom = 'z'")).collect()] == ["z\t4"]


def test_fastq_by_stretches(spark, tmp_path):
    reads = [(f"r{i}", "ACGT"[i % 4] * (i % 9 + 1), "I" * (i % 9 + 1)) for i in range(50)]
    text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in reads)
    (tmp_path / "a.fq").write_text(text + "@cut\nAC\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(text.replace("@r", "@m").encode()))
    for size in (131, 1 << 20):
        with stretches(spark, size):
            got = src.fastq_records(spark, str(tmp_path / "a.fq")).orderBy("record").collect()
            assert [(r.record, r.name, r.seq, r.qual) for r in got] == [(i, *x) for i, x in enumerate(reads)]
            pairs = src.read_fastq_pairs(spark, str(tmp_path / "a.fq"), [str(tmp_path / "b.fq.gz")]).collect()
            assert sorted((r.name, r.seq, r.seq_2) for r in pairs) == sorted((n, s, s) for n, s, _ in reads)
    with pytest.raises(ValueError):
        src.read_fastq_pairs(spark, "a,b", "c")
    (tmp_path / "none.fq").write_text("")
    assert src.read_fastq(spark, str(tmp_path / "none.fq")).collect() == []


def bgzf(body, size):
    """``body`` in blocks of ``size`` bytes, whose edges records may cross, and the offset of each block."""
    out, at = b"", []
    for i in range(0, len(body) + size, size):
        part = body[i : i + size] if i < len(body) else b""
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = c.compress(part) + c.flush()
        at.append(len(out))
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
        if not part:
            break
    return out, at


def test_bam_by_ranges(spark, tmp_path):
    rnd = random.Random(5)
    recs = sorted(((f"q{i}", rnd.choice([0, 16]), rnd.randrange(2), rnd.randint(0, 900), [(n := rnd.randint(5, 40), "M")], "".join(rnd.choice("ACGT") for _ in range(n))) for i in range(400)), key=lambda r: (r[2], r[3]))
    body = gzip.decompress(bam(recs, ["c1", "c2"]))
    data, blocks = bgzf(body, 700)
    (tmp_path / "x.bam").write_bytes(data)
    want = sorted((q, f, ["c1", "c2"][r], p + 1, f"{ops[0][0]}M", s) for q, f, r, p, ops, s in recs)
    row = lambda r: (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq)
    for size in (1000, 5000, 1 << 26):
        df = B.read_bam(spark, str(tmp_path / "x.bam"), bytesPerTask=size)
        assert sorted(map(row, df.collect())) == want
        if size == 1000:
            assert df.rdd.getNumPartitions() > 5
    inside = lambda r, a, z: r[2] == "c2" and r[3] - 1 < z and r[3] - 1 + int(r[4][:-1]) > a
    region = dict(chrom="c2", start=300, end=500)
    assert sorted(map(row, B.read_bam(spark, str(tmp_path / "x.bam"), **region).collect())) == [r for r in want if inside(r, 300, 500)]
    # An index with all records of c2 in one stretch of its bin.
    place = lambda at: (blocks[at // 700] << 16) | at % 700
    at, starts = len(body), []
    b = B.Blocks(open(tmp_path / "x.bam", "rb"), 0)
    B.header(b.take)
    while b.need(4):
        starts.append(b.place())
        b.take(struct.unpack("<i", b.take(4))[0])
    assert len(starts) == len(recs) and len(set(starts)) == len(starts)
    first = next(i for i, r in enumerate(recs) if r[2] == 1)
    chunk = struct.pack("<IiQQ", 4681, 1, starts[first], place(at - 1) + 1)
    index = b"BAI\1" + struct.pack("<i", 2) + struct.pack("<ii", 0, 0) + struct.pack("<i", 1) + chunk + struct.pack("<iQ", 1, starts[first])
    (tmp_path / "x.bam.bai").write_bytes(index)
    parts = B.Reader({"path": str(tmp_path / "x.bam"), **{k: str(v) for k, v in region.items()}}).partitions()
    assert [(p.begin, p.exact) for p in parts] == [(starts[first], True)]
    assert sorted(map(row, B.read_bam(spark, str(tmp_path / "x.bam"), **region).collect())) == [r for r in want if inside(r, 300, 500)]
    assert B.read_bam(spark, str(tmp_path / "x.bam"), chrom="zz").collect() == []
    assert [tuple(r) for r in B.bam_dictionary(spark, str(tmp_path / "x.bam")).collect()] == [(0, "c1", 1000), (1, "c2", 1000)]


def test_bam_optional_fields():
    tags = b"NMC\x03" + b"XSi" + struct.pack("<i", -7) + b"YSZACGT\0" + b"XFf" + struct.pack("<f", 0.5) + b"XAAq" + b"XBBs" + struct.pack("<Ihh", 2, -1, 5)
    rec = struct.pack("<iiBBHHHiiii", 0, 4, 2, 60, 0, 1, 0, 3, -1, -1, 0) + b"q\0" + struct.pack("<I", 3 << 4) + b"\x12\x40" + b"\x1e\x1e\x1e" + tags
    assert B.decode(rec, ["c"]) == ("q", 0, "c", 5, 60, "3M", "*", 0, 0, "ACG", "???", "NM:i:3\tXS:i:-7\tYS:Z:ACGT\tXF:f:0.5\tXA:A:q\tXB:B:s,-1,5")


@pytest.fixture
def served(tmp_path):
    """A folder behind http with range requests; gives its address and the ranges asked for."""
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = tmp_path / self.path.lstrip("/")
            if not path.exists():
                return self.send_error(404)
            data = path.read_bytes()
            a, z = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append((a, z))
            part = data[a : z + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_remote_files_by_ranges(spark, tmp_path, served):
    from methloom.sources import binary, remote
    from test_sources import binary_file

    address, asked = served
    (tmp_path / "x").write_bytes(bytes(range(256)) * 40)
    f = remote.HttpRange(f"{address}/x", buffer=100)
    f.seek(300)
    assert f.read(10) == bytes(range(44, 54)) and f.read(20) == bytes(range(54, 74)) and len(asked) == 2
    assert f.seek(-3, 2) == 10237 and f.read() == b"\xfd\xfe\xff" and f.read(5) == b"" and remote.file_size(f"{address}/x") == 10240
    assert not remote.exists(f"{address}/none") and remote.exists(f"{address}/x") and remote.local_path("file:///a%20b") == "/a b"
    kind = binary.SITES | binary.END
    binary_file(tmp_path / "a.sites", kind, [(0, 5, 8, struct.pack("<IIf", 5, 6, 0.5) + struct.pack("<IIf", 7, 8, 0.25), 1, 0, 0, 2)])
    assert sorted(r.start for r in binary.read_binary(spark, f"{address}/a.sites").collect()) == [5, 7]
    data, _ = bgzf(gzip.decompress(bam([("q", 0, 0, 4, [(3, "M")], "ACG")], ["c1"])), 50)
    (tmp_path / "r.bam").write_bytes(data)
    assert [(r.qname, r.pos) for r in B.read_bam(spark, f"{address}/r.bam").collect()] == [("q", 5)]


def test_definition_of_bigbed_columns(spark, tmp_path):
    from methloom.sources import binary
    from test_sources import binary_file

    binary_file(tmp_path / "d.bb", 4, [(0, 1, 9, struct.pack("<III", 0, 1, 9) + b"geneA\t7\0", 1, 0, 0, 1)], magic=binary.BIGBED, zipped=False)
    assert binary.column_definition(str(tmp_path / "d.bb")) == ""
    raw = bytearray((tmp_path / "d.bb").read_bytes())
    raw[36:44] = struct.pack("<Q", len(raw))
    (tmp_path / "d.bb").write_bytes(bytes(raw) + b"table x (string name; uint score;)\0rest")
    assert binary.column_definition(str(tmp_path / "d.bb")) == "table x (string name; uint score;)"
    rows = binary.entry_columns(binary.read_binary(spark, str(tmp_path / "d.bb")), ["name", "score", "more"]).collect()
    assert [tuple(r) for r in rows] == [("c1", 1, 9, "geneA", "7", None)]
