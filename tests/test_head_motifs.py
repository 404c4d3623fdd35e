"""End motifs of reads: right for every row, and a large reference doesn't pass the driver."""

import random
import re
from collections import Counter

import pytest

from methloom.operators import reads as R
from methloom.sources import reads as src


def expected(rows, seq):
    out = Counter()
    for name, flag, _, pos, _, cigar, *_, bases, _, _ in rows:
        g, r, aligned = pos - 1, 0, []
        for n, op in re.findall(r"(\d+)([SMID])", cigar):
            for _ in range(int(n)):
                if op == "M":
                    aligned.append((g, bases[r]))
                g, r = g + (op in "MD"), r + (op in "MSI")
        first = pos - 1 if flag in (0, 99, 163) else g - 4
        four = [(at, b) for at, b in aligned if first <= at < first + 4]
        if len(four) == 4:
            u = ("T", "C") if flag in (0, 99, 147) else ("A", "G")  # hits 1 and 3
            out[name, "".join("U" if (b, seq[at]) == u else b for at, b in four), "".join(seq[at] for at, _ in four)] += 1
    return out


@pytest.mark.parametrize("chunk", [7, 50])
def test_every_row_has_its_motif(spark, chunk):
    """Clips, insertions and deletions near the ends, chunk edges, and rows that are repeated."""
    rnd = random.Random(5)
    seq, rows = "".join(rnd.choice("ACGT") for _ in range(333)), []
    for i in range(400):
        ops = [(rnd.choice([1, 2, 3, 4, 9]), rnd.choice("MMMSID")) for _ in range(rnd.randint(0, 3))] + [(rnd.randint(1, 30), "M")]
        rnd.shuffle(ops)
        span, length = (sum(n for n, op in ops if op in kinds) for kinds in ("MD", "MSI"))
        bases = "".join(rnd.choice("ACGT") for _ in range(length))
        rows.append((f"q{i}", rnd.choice([0, 16, 99, 147, 83, 163]), "c", rnd.randint(1, len(seq) - span + 1), 60, "".join(f"{n}{op}" for n, op in ops), "*", 0, 0, bases, "*", ""))
    rows += rows[:50]
    ref = src.chunked_reference(spark.createDataFrame([("c", seq)], "chrom string, seq string"), chunk)
    got = R.head_motifs(spark.createDataFrame(rows, src.SAM), ref, proper_pairs=False, chunk=chunk)
    assert Counter((r.qname, r.head4, r.ref4) for r in got.collect()) == expected(rows, seq)


def test_a_large_reference_is_not_broadcast(spark):
    """The optimizer takes a table made by a function for as small as what the function reads."""
    fa = spark.range(1).selectExpr("'c' AS chrom", "repeat('ACGTTGCAAC', 1000) AS seq")
    rows = [(f"q{i}", 16 * (i % 2), "c", 9 * i + 1, 60, "12M", "*", 0, 0, ("ACGTTGCAAC" * 3)[9 * i % 10 :][:12], "*", "") for i in range(1000)]
    reads = spark.createDataFrame(rows, src.SAM)
    large = R.head_motifs(reads, src.chunked_reference(fa, 4), proper_pairs=False, chunk=4)  # 2500 rows
    small = R.head_motifs(reads, src.chunked_reference(fa, 5000), proper_pairs=False, chunk=5000)
    joins = lambda df: re.findall(r"(\w+Join) \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    assert [kind for kind, keys in joins(large) if "chunk" in keys or "read_id" in keys] == ["SortMergeJoin"]
    assert [kind for kind, keys in joins(small) if "chunk" in keys or "read_id" in keys] == ["BroadcastHashJoin"]
    assert Counter(large.collect()) == Counter(small.collect()) and large.count() == 1000
