"""Site, region and read tables built from the driver's generic tables, from integers only, with the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import ship, table
from methloom.sources.reads import SAM


def _rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount")
    cov = F.col("l_quantity").cast("int")
    return li.select(
        F.concat(F.lit("s"), (F.col("l_linenumber") % 4).cast("string")).alias("sample"), F.concat(F.lit("cell_"), F.col("l_suppkey").cast("string")).alias("cell"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"), F.col("l_partkey").cast("long").alias("start"), cov.alias("cov"),
        F.floor(F.round(F.col("l_discount") * 100).cast("int") * cov / F.lit(10.0)).cast("int").alias("m"),
    )


def _site(df: DataFrame, *keys: str) -> DataFrame:
    g = df.groupBy(*keys, "chrom", "start").agg(F.sum("cov").cast("int").alias("coverage"), F.sum("m").cast("long").alias("meth"))
    return g.withColumn("strand", (F.col("start") % 2).cast("byte")).withColumn("context", (F.col("start") % 3 + 1).cast("byte")).withColumn(
        "value", F.col("meth").cast("double") / F.col("coverage").cast("double")
    )


def sites(spark: SparkSession, d: str) -> DataFrame:
    """One row per (chrom, start), all samples pooled."""
    return _site(_rows(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per (sample, chrom, start); sample s0..s3."""
    return _site(_rows(spark, d), "sample")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return _site(_rows(spark, d).withColumn("id", F.col("cell")), "id")


def numbered_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumn("m", F.col("meth")).withColumn("sample", F.substring("sample", 2, 1).cast("int"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("region_id"), F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"),
        (k * 17).cast("long").alias("rs"), (k * 17 + F.col("s_nationkey") * 10 + 5).cast("long").alias("re"), (F.col("s_nationkey") % 2).cast("byte").alias("strand"), k.cast("int").alias("region_idx"),
    )


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.concat(F.lit("cell_"), F.col("s_suppkey").cast("string")).alias("cell_id"), F.concat(F.lit("g"), (F.col("s_nationkey") % 4).cast("string")).alias("group_label"), F.col("s_suppkey").alias("map_row")
    )


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).groupBy("chrom").agg((F.max("start") + 1).cast("long").alias("length"))


ROWS_SQL = """rw AS (SELECT CONCAT('s', CAST(l_linenumber % 4 AS VARCHAR)) AS sample, CONCAT('cell_', CAST(l_suppkey AS VARCHAR)) AS id,
  CONCAT('chr', CAST(l_suppkey % 5 + 1 AS VARCHAR)) AS chrom, CAST(l_partkey AS BIGINT) AS start, CAST(l_quantity AS INT) AS cov,
  CAST(FLOOR(CAST(ROUND(l_discount*100) AS INT) * CAST(l_quantity AS INT) / CAST(10.0 AS DOUBLE)) AS INT) AS m0 FROM lineitem)"""


def site_sql(name: str, *keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    return f"""{name} AS (SELECT *, CAST(meth AS DOUBLE) / CAST(coverage AS DOUBLE) AS value, start % 2 AS strand, start % 3 + 1 AS context
  FROM (SELECT {k}chrom, start, CAST(SUM(cov) AS INT) AS coverage, CAST(SUM(m0) AS BIGINT) AS meth FROM rw GROUP BY {k}chrom, start) x_{name})"""


SITES = f"{ROWS_SQL}, {site_sql('st')}"
SAMPLES = f"{ROWS_SQL}, {site_sql('sm', 'sample')}"
CELLS = f"{ROWS_SQL}, {site_sql('ce', 'id')}"
REGIONS = """rg AS (SELECT CONCAT('r', CAST(s_suppkey AS VARCHAR)) AS region_id, CONCAT('chr', CAST(s_suppkey % 5 + 1 AS VARCHAR)) AS chrom,
  CAST(s_suppkey*17 AS BIGINT) AS rs, CAST(s_suppkey*17 + s_nationkey*10 + 5 AS BIGINT) AS re, s_nationkey % 2 AS rstrand, CAST(s_suppkey AS INT) AS region_idx FROM supplier)"""
LENGTHS = "ln AS (SELECT chrom, MAX(start) + 1 AS length FROM st GROUP BY chrom)"


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item, so that many rows share cell, chrom and position."""
    r = _rows(spark, d)
    return r.select(F.col("cell").alias("id"), "chrom", "start", F.col("cov").alias("coverage"), F.col("m").cast("long").alias("meth"), (F.col("m").cast("double") / F.col("cov").cast("double")).alias("value"), (F.col("start") % 2).cast("byte").alias("strand"), (F.col("start") % 3 + 1).cast("byte").alias("context"))


RAW_CELLS = f"{ROWS_SQL}, rc AS (SELECT id, chrom, start, cov AS coverage, m0 AS meth, CAST(m0 AS DOUBLE) / CAST(cov AS DOUBLE) AS value, start % 2 AS strand, start % 3 + 1 AS context FROM rw)"


# -- reads over a synthetic genome whose length grows with the orders, so that the depth stays the same ---------------------

_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def genome_length(spark: SparkSession, d: str) -> int:
    return max(600, table(spark, d, "orders").count() * 4 // 25)


def _codes(i: np.ndarray, c: np.ndarray | int) -> np.ndarray:
    """The genome's base at i of chromosome c: a fixed polynomial of both."""
    return (i * i * 7 + i * 13 + i // 3 * 5 + i // 7 * 3 + i // 11 + c * 31) % 4


def genome(spark: SparkSession, d: str) -> DataFrame:
    """Five synthetic chromosomes (chrom, seq)."""
    n = genome_length(spark, d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"chrom": [f"chr{c}" for c in df["id"]], "seq": [bytes(_LETTERS[_codes(np.arange(n), int(c))]).decode() for c in df["id"]]})

    ship(spark)
    return spark.range(1, 6).mapInPandas(run, "chrom string, seq string")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of each order: a single read, or of every third order a proper pair whose mates overlap in part.

    Of k = o_orderkey: odd ones are of the minus class; a third of the cytosines of
    the class's strand is converted; every fourth triple of orders carries variants
    (C to T and G to A) where 13 divides the position; CIGARs are plain, clipped,
    with an insertion or a deletion; of 17 one is full of mismatches, of 19 one has
    a low quality, of 23 one is a marked duplicate.
    """
    n = genome_length(spark, d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            k0, c0 = df["o_orderkey"].to_numpy(np.int64), df["o_custkey"].to_numpy(np.int64) % 5 + 1
            two = np.flatnonzero(k0 % 3 == 0)
            of, r = np.concatenate([np.arange(len(k0)), two]), np.concatenate([np.zeros(len(k0), np.int64), np.ones(len(two), np.int64)])
            k, c = k0[of], c0[of]
            at, m, kind = k * 37 % (n - 110) + r * (k % 40), (k + 7 * r) % 20 + 30, (k + r) % 5
            read, i = np.repeat(np.arange(len(k)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            kk = k[read]
            p = at[read] + i + 3 * ((kind[read] == 3) & (i >= 10))
            g = _codes(p, c[read])
            v = np.where((p % 13 == 0) & (kk // 3 % 4 == 0), np.where(g == 1, 3, np.where(g == 2, 0, g)), g)
            minus = kk % 2 == 1
            turned = (p + kk) % 3 == 0
            b = np.where(turned & ~minus & (v == 1), 3, np.where(turned & minus & (v == 2), 0, v))
            b = np.where((kk % 17 == 0) & (i % 4 == 0), 3 - b, b)
            texts = [bytes(x).decode() for x in np.split(_LETTERS[b], np.cumsum(m)[:-1])]
            seq = ["AAA" + t if q == 1 else t[:10] + "AA" + t[10:] if q == 2 else t for t, q in zip(texts, kind)]
            cigar = [f"3S{a}M" if q == 1 else f"10M2I{a - 10}M" if q == 2 else f"10M3D{a - 10}M" if q == 3 else f"{a}M" for a, q in zip(m, kind)]
            paired = k % 3 == 0
            flag = np.where(paired, np.where(k % 2 == 0, np.where(r == 0, 99, 147), np.where(r == 0, 163, 83)), np.where(k % 2 == 0, 0, 16)) + 1024 * (k % 23 == 0)
            other = k * 37 % (n - 110) + (1 - r) * (k % 40) + 1
            yield pd.DataFrame({
                "qname": [f"q{x}_{y}" for x, y in zip(k, df["o_custkey"].to_numpy()[of])], "flag": flag, "rname": [f"chr{x}" for x in c], "pos": at + 1, "mapq": np.where(k % 19 == 0, 29, 60),
                "cigar": cigar, "rnext": np.where(paired, "=", "*"), "pnext": np.where(paired, other, 0), "tlen": np.where(paired, np.where(r == 0, 1, -1) * (k % 40 + 40), 0), "seq": seq, "qual": "*", "tags": "",
            })

    ship(spark)
    # The table is one small file and a row makes much work: spread its rows first.
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    return orders.mapInPandas(run, SAM)


def _base_sql(i: str, c: str) -> str:
    return f"SUBSTRING('ACGT', CAST((({i}) * ({i}) * 7 + ({i}) * 13 + ({i}) // 3 * 5 + ({i}) // 7 * 3 + ({i}) // 11 + {c} * 31) % 4 + 1 AS INT), 1)"


def _at_sql(k: int) -> str:
    return f"CASE WHEN p + {k} BETWEEN 0 AND gl - 1 THEN {_base_sql(f'p + {k}', 'c')} ELSE 'N' END"


GENOME_LENGTH = "gn AS (SELECT GREATEST(600, COUNT(*) * 4 // 25) AS gl FROM orders)"
#: rd: the reads; mb: their bases with the genome's; ok: reads that pass all filters; bs: bases of these that count; cx: cytosine calls.
READS = f"""{GENOME_LENGTH},
rd AS (SELECT o_orderkey AS k, r, CONCAT('q', CAST(o_orderkey AS VARCHAR), '_', CAST(o_custkey AS VARCHAR)) AS qname, o_custkey % 5 + 1 AS c, gl, o_orderkey * 37 % (gl - 110) + r * (o_orderkey % 40) AS at0,
  (o_orderkey + 7 * r) % 20 + 30 AS n, (o_orderkey + r) % 5 AS kind, o_orderkey % 2 AS minus, o_orderkey % 3 = 0 AS paired FROM orders, gn, UNNEST([0, 1]) u(r) WHERE r = 0 OR o_orderkey % 3 = 0),
b0 AS (SELECT *, at0 + i + CASE WHEN kind = 3 AND i >= 10 THEN 3 ELSE 0 END AS p FROM rd, UNNEST(RANGE(0, n)) v(i) WHERE k % 19 <> 0 AND k % 23 <> 0),
b1 AS (SELECT *, {_base_sql('p', 'c')} AS g FROM b0),
b2 AS (SELECT *, CASE WHEN p % 13 = 0 AND k // 3 % 4 = 0 THEN TRANSLATE(g, 'CG', 'TA') ELSE g END AS v FROM b1),
b3 AS (SELECT *, CASE WHEN (p + k) % 3 = 0 AND minus = 0 AND v = 'C' THEN 'T' WHEN (p + k) % 3 = 0 AND minus = 1 AND v = 'G' THEN 'A' ELSE v END AS w FROM b2),
mb AS (SELECT *, CASE WHEN k % 17 = 0 AND i % 4 = 0 THEN TRANSLATE(w, 'ACGT', 'TGCA') ELSE w END AS b FROM b3),
ok AS (SELECT k, r, qname, COUNT(CASE WHEN b <> g AND NOT (minus = 0 AND b = 'T' AND g = 'C') AND NOT (minus = 1 AND b = 'A' AND g = 'G') THEN 1 END) AS mm,
  MAX(n + CASE kind WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END) AS len, MAX(at0) AS at0, MAX(at0 + n + CASE WHEN kind = 3 THEN 3 ELSE 0 END) AS last FROM mb GROUP BY k, r, qname
  HAVING mm <= CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * len),
bs AS (SELECT mb.*, CONCAT('chr', CAST(mb.c AS VARCHAR)) AS chrom FROM mb JOIN ok ON ok.qname = mb.qname AND ok.r = mb.r LEFT JOIN ok l ON l.qname = mb.qname AND l.r = 0 AND mb.r = 1 AND mb.at0 > l.at0
  WHERE l.k IS NULL OR mb.p + 1 >= l.last + 1),
cy AS (SELECT *, CASE WHEN minus = 0 THEN b = 'C' ELSE b = 'G' END AS is_m, CASE WHEN minus = 0 THEN {_at_sql(1)} ELSE TRANSLATE({_at_sql(-1)}, 'ACGT', 'TGCA') END AS n1,
  CASE WHEN minus = 0 THEN {_at_sql(2)} ELSE TRANSLATE({_at_sql(-2)}, 'ACGT', 'TGCA') END AS n2 FROM bs WHERE (minus = 0 AND g = 'C' AND b IN ('C', 'T')) OR (minus = 1 AND g = 'G' AND b IN ('G', 'A'))),
cx AS (SELECT *, CASE WHEN n1 = 'G' THEN 'CG' WHEN n1 = 'N' THEN NULL WHEN n2 = 'G' THEN 'CHG' WHEN n2 = 'N' THEN NULL ELSE 'CHH' END AS context FROM cy)"""
#: sx: sites of either strand with calls and the bases of the other class.
SITES_FROM_READS = f"""{READS},
sq AS (SELECT chrom, p, MAX(c) AS c, MAX(gl) AS gl, g, COUNT(CASE WHEN minus = 0 AND b = 'C' THEN 1 END) AS pc, COUNT(CASE WHEN minus = 0 AND b = 'T' THEN 1 END) AS pt, COUNT(CASE WHEN minus = 0 AND b = 'G' THEN 1 END) AS pg,
  COUNT(CASE WHEN minus = 0 AND b = 'A' THEN 1 END) AS pa, COUNT(CASE WHEN minus = 1 AND b = 'C' THEN 1 END) AS nc, COUNT(CASE WHEN minus = 1 AND b = 'T' THEN 1 END) AS nt, COUNT(CASE WHEN minus = 1 AND b = 'G' THEN 1 END) AS ng,
  COUNT(CASE WHEN minus = 1 AND b = 'A' THEN 1 END) AS na FROM bs WHERE g IN ('C', 'G') GROUP BY chrom, p, g),
s5 AS (SELECT *, CONCAT({", ".join(_at_sql(x) for x in (-2, -1, 0, 1, 2))}) AS five FROM sq),
sy AS (SELECT chrom, p + 1 AS start, '+' AS strand, pc AS meth, pc + pt AS cov, nc AS rev_g, nc + nt AS rev_ga, five AS fivemer FROM s5 WHERE g = 'C'
  UNION ALL SELECT chrom, p + 1, '-', ng, ng + na, pg, pg + pa, REVERSE(TRANSLATE(five, 'ACGT', 'TGCA')) FROM s5 WHERE g = 'G'),
sz AS (SELECT *, CASE WHEN rev_ga > 20 AND rev_g > 0 THEN CAST(rev_g AS DOUBLE) / CAST(rev_ga AS DOUBLE) END AS share, CASE WHEN fivemer[4] = 'G' THEN 'CG' WHEN fivemer[4] = 'N' THEN NULL WHEN fivemer[5] = 'G' THEN 'CHG' WHEN fivemer[5] = 'N' THEN NULL ELSE 'CHH' END AS context
  FROM sy WHERE cov BETWEEN 4 AND 1000),
sx AS (SELECT *, CASE WHEN share IS NULL THEN CAST(meth AS DOUBLE) / CAST(cov AS DOUBLE) ELSE LEAST(CAST(meth AS DOUBLE) / (CAST(cov AS DOUBLE) * share), CAST(1 AS DOUBLE)) END AS level, CAST(cov AS DOUBLE) * share AS eff FROM sz)"""
