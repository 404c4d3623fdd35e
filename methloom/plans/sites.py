"""Queries of the site, region, cell and differential operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import table
from methloom.functions import sequence as seqf
from methloom.operators import analysis, cells, dmr, intervals, profile, regionstats
from methloom.operators import reads as readops
from methloom.operators import sites as ops
from methloom.plans import adapter as A
from methloom.schema import cover_c, decode_context, decode_strand
from methloom.sources.reads import base_counts, chunked_reference
from methloom.sources.text import bedgraph_lines, site_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(queries: dict, sqls: dict[str, str]):
    """A decorator that registers a query, with its SQL if there is one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = registered(QUERIES, SQL)


def r6(c):
    return F.round(c, 6)


_PLAIN = ("chrom", "start", "coverage", "meth")
_HIT = "JOIN rg ON rg.chrom = {t}.chrom AND {t}.start < rg.re AND {t}.start + 1 > rg.rs"
_ROLL = "SELECT *, 0 AS bucket FROM j UNION ALL SELECT *, context AS bucket FROM j WHERE context <> 0"
_J = f"j AS (SELECT rg.region_id, rg.rs, rg.re, st.* FROM st {_HIT.format(t='st')})"


# -- projections and filters -------------------------------------------------------------------------------------------


@query(f"WITH {A.SITES}, {A.REGIONS} SELECT chrom, start, coverage, meth FROM st WHERE EXISTS (SELECT 1 FROM rg WHERE rg.chrom = st.chrom AND st.start < rg.re + 1 AND st.start + 1 > rg.rs)")
def view_region(spark: SparkSession, d: str) -> DataFrame:
    return ops.view(A.sites(spark, d), regions=A.regions(spark, d)).select(*_PLAIN)


@query(f"WITH {A.SITES}, {A.REGIONS} SELECT chrom, start, coverage, meth FROM st WHERE EXISTS (SELECT 1 FROM rg WHERE rg.chrom = st.chrom AND rg.rstrand = st.strand AND st.start < rg.re + 1 AND st.start + 1 > rg.rs)")
def view_region_strand(spark: SparkSession, d: str) -> DataFrame:
    return ops.view(A.sites(spark, d), regions=A.regions(spark, d), use_region_strand=True).select(*_PLAIN)


@query(f"WITH {A.SITES} SELECT chrom, start, coverage, meth FROM st WHERE chrom = 'chr2' AND coverage BETWEEN 5 AND 10000 AND strand = 1 AND context = 2")
def view_filters(spark: SparkSession, d: str) -> DataFrame:
    return ops.view(A.sites(spark, d), chrom="chr2", strand=1, context=2, min_cover=5).select(*_PLAIN)


@query(f"WITH {A.SITES} SELECT chrom, start, coverage, meth FROM st WHERE start < 301 AND start + 1 > 200")
def interval_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return ops.in_interval(A.sites(spark, d), 200, 300, inclusive=True).select(*_PLAIN)


@query(
    f"WITH {A.SITES} SELECT chrom, start, CASE strand WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand_name, CASE context WHEN 0 THEN 'C' WHEN 1 THEN 'CG' WHEN 2 THEN 'CHG' ELSE 'CHH' END AS context_name, "
    "CASE WHEN value >= 0.8 THEN 'M' WHEN value >= 0.6 THEN 'Mh' WHEN value >= 0.4 THEN 'H' WHEN value >= 0.2 THEN 'hU' ELSE 'U' END AS category, CAST(FLOOR(value * coverage + 0.5) AS BIGINT) AS cover_c FROM st"
)
def meth_category(spark: SparkSession, d: str) -> DataFrame:
    s = A.sites(spark, d)
    return s.select("chrom", "start", decode_strand(F.col("strand")).alias("strand_name"), decode_context(F.col("context")).alias("context_name"), seqf.level_category(F.col("value")).alias("category"), cover_c(F.col("value"), F.col("coverage")).alias("cover_c"))


@query(
    "SELECT p_partkey, REVERSE(TRANSLATE(dna, 'ACGT', 'TGCA')) AS revcomp, TRANSLATE(dna, 'C', 'T') AS c2t, TRANSLATE(dna, 'G', 'A') AS g2a FROM "
    "(SELECT p_partkey, TRANSLATE(SUBSTRING(p_name, 1, 40), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACN') AS dna FROM part) x"
)
def rev_complement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.translate(F.substring("p_name", 1, 40), "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACN").alias("dna"))
    return p.select("p_partkey", seqf.reverse_complement(F.col("dna")).alias("revcomp"), seqf.c_to_t(F.col("dna")).alias("c2t"), seqf.g_to_a(F.col("dna")).alias("g2a"))


# -- regions -----------------------------------------------------------------------------------------------------------


def _stats_sql(level: str, having: str = "", extra: str = "") -> str:
    return f"WITH {A.SITES}, {A.REGIONS}, {_J}{extra} SELECT region_id, CAST(bucket AS INT) AS context, {level}, COUNT(*) AS n_sites FROM ({_ROLL}) q {having} GROUP BY region_id, bucket"


@query(_stats_sql("CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level", "WHERE region_id IN (SELECT region_id FROM j GROUP BY region_id HAVING COUNT(*) >= 2)"))
def regionstats_weighted(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), "weighted", min_sites=2)


@query(_stats_sql("ROUND(AVG(value), 6) AS level"))
def regionstats_mean(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), "mean").withColumn("level", r6("level"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_J} SELECT region_id, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS BIGINT) AS meth_count, CAST(SUM(coverage) AS BIGINT) AS coverage FROM ({_ROLL}) q GROUP BY region_id, bucket")
def regionstats_counts(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), "counts")


@query(
    f"WITH {A.SITES}, {A.REGIONS}, {_J} SELECT region_id, CAST(strand AS INT) AS strand, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level, COUNT(*) AS n_sites FROM ({_ROLL}) q GROUP BY region_id, strand, bucket"
)
def regionstats_both_strands(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), strand=3).withColumn("strand", F.col("strand").cast("int"))


@query(f"WITH {A.SITES} SELECT chrom, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS BIGINT) AS meth_count, CAST(SUM(coverage) AS BIGINT) AS coverage FROM (SELECT *, 0 AS bucket FROM st UNION ALL SELECT *, context FROM st) q GROUP BY chrom, bucket")
def context_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = regionstats.rollup(A.sites(spark, d), ["chrom"])
    return s.select("chrom", "context", F.col("m").cast("long").alias("meth_count"), F.col("c").cast("long").alias("coverage"))


@query(_stats_sql("ROUND(COALESCE(STDDEV_SAMP(value), 0), 6) AS level"))
def region_dev(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), "dev").withColumn("level", r6("level"))


@query(
    f"WITH {A.SITES}, {A.REGIONS}, {_J} SELECT region_id, MIN(value) AS min_level, MAX(value) AS max_level, ROUND(SUM(value), 6) AS sum_level, CAST(COUNT(*) AS DOUBLE) / CAST(MAX(re - rs) AS DOUBLE) AS covered FROM j GROUP BY region_id"
)
def region_minmax(spark: SparkSession, d: str) -> DataFrame:
    s, r = A.sites(spark, d), A.regions(spark, d)
    j = intervals.range_join(s, r.select("region_id", "chrom", "rs", "re")).withColumn("_len", (F.col("re") - F.col("rs")).cast("double"))
    x = regionstats.rollup(j, ["region_id", "_len"], context=0)
    return x.select("region_id", F.col("lo").alias("min_level"), F.col("hi").alias("max_level"), r6("sv").alias("sum_level"), (F.col("sw").cast("double") / F.col("_len")).alias("covered"))


@query(
    f"""WITH {A.SITES}, {A.LENGTHS}, w AS (SELECT st.*, k * 50 AS rs, LEAST(k * 50 + 100, ln.length) AS re FROM st JOIN ln ON ln.chrom = st.chrom,
  UNNEST([start // 50, start // 50 - 1]) u(k) WHERE k >= 0 AND start < k * 50 + 100)
SELECT chrom, rs, re, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level, COUNT(*) AS n_sites
FROM (SELECT *, 0 AS bucket FROM w UNION ALL SELECT *, context FROM w) q GROUP BY chrom, rs, re, bucket"""
)
def chromstats(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.chrom_stats(A.sites(spark, d), A.lengths(spark, d), step=100, move=50)


@query(
    f"""WITH {A.SITES}, {A.REGIONS}, p AS (SELECT region_id, chrom, 'up' AS part, GREATEST(rs - 50, 0) AS rs, rs AS re FROM rg UNION ALL SELECT region_id, chrom, 'body', rs, re FROM rg UNION ALL SELECT region_id, chrom, 'down', re, re + 50 FROM rg),
j AS (SELECT p.region_id, p.part, st.* FROM st JOIN p ON p.chrom = st.chrom AND st.start < p.re AND st.start + 1 > p.rs)
SELECT region_id, part, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level, COUNT(*) AS n_sites FROM ({_ROLL}) q GROUP BY region_id, part, bucket"""
)
def bodystats(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.body_stats(A.sites(spark, d), A.regions(spark, d), extend=50)


@query(f"WITH {A.SITES} SELECT chrom, CAST(strand AS INT) AS strand, CAST(bucket AS INT) AS context, ROUND(AVG(value), 6) AS level, COUNT(*) AS n_sites FROM (SELECT *, 0 AS bucket FROM st UNION ALL SELECT *, context FROM st) q GROUP BY chrom, strand, bucket")
def chrmeth(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.chrom_levels(A.sites(spark, d)).withColumn("strand", F.col("strand").cast("int")).withColumn("level", r6("level"))


@query(f"WITH {A.SITES} SELECT 'chr1' AS chrom, ROUND(AVG(v), 6) AS level FROM (SELECT strand, AVG(value) AS v FROM st WHERE chrom = 'chr1' GROUP BY strand) q")
def ebsrate_chr(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.control_level(A.sites(spark, d), "chr1").withColumn("level", r6("level"))


@query(
    f"""WITH {A.SITES}, per AS (SELECT chrom, strand, AVG(value) AS v FROM st WHERE context = 3 GROUP BY chrom, strand), pool AS (SELECT chrom, AVG(value) AS v FROM st WHERE context = 3 GROUP BY chrom)
SELECT CAST(strand AS INT) AS strand, ROUND(AVG(v), 6) AS level FROM per GROUP BY strand UNION ALL SELECT 2, ROUND(AVG(v), 6) FROM pool"""
)
def ebsrate_chh(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.context_level(A.sites(spark, d), 3).withColumn("level", r6("level"))


@query(
    f"""WITH {A.SITES}, b AS (SELECT CASE WHEN coverage < 1 OR coverage > 16 THEN 16 ELSE coverage END AS b, COUNT(*) AS n FROM st GROUP BY 1)
SELECT CAST(k AS INT) AS min_coverage, CAST(COALESCE((SELECT SUM(n) FROM b WHERE b.b >= k), 0) AS BIGINT) AS n_sites,
  100 * CAST(COALESCE((SELECT SUM(n) FROM b WHERE b.b >= k), 0) AS DOUBLE) / CAST((SELECT COUNT(*) FROM st) AS DOUBLE) AS percent FROM (SELECT UNNEST(RANGE(1, 17)) AS k) q"""
)
def stats_coverage_hist(spark: SparkSession, d: str) -> DataFrame:
    return ops.coverage_histogram(A.sites(spark, d))


@query(f"WITH {A.SITES} SELECT CAST(CASE WHEN value = 0 THEN -1 ELSE GREATEST(FLOOR(value * 10 - CAST(0.0001 AS DOUBLE) / 10), 0) END AS INT) AS bin, COUNT(*) AS n_sites FROM st GROUP BY 1")
def stats_meth_hist(spark: SparkSession, d: str) -> DataFrame:
    return ops.level_histogram(A.sites(spark, d))


@query(f"WITH {A.SITES} SELECT COUNT(*) AS n_bases, MIN(value) AS min_value, MAX(value) AS max_value, ROUND(SUM(value), 6) AS sum_value, ROUND(SUM(value * value), 6) AS sum_squares FROM st")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ops.summary(A.sites(spark, d))
    return s.withColumn("sum_value", r6("sum_value")).withColumn("sum_squares", r6("sum_squares"))


@query(f"WITH {A.SITES}, {A.LENGTHS} SELECT ln.chrom, ln.length, COUNT(*) AS n_sites, MIN(start) AS first_pos, MAX(start) AS last_pos, 'coverage,strand,context' AS columns FROM ln JOIN st ON ln.chrom = st.chrom GROUP BY ln.chrom, ln.length")
def view_header(spark: SparkSession, d: str) -> DataFrame:
    return ops.header(A.sites(spark, d), A.lengths(spark, d))


@query(f"WITH {A.SITES} SELECT chrom, start - start % 64 AS win_start, COUNT(*) AS n, MIN(value) AS min_value, MAX(value) AS max_value, ROUND(SUM(value), 6) AS sum_value, ROUND(SUM(value * value), 6) AS sum_squares FROM st GROUP BY chrom, start - start % 64")
def zoom_windows(spark: SparkSession, d: str) -> DataFrame:
    z = ops.rezoom(ops.zoom(A.sites(spark, d), 16), 64)
    return z.withColumn("sum_value", r6("sum_value")).withColumn("sum_squares", r6("sum_squares"))


# -- joins, merges, set operations ---------------------------------------------------------------------------------------


@query(f"WITH {A.SAMPLES} SELECT a.chrom, a.start, CAST(a.context AS INT) AS context, CAST(a.strand AS INT) AS strand, a.value AS value_1, CAST(a.coverage AS INT) AS coverage_1, b.value AS value_2, CAST(b.coverage AS INT) AS coverage_2 FROM sm a JOIN sm b ON a.chrom = b.chrom AND a.start = b.start WHERE a.sample = 's1' AND b.sample = 's2'")
def overlap_two(spark: SparkSession, d: str) -> DataFrame:
    s = A.samples(spark, d)
    o = ops.overlap_two(s.where("sample = 's1'"), s.where("sample = 's2'"))
    return o.withColumn("context", F.col("context").cast("int")).withColumn("strand", F.col("strand").cast("int"))


@query(f"WITH {A.SAMPLES} SELECT chrom, start, MAX(CASE WHEN sample = 's0' THEN meth END) AS m0, CAST(MAX(CASE WHEN sample = 's0' THEN coverage END) AS BIGINT) AS c0, MAX(CASE WHEN sample = 's3' THEN meth END) AS m3, CAST(MAX(CASE WHEN sample = 's3' THEN coverage END) AS BIGINT) AS c3 FROM sm GROUP BY chrom, start HAVING COUNT(*) = 4")
def overlap_multi(spark: SparkSession, d: str) -> DataFrame:
    o = ops.overlap_many(A.numbered_samples(spark, d), 4)
    at = lambda i, f: F.get("counts", F.lit(i))[f].cast("long")
    return o.select("chrom", "start", at(0, "m").alias("m0"), at(0, "coverage").alias("c0"), at(3, "m").alias("m3"), at(3, "coverage").alias("c3"))


def _merge_sql(level: str) -> str:
    return f"WITH {A.SAMPLES} SELECT chrom, start, CAST(MIN(strand) AS INT) AS strand, CAST(MIN(context) AS INT) AS context, {level} AS value, CAST(SUM(coverage) AS BIGINT) AS coverage, COUNT(*) AS n_samples FROM sm GROUP BY chrom, start"


def _merged(spark: SparkSession, d: str, method: str) -> DataFrame:
    m = ops.merge(A.numbered_samples(spark, d), method)
    return m.withColumn("strand", F.col("strand").cast("int")).withColumn("context", F.col("context").cast("int"))


@query(_merge_sql("CASE WHEN COUNT(*) = 1 THEN MAX(value) ELSE CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) END"))
def merge_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "weighted")


@query(_merge_sql("ROUND(AVG(value), 6)"))
def merge_mean(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "mean").withColumn("value", r6("value"))


@query(
    f"WITH {A.SITES}, {A.REGIONS}, {_J}, f AS (SELECT j.chrom, j.start, MIN(CAST(SUBSTRING(region_id, 2) AS INT)) AS region_idx FROM j GROUP BY j.chrom, j.start) SELECT chrom, start, region_idx FROM f"
)
def first_region(spark: SparkSession, d: str) -> DataFrame:
    return intervals.first_match(A.sites(spark, d), A.regions(spark, d).select("chrom", "rs", "re", "region_idx"), "region_idx").select("chrom", "start", "region_idx")


# -- profiles ------------------------------------------------------------------------------------------------------------

_STEP = 0.2


def _bins_sql(mode: str) -> str:
    n = profile.bin_count(_STEP / 2 if mode == "across" else _STEP / 4)
    mv = "CAST(0.1 AS DOUBLE)" if mode == "across" else "CAST(0.05 AS DOUBLE)"
    if mode == "across":
        total = 3 * n
        parts = f"""SELECT region_id, chrom, rstrand, GREATEST(rs - 60, 0) AS s, rs AS e, 0 AS f FROM rg WHERE re - rs >= {n} UNION ALL SELECT region_id, chrom, rstrand, rs, re, {n} FROM rg WHERE re - rs >= {n}
  UNION ALL SELECT region_id, chrom, rstrand, re, re + 60, {2 * n} FROM rg WHERE re - rs >= {n}"""
    else:
        total = n
        at = {"center": "(rs + re) // 2", "tss": "CASE WHEN rstrand = 1 THEN re ELSE rs END", "tts": "CASE WHEN rstrand = 1 THEN rs ELSE re END"}[mode]
        parts = f"SELECT region_id, chrom, rstrand, GREATEST({at} - 60, 0) AS s, {at} + 60 AS e, 0 AS f FROM rg"
    return f"""pp AS (SELECT *, CAST(FLOOR(CAST(e - s AS DOUBLE) * {mv}) AS BIGINT) AS mv FROM ({parts}) p0),
bn AS (SELECT region_id, chrom, CASE WHEN rstrand = 1 THEN {total - 1} - (f + i) ELSE f + i END AS bin, s + i * mv AS rs, s + i * mv + 2 * mv AS re FROM pp, UNNEST(RANGE(0, {n})) u(i) WHERE mv > 0),
j AS (SELECT bn.region_id, bn.bin, st.* FROM st JOIN bn ON bn.chrom = st.chrom AND st.start < bn.re AND st.start + 1 > bn.rs),
pf AS (SELECT region_id, CAST(bin AS INT) AS bin, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level FROM ({_ROLL}) q GROUP BY region_id, bin, bucket HAVING SUM(coverage) > 0)"""


def _profile(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return profile.profile(A.sites(spark, d), profile.profile_bins(A.regions(spark, d), mode, extend=60, step=_STEP))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('across')} SELECT * FROM pf")
def profile_across(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "across").withColumn("bin", F.col("bin").cast("int"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('center')} SELECT * FROM pf")
def profile_center(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "center").withColumn("bin", F.col("bin").cast("int"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('tss')} SELECT * FROM pf")
def profile_tss(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "tss").withColumn("bin", F.col("bin").cast("int"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('tts')} SELECT * FROM pf")
def profile_tts(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "tts").withColumn("bin", F.col("bin").cast("int"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('across')} SELECT context, bin, ROUND(AVG(level), 6) AS level, COUNT(*) AS n_regions FROM pf GROUP BY context, bin")
def profile_aver(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_average(_profile(spark, d, "across")).withColumn("bin", F.col("bin").cast("int")).withColumn("level", r6("level"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {_bins_sql('across')} SELECT region_id, context, CAST(bin // 5 AS INT) AS block, ROUND(AVG(level), 6) AS level FROM pf GROUP BY region_id, context, bin // 5")
def matrix_regroup(spark: SparkSession, d: str) -> DataFrame:
    return profile.matrix_blocks(_profile(spark, d, "across"), 5).withColumn("level", r6("level"))


# -- single cells --------------------------------------------------------------------------------------------------------

_CELL = "COUNT(*) AS n_sites, CAST(SUM(coverage) AS BIGINT) AS total_coverage"
_LEVEL = "ROUND(SUM(value * coverage) / SUM(coverage), 6) AS mean_meth"


@query(f"WITH {A.CELLS} SELECT id, {_CELL}, CAST(SUM(coverage) AS DOUBLE) / COUNT(*) AS mean_coverage, {_LEVEL} FROM ce WHERE coverage >= 1 GROUP BY id")
def sc_qc_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.cell_qc(A.cells(spark, d)).withColumn("mean_meth", r6("mean_meth"))


@query(
    f"WITH {A.CELLS}, {A.site_sql('st')}, {A.LENGTHS} SELECT id, CONCAT(ce.chrom, ':', CAST(ce.start - ce.start % 500 AS VARCHAR), '-', CAST(LEAST(ce.start - ce.start % 500 + 500, ln.length) AS VARCHAR)) AS region_id, {_CELL}, {_LEVEL} "
    "FROM ce JOIN ln ON ln.chrom = ce.chrom WHERE coverage >= 1 GROUP BY 1, 2"
)
def sc_matrix_bins(spark: SparkSession, d: str) -> DataFrame:
    m = cells.cell_matrix(cells.placed_in_bins(A.cells(spark, d), A.lengths(spark, d), 500))
    return m.select("id", "region_id", "n_sites", "total_coverage", r6("mean_meth").alias("mean_meth"))


_FIRST = f"pl AS (SELECT ce.id, ce.chrom, ce.start, ce.coverage, ce.value, MIN(rg.region_idx) AS k FROM ce {_HIT.format(t='ce')} GROUP BY 1, 2, 3, 4, 5)"


@query(f"WITH {A.CELLS}, {A.REGIONS}, {_FIRST} SELECT id, CONCAT('r', CAST(k AS VARCHAR)) AS region_id, {_CELL}, {_LEVEL} FROM pl WHERE coverage >= 1 GROUP BY 1, 2")
def sc_matrix_first_match(spark: SparkSession, d: str) -> DataFrame:
    m = cells.cell_matrix(cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d)))
    return m.select("id", "region_id", "n_sites", "total_coverage", r6("mean_meth").alias("mean_meth"))


@query(
    f"WITH {A.CELLS}, {A.REGIONS}, {_FIRST}, gm AS (SELECT CONCAT('cell_', CAST(s_suppkey AS VARCHAR)) AS id, CONCAT('g', CAST(s_nationkey % 4 AS VARCHAR)) AS grp FROM supplier) "
    f"SELECT grp, CONCAT('r', CAST(k AS VARCHAR)) AS region_id, COUNT(DISTINCT pl.id) AS n_cells, {_CELL}, CAST(SUM(coverage) AS DOUBLE) / COUNT(*) AS mean_coverage, {_LEVEL} FROM pl JOIN gm ON gm.id = pl.id WHERE coverage >= 1 GROUP BY 1, 2"
)
def sc_aggregate(spark: SparkSession, d: str) -> DataFrame:
    placed = cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d))
    return cells.group_aggregate(placed, cells.group_map(A.groups(spark, d), "map_row")).withColumn("mean_meth", r6("mean_meth"))


# -- differential --------------------------------------------------------------------------------------------------------

_GC = """gc AS (SELECT chrom, start, CAST(SUM(CASE WHEN sample IN ('s0', 's1') THEN meth ELSE 0 END) AS BIGINT) AS m1, CAST(SUM(CASE WHEN sample IN ('s0', 's1') THEN coverage ELSE 0 END) AS BIGINT) AS c1,
  CAST(SUM(CASE WHEN sample IN ('s2', 's3') THEN meth ELSE 0 END) AS BIGINT) AS m2, CAST(SUM(CASE WHEN sample IN ('s2', 's3') THEN coverage ELSE 0 END) AS BIGINT) AS c2,
  COUNT(CASE WHEN sample IN ('s0', 's1') THEN 1 END) AS n1, COUNT(CASE WHEN sample IN ('s2', 's3') THEN 1 END) AS n2 FROM sm GROUP BY chrom, start HAVING n1 > 0 AND n2 > 0),
cd AS (SELECT *, CAST(m1 AS DOUBLE) / CAST(c1 AS DOUBLE) - CAST(m2 AS DOUBLE) / CAST(c2 AS DOUBLE) AS diff FROM gc),
lf AS (SELECT n, LGAMMA(n + 1) AS v FROM (SELECT UNNEST(RANGE(0, 20000)) AS n) q)"""
_FISHER = """ks AS (SELECT *, m1 + m2 AS fm, c1 + c2 AS fn, m1 + c1 AS fk FROM cd WHERE ABS(diff) >= CAST(0.25 AS DOUBLE)),
tb AS (SELECT DISTINCT m1, c1, m2, c2, fm, fn, fk FROM ks),
ex AS (SELECT tb.*, UNNEST(RANGE(GREATEST(0, fk - fn), LEAST(fk, fm) + 1)) AS i FROM tb),
lp AS (SELECT ex.*, LGAMMA(fm + 1) + LGAMMA(fn + 1) - LGAMMA(fm + fn + 1) + LGAMMA(fk + 1) + LGAMMA(fm + fn - fk + 1) - LGAMMA(i + 1) - LGAMMA(fm - i + 1) - LGAMMA(fk - i + 1) - LGAMMA(fn - fk + i + 1) AS l FROM ex),
ob AS (SELECT m1, c1, m2, c2, l AS o FROM lp WHERE i = m1),
pv AS (SELECT lp.m1, lp.c1, lp.m2, lp.c2, LEAST(SUM(CASE WHEN l <= o + 1e-9 THEN EXP(l) ELSE 0 END), 1) AS p FROM lp JOIN ob USING (m1, c1, m2, c2) GROUP BY 1, 2, 3, 4),
fs AS (SELECT ks.chrom, ks.start, ks.m1, ks.c1, ks.m2, ks.c2, ks.diff, pv.p FROM ks JOIN pv USING (m1, c1, m2, c2))"""


def _counts(spark: SparkSession, d: str, relaxed: bool = True) -> DataFrame:
    s = A.numbered_samples(spark, d)
    return ops.group_counts(s, F.when(F.col("sample") < 2, 1).otherwise(2), 2, 2, relaxed)


@query(f"WITH {A.SAMPLES}, {_GC} SELECT chrom, start, m1, c1, m2, c2, diff FROM cd WHERE n1 = 2 AND n2 = 2")
def dmr_group_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _counts(spark, d, relaxed=False)
    return c.select("chrom", "start", "m1", "c1", "m2", "c2", dmr.level_difference().alias("diff"))


@query(f"WITH {A.SAMPLES}, {_GC}, {_FISHER} SELECT chrom, start, m1, c1, m2, c2, ROUND(p, 6) AS p_value FROM fs")
def dmc_fisher(spark: SparkSession, d: str) -> DataFrame:
    return dmr.fisher_sites(_counts(spark, d)).select("chrom", "start", "m1", "c1", "m2", "c2", r6("p_value").alias("p_value"))


_BH = """sv AS (SELECT *, COUNT(*) OVER () AS mm, RANK() OVER (ORDER BY pr) AS rk, COUNT(*) OVER (PARTITION BY pr) AS tie FROM (SELECT *, ROUND(p, 8) AS pr FROM fs) z WHERE pr <= CAST(0.05 AS DOUBLE)),
ad AS (SELECT *, LEAST(MIN(CAST(mm AS DOUBLE) * pr / (rk + tie - 1)) OVER (ORDER BY pr DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adj FROM sv)"""


def _adjusted(spark: SparkSession, d: str) -> DataFrame:
    p = dmr.fisher_sites(_counts(spark, d)).withColumn("p_value", F.round("p_value", 8))
    return dmr.adjust(p, 0.05)


@query(f"WITH {A.SAMPLES}, {_GC}, {_FISHER}, {_BH} SELECT chrom, start, pr AS p_value, ROUND(adj, 6) AS adj_p FROM ad")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _adjusted(spark, d).select("chrom", "start", "p_value", r6("adj_p").alias("adj_p"))


@query(
    f"""WITH {A.SAMPLES}, {_GC}, {_FISHER}, {_BH},
g AS (SELECT *, CASE WHEN start - LAG(start) OVER (PARTITION BY chrom ORDER BY start) <= 60 THEN 0 ELSE 1 END AS nw FROM ad),
il AS (SELECT *, SUM(nw) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT chrom, MIN(start) AS start, MAX(start) AS "end", CAST(SUM(m1) AS DOUBLE) / CAST(SUM(c1) AS DOUBLE) AS level_1, CAST(SUM(m2) AS DOUBLE) / CAST(SUM(c2) AS DOUBLE) AS level_2, COUNT(*) AS n_sites,
  COUNT(CASE WHEN diff > 0 THEN 1 END) AS hyper, COUNT(CASE WHEN diff < 0 THEN 1 END) AS hypo FROM il GROUP BY chrom, island HAVING COUNT(*) >= 2"""
)
def dmr_islands(spark: SparkSession, d: str) -> DataFrame:
    return dmr.call_regions(_adjusted(spark, d), min_sites=2, gap=60)


@query(
    f"""WITH RECURSIVE {A.SAMPLES}, {_GC}, {_FISHER}, {_BH},
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY start) AS k FROM ad),
wk AS (SELECT chrom, k, start, start AS b, 1 AS piece FROM o WHERE k = 1
  UNION ALL SELECT o.chrom, o.k, o.start, CASE WHEN o.start - wk.start > 60 OR o.start - wk.b > 150 THEN o.start ELSE wk.b END, wk.piece + CASE WHEN o.start - wk.start > 60 OR o.start - wk.b > 150 THEN 1 ELSE 0 END
  FROM wk JOIN o ON o.chrom = wk.chrom AND o.k = wk.k + 1)
SELECT o.chrom, MIN(o.start) AS start, MAX(o.start) AS "end", CAST(SUM(m1) AS DOUBLE) / CAST(SUM(c1) AS DOUBLE) AS level_1, CAST(SUM(m2) AS DOUBLE) / CAST(SUM(c2) AS DOUBLE) AS level_2, COUNT(*) AS n_sites,
  COUNT(CASE WHEN diff > 0 THEN 1 END) AS hyper, COUNT(CASE WHEN diff < 0 THEN 1 END) AS hypo FROM o JOIN wk ON wk.chrom = o.chrom AND wk.k = o.k GROUP BY o.chrom, piece HAVING COUNT(*) >= 2"""
)
def dmr_max_span(spark: SparkSession, d: str) -> DataFrame:
    return dmr.call_regions(_adjusted(spark, d), min_sites=2, gap=60, max_span=150)


@query()
def dmc_betabinomial(spark: SparkSession, d: str) -> DataFrame:
    return dmr.lrt_sites(_counts(spark, d)).select("chrom", "start", "m1", "c1", "m2", "c2", "complete", r6("p_value").alias("p_value"))


# -- matrices ------------------------------------------------------------------------------------------------------------

_MX = "mx AS (SELECT chrom, start, MAX(CASE WHEN sample = 's0' THEN value END) AS v0, MAX(CASE WHEN sample = 's1' THEN value END) AS v1, MAX(CASE WHEN sample = 's2' THEN value END) AS v2, MAX(CASE WHEN sample = 's3' THEN value END) AS v3 FROM sm GROUP BY chrom, start HAVING COUNT(*) = 4)"
_COLS = ["v0", "v1", "v2", "v3"]


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    s = A.numbered_samples(spark, d)
    m = s.groupBy("chrom", "start").agg(*(F.max(F.when(F.col("sample") == i, F.col("value"))).alias(c) for i, c in enumerate(_COLS)))
    return analysis.present_everywhere(m, _COLS)


def _corr_sql(expr: str) -> str:
    pairs = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS sample_a, '{b}' AS sample_b, ROUND({expr.format(a=a, b=b)}, 6) AS r FROM mr" for a, b in pairs)


@query(f"WITH {A.SAMPLES}, {_MX}, mr AS (SELECT * FROM mx) {_corr_sql('CORR({a}, {b})')}")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return analysis.pearson(_matrix(spark, d), _COLS).withColumn("r", r6("r"))


@query(f"WITH {A.SAMPLES}, {_MX}, mr AS (SELECT " + ", ".join(f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in _COLS) + f" FROM mx) {_corr_sql('CORR({a}, {b})')}")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return analysis.spearman(_matrix(spark, d), _COLS).withColumn("r", r6("r"))


@query(f"WITH {A.SAMPLES}, {_MX} SELECT chrom, start, (v0 + v1 + v2 + v3) / 4 AS row_stat FROM mx WHERE NOT (v0 = 0 AND v1 = 0 AND v2 = 0 AND v3 = 0)")
def sort_rows(spark: SparkSession, d: str) -> DataFrame:
    m = analysis.drop_flat_rows(_matrix(spark, d), _COLS)
    return analysis.sort_rows(m, _COLS, "mean", within="chrom", key="start").select("chrom", "start", "row_stat")


@query(f"WITH {A.SAMPLES}, {_MX}, v AS (SELECT chrom, start, chrom || ':' || CAST(start AS VARCHAR) AS k, (POW(v0 - a, 2) + POW(v1 - a, 2) + POW(v2 - a, 2) + POW(v3 - a, 2)) / 3 AS s FROM (SELECT *, (v0 + v1 + v2 + v3) / 4 AS a FROM mx) q) SELECT chrom, start, ROUND(s, 6) AS row_var FROM v ORDER BY s DESC, k LIMIT 100")
def most_variable(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d).withColumn("k", F.concat_ws(":", "chrom", F.col("start").cast("string")))
    return analysis.most_variable(m, _COLS, 100, "k").select("chrom", "start", r6("row_var").alias("row_var"))


@query(f"WITH {A.SAMPLES}, {_MX}, md AS (SELECT " + ", ".join(f"QUANTILE_CONT({c}, 0.5) AS m{c}, QUANTILE_CONT(ABS({c}), 0.5) AS s{c}" for c in _COLS) + " FROM mx) SELECT chrom, start FROM mx, md WHERE " + " AND ".join(f"s{c} > 0 AND CAST(0.6745 AS DOUBLE) * ABS({c} - m{c}) / s{c} > CAST(0.3 AS DOUBLE)" for c in _COLS))
def outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return analysis.outliers(_matrix(spark, d), _COLS, 0.3).select("chrom", "start")


@query()
def kmeans_rows(spark: SparkSession, d: str) -> DataFrame:
    return analysis.kmeans_rows(_matrix(spark, d), _COLS, 4).select("chrom", "start", "cluster")


@query()
def pca_rows(spark: SparkSession, d: str) -> DataFrame:
    return analysis.principal_components(_matrix(spark, d), _COLS, 2).select("chrom", "start", "pc")


# -- reads ---------------------------------------------------------------------------------------------------------------


_CHUNK = 500


def _genome(spark: SparkSession, d: str) -> DataFrame:
    return chunked_reference(A.genome(spark, d), _CHUNK)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return readops.pieces_from_reads(A.reads(spark, d), _genome(spark, d), proper_pairs=False, chunk=_CHUNK)


def _bases(spark: SparkSession, d: str) -> DataFrame:
    return readops.read_bases(_pieces(spark, d))


@query(f"WITH {A.SITES_FROM_READS} SELECT chrom, start, strand, context, meth, CAST(cov AS INT) AS coverage, ROUND(level, 6) AS value FROM sx")
def pileup_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites from reads with clips, insertions, deletions, mates that overlap, mismatches, low qualities and marked duplicates."""
    return readops.emit_sites(readops.pileup(_pieces(spark, d))).select("chrom", "start", "strand", "context", "meth", "coverage", r6("value").alias("value"))


@query(
    f"WITH {A.SITES_FROM_READS} SELECT chrom, start, strand, context, meth, CAST(cov AS INT) AS coverage, ROUND(level, 6) AS value, ROUND(eff, 6) AS eff_ct, rev_g, rev_ga, "
    "CASE WHEN level >= 0.8 THEN 'M' WHEN level >= 0.6 THEN 'Mh' WHEN level >= 0.4 THEN 'H' WHEN level >= 0.2 THEN 'hU' ELSE 'U' END AS category, fivemer, "
    "CASE WHEN SUBSTRING(fivemer, 2, 3) IN ('ACG', 'TCG') THEN 'WCG' WHEN SUBSTRING(fivemer, 2, 3) IN ('GCA', 'GCT', 'GCC') THEN 'GCH' END AS nome FROM sx WHERE rev_ga > 20 AND rev_g < rev_ga"
)
def pileup_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The whole ratio report of the sites whose reads of the other class show a variant."""
    s = readops.emit_sites(readops.pileup(_pieces(spark, d)), nome=True).where((F.col("rev_ga") > 20) & (F.col("rev_g") < F.col("rev_ga")))
    return s.select("chrom", "start", "strand", "context", "meth", "coverage", r6("value").alias("value"), r6("eff_ct").alias("eff_ct"), "rev_g", "rev_ga", "category", "fivemer", "nome")


@query(f"WITH {A.READS} SELECT context, COUNT(CASE WHEN is_m THEN 1 END) AS methylated, COUNT(CASE WHEN NOT is_m THEN 1 END) AS unmethylated FROM cx WHERE context IS NOT NULL GROUP BY context")
def read_context_totals(spark: SparkSession, d: str) -> DataFrame:
    return readops.context_totals(_bases(spark, d))


@query(
    f"WITH {A.READS} SELECT qname, CAST(at0 + 1 AS BIGINT) AS pos, COUNT(*) AS n_c, COUNT(CASE WHEN is_m THEN 1 END) AS m_c, COUNT(CASE WHEN context = 'CG' THEN 1 END) AS n_cg, COUNT(CASE WHEN context = 'CHG' THEN 1 END) AS n_chg, "
    "COUNT(CASE WHEN context = 'CHH' AND is_m THEN 1 END) AS m_chh FROM cx GROUP BY qname, r, at0"
)
def read_tallies(spark: SparkSession, d: str) -> DataFrame:
    return readops.read_tallies(_bases(spark, d)).select("qname", "pos", "n_c", "m_c", "n_cg", "n_chg", "m_chh")


@query(
    f"WITH {A.READS} SELECT qname, CAST(at0 + 1 AS BIGINT) AS pos, MIN(p) + 1 AS start, STRING_AGG(CASE WHEN is_m THEN l ELSE LOWER(l) END, '' ORDER BY p) AS calls FROM "
    "(SELECT *, CASE context WHEN 'CG' THEN 'Z' WHEN 'CHG' THEN 'X' WHEN 'CHH' THEN 'H' ELSE 'U' END AS l FROM cx) q GROUP BY qname, r, at0"
)
def read_methyl_strings(spark: SparkSession, d: str) -> DataFrame:
    return readops.methyl_strings(_bases(spark, d)).select("qname", "pos", "start", "calls")


@query(
    f"""WITH {A.READS}, mt AS (SELECT mb.*, l.k IS NOT NULL AND mb.p + 1 < l.last + 1 AS hid FROM mb JOIN ok ON ok.qname = mb.qname AND ok.r = mb.r LEFT JOIN ok l ON l.qname = mb.qname AND l.r = 0 AND mb.r = 1 AND mb.at0 > l.at0),
ml AS (SELECT *, CASE WHEN hid THEN '=' WHEN (minus = 0 AND g = 'C' OR minus = 1 AND g = 'G') AND b = g THEN 'M' WHEN minus = 0 AND g = 'C' AND b = 'T' OR minus = 1 AND g = 'G' AND b = 'A' THEN 'U' WHEN b = g THEN '=' ELSE g END AS l,
  CASE WHEN NOT hid AND (minus = 0 AND g = 'C' AND b = 'T' OR minus = 1 AND g = 'G' AND b = 'A') THEN g ELSE b END AS f FROM mt),
tx AS (SELECT qname, r, minus, paired, kind, CAST(at0 + 1 AS BIGINT) AS pos, STRING_AGG(l, '' ORDER BY p) AS t, STRING_AGG(f, '' ORDER BY p) AS s FROM ml GROUP BY qname, r, minus, paired, kind, at0)
SELECT tx.qname, tx.pos, CAST(ok.mm AS INT) AS nm, CASE kind WHEN 1 THEN 'SSS' || t WHEN 2 THEN SUBSTRING(t, 1, 10) || 'II' || SUBSTRING(t, 11) WHEN 3 THEN SUBSTRING(t, 1, 10) || 'DDD' || SUBSTRING(t, 11) ELSE t END AS md,
  CASE kind WHEN 1 THEN 'AAA' || s WHEN 2 THEN SUBSTRING(s, 1, 10) || 'AA' || SUBSTRING(s, 11) ELSE s END AS before,
  CASE WHEN NOT paired THEN 'CT' WHEN (minus = 0) = (tx.r = 0) THEN 'CT' ELSE 'GA' END AS yc, CASE WHEN paired THEN CASE WHEN tx.r = 0 THEN 'f' ELSE 'r' END WHEN minus = 0 THEN 'f' ELSE 'r' END AS yd FROM tx JOIN ok ON ok.qname = tx.qname AND ok.r = tx.r"""
)
def annotated_reads(spark: SparkSession, d: str) -> DataFrame:
    a = readops.annotated_reads(A.reads(spark, d), _genome(spark, d), proper_pairs=False, chunk=_CHUNK)
    return a.select("qname", "pos", "nm", "md", "before", "yc", "yd")


_FLAGS = "CASE WHEN paired THEN CASE WHEN minus = 0 THEN CASE WHEN r = 0 THEN 99 ELSE 147 END ELSE CASE WHEN r = 0 THEN 163 ELSE 83 END END WHEN minus = 0 THEN 0 ELSE 16 END"


@query(f"WITH {A.READS}, q AS (SELECT qname, at0, {_FLAGS} AS flag FROM rd WHERE k % 23 <> 0 AND k % 19 <> 0) SELECT qname, CAST(at0 + 1 AS BIGINT) AS pos, CAST(flag AS INT) AS flag, CASE flag WHEN 0 THEN 1 WHEN 16 THEN 4 WHEN 99 THEN 1 WHEN 163 THEN 2 WHEN 147 THEN 3 ELSE 4 END AS hit FROM q")
def read_hits(spark: SparkSession, d: str) -> DataFrame:
    return readops.usable_reads(A.reads(spark, d), proper_pairs=False).select("qname", "pos", "flag", "hit")


@query(
    f"WITH {A.READS}, q AS (SELECT qname, at0, r, c, minus, n + CASE kind WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS len FROM rd WHERE k % 23 <> 0 AND k % 19 <> 0) "
    "SELECT CONCAT('chr', CAST(c AS VARCHAR)) AS rname, CAST(at0 + 1 AS BIGINT) AS pos, CAST(len AS INT) AS read_len, minus = 0 AS plus, MIN(qname) AS qname FROM q GROUP BY c, at0, len, minus"
)
def reads_without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    u = readops.without_duplicates(readops.usable_reads(A.reads(spark, d), proper_pairs=False))
    return u.select("rname", "pos", F.length("seq").alias("read_len"), F.col("hit").isin(1, 3).alias("plus"), "qname")


@query(
    f"WITH {A.READS}, q AS (SELECT *, {_FLAGS} AS flag, k % 23 <> 0 AND k % 19 <> 0 AS good FROM rd) SELECT 'Total_reads' AS name, COUNT(*) AS n FROM q UNION ALL SELECT 'Total_Mapped_Q30', COUNT(*) FROM q WHERE good "
    "UNION ALL SELECT 'Mapped_forward', COUNT(*) FROM q WHERE good AND flag IN (0, 99, 163) UNION ALL SELECT 'Mapped_reverse', COUNT(*) FROM q WHERE good AND flag IN (16, 147, 83)"
)
def alignment_log(spark: SparkSession, d: str) -> DataFrame:
    return readops.alignment_log(A.reads(spark, d), proper_pairs=False)


@query(f"WITH {A.READS} SELECT CAST(k % 40 + 40 AS INT) AS tlen, COUNT(*) AS n FROM rd WHERE paired AND r = 0 GROUP BY k % 40")
def insert_size_counts(spark: SparkSession, d: str) -> DataFrame:
    return readops.insert_sizes(A.reads(spark, d)).groupBy("tlen").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.GENOME_LENGTH} SELECT CONCAT('chr', CAST(c AS VARCHAR)) AS chrom, COUNT(*) AS length, COUNT(CASE WHEN b = 'C' THEN 1 END) AS n_c, COUNT(CASE WHEN b = 'G' THEN 1 END) AS n_g, COUNT(CASE WHEN b IN ('C', 'G') THEN 1 END) AS n_cg FROM (SELECT c, " + A._base_sql("i", "c") + " AS b FROM gn, UNNEST(RANGE(0, gl)) u(i), UNNEST(RANGE(1, 6)) v(c)) q GROUP BY c")
def genome_base_counts(spark: SparkSession, d: str) -> DataFrame:
    return base_counts(A.genome(spark, d))


@query(f"WITH {A.RAW_CELLS}, {A.REGIONS}, pl AS (SELECT rc.*, (SELECT MIN(rg.region_idx) FROM rg WHERE rg.chrom = rc.chrom AND rc.start < rg.re AND rc.start + 1 > rg.rs) AS k FROM rc) SELECT id, CONCAT('r', CAST(k AS VARCHAR)) AS region_id, COUNT(*) AS n_sites, CAST(SUM(coverage) AS BIGINT) AS total_coverage, ROUND(SUM(value * coverage) / SUM(coverage), 6) AS mean_meth FROM pl WHERE k IS NOT NULL AND coverage >= 1 GROUP BY 1, 2")
def sc_matrix_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The matrix over rows that repeat cell and position: none is lost."""
    m = cells.cell_matrix(cells.placed_in_regions(A.raw_cells(spark, d), A.regions(spark, d)))
    return m.select("id", "region_id", "n_sites", "total_coverage", r6("mean_meth").alias("mean_meth"))


@query(f"WITH {A.RAW_CELLS}, {A.REGIONS} SELECT chrom, start, CAST(strand AS INT) AS strand, COUNT(*) AS n FROM (SELECT chrom, start, strand FROM rc WHERE EXISTS (SELECT 1 FROM rg WHERE rg.chrom = rc.chrom AND rg.rstrand = rc.strand AND rc.start < rg.re + 1 AND rc.start + 1 > rg.rs)) q GROUP BY chrom, start, strand")
def view_region_strand_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Rows in regions of their strand, cut to chrom, start and strand, so that many are equal: each is kept."""
    v = ops.view(A.raw_cells(spark, d).select("chrom", "start", "strand"), regions=A.regions(spark, d), use_region_strand=True)
    return v.groupBy("chrom", "start", F.col("strand").cast("int").alias("strand")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {A.SAMPLES}, {A.REGIONS}, iv AS (SELECT * FROM sm WHERE EXISTS (SELECT 1 FROM rg WHERE rg.chrom = sm.chrom AND rg.rstrand = sm.strand AND sm.start < rg.re + 1 AND sm.start + 1 > rg.rs)) "
    "SELECT a.chrom, a.start, a.value AS value_1, CAST(a.coverage AS INT) AS coverage_1, b.value AS value_2, CAST(b.coverage AS INT) AS coverage_2 FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.start = b.start WHERE a.sample = 's1' AND b.sample = 's2'"
)
def overlap_two_regions(spark: SparkSession, d: str) -> DataFrame:
    s = A.samples(spark, d)
    return ops.overlap_in_regions([s.where("sample = 's1'"), s.where("sample = 's2'")], A.regions(spark, d)).select("chrom", "start", "value_1", "coverage_1", "value_2", "coverage_2")


@query(
    f"WITH {A.SAMPLES}, {A.REGIONS}, iv AS (SELECT * FROM sm WHERE sample <> 's3' AND EXISTS (SELECT 1 FROM rg WHERE rg.chrom = sm.chrom AND rg.rstrand = sm.strand AND sm.start < rg.re + 1 AND sm.start + 1 > rg.rs)) "
    "SELECT chrom, start, CAST(SUM(meth) AS BIGINT) AS m, CAST(SUM(coverage) AS BIGINT) AS c FROM iv GROUP BY chrom, start HAVING COUNT(*) = 3"
)
def overlap_multi_regions(spark: SparkSession, d: str) -> DataFrame:
    s = A.samples(spark, d).drop("m")
    o = ops.overlap_in_regions([s.where(f"sample = 's{i}'").drop("sample") for i in range(3)], A.regions(spark, d))
    total = lambda f: F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x[f].cast("long"))
    return o.select("chrom", "start", total("m").alias("m"), total("coverage").alias("c"))


# -- further statistics and sinks ------------------------------------------------------------------------------------------


@query(
    f"""WITH {A.SITES}, {A.REGIONS}, wn AS (SELECT region_id, chrom, i AS bin, rs + i * 20 AS rs, rs + i * 20 + 40 AS re FROM rg, UNNEST(RANGE(0, 4)) u(i)),
j AS (SELECT wn.region_id, wn.bin, st.* FROM st JOIN wn ON wn.chrom = st.chrom AND st.start < wn.re AND st.start + 1 > wn.rs)
SELECT region_id, CAST(bin AS INT) AS bin, CAST(bucket AS INT) AS context, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level, COUNT(*) AS n_sites FROM ({_ROLL}) q GROUP BY region_id, bin, bucket"""
)
def binned_stats(spark: SparkSession, d: str) -> DataFrame:
    w = intervals.region_windows(A.regions(spark, d).select("region_id", "chrom", "rs", "re"), 4, 40, 20)
    return regionstats.region_stats(A.sites(spark, d), w, keys=("region_id", "bin"))


@query(f"WITH {A.SAMPLES}, {_GC} SELECT chrom, start, m1, c1, m2, c2, n1 = 2 AND n2 = 2 AS complete FROM gc")
def dmr_relaxed_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, relaxed=True).select("chrom", "start", "m1", "c1", "m2", "c2", "complete")


@query(
    f"WITH {A.CELLS}, {A.REGIONS}, {_FIRST} SELECT id, CONCAT('r', CAST(k AS VARCHAR)) AS region_id, CAST(SUM(coverage) AS DOUBLE) AS value FROM pl WHERE coverage >= 1 GROUP BY 1, 2"
)
def sc_matrix_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cells.cell_matrix(cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d)), "coverage", "sum").select("id", "region_id", "value")


@query(
    f"WITH {A.SITES} SELECT CONCAT(chrom, CHR(9), CAST(start AS VARCHAR), CHR(9), CAST(start + 1 AS VARCHAR), CHR(9), PRINTF('%.6f', value), CHR(9), CAST(coverage AS VARCHAR), CHR(9), CASE strand WHEN 0 THEN '+' ELSE '-' END, CHR(9), "
    "CASE context WHEN 1 THEN 'CG' WHEN 2 THEN 'CHG' ELSE 'CHH' END) AS value FROM st"
)
def view_text(spark: SparkSession, d: str) -> DataFrame:
    return site_lines(A.sites(spark, d), bed=True)


@query(f"WITH {A.SITES} SELECT CONCAT(chrom, CHR(9), CAST(start AS VARCHAR), CHR(9), CAST(start + 1 AS VARCHAR), CHR(9), PRINTF('%.6f', CASE WHEN strand = 1 THEN -value ELSE value END)) AS value FROM st")
def bedgraph_text(spark: SparkSession, d: str) -> DataFrame:
    return bedgraph_lines(A.sites(spark, d), merge_strands=True)


@query(
    f"""WITH {A.SAMPLES}, {A.REGIONS}, {_bins_sql('across').replace('st.*', 'sm.*').replace('FROM st JOIN bn ON bn.chrom = st.chrom AND st.start < bn.re AND st.start + 1 > bn.rs', 'FROM sm JOIN bn ON bn.chrom = sm.chrom AND sm.start < bn.re AND sm.start + 1 > bn.rs').replace('SELECT region_id, CAST(bin', 'SELECT sample, region_id, CAST(bin').replace('GROUP BY region_id, bin', 'GROUP BY sample, region_id, bin')},
av AS (SELECT sample, context, bin, AVG(level) AS level FROM pf WHERE sample IN ('s0', 's1') GROUP BY sample, context, bin)
SELECT context, bin, ROUND(AVG(level), 6) AS level, COUNT(*) AS n_replicates FROM av GROUP BY context, bin"""
)
def profile_replicates(spark: SparkSession, d: str) -> DataFrame:
    s, b = A.samples(spark, d), profile.profile_bins(A.regions(spark, d), "across", extend=60, step=_STEP)
    one = lambda name: profile.profile_average(profile.profile(s.where(F.col("sample") == name), b))
    return profile.replicate_average([one("s0"), one("s1")]).withColumn("bin", F.col("bin").cast("int")).withColumn("level", r6("level"))
