"""Queries of the sources and sinks: texts made from the driver tables, read by the parsers, with the expected rows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import shared_dir
from methloom.operators import analysis, cells, dmr, profile, regionstats
from methloom.operators import reads as readops
from methloom.operators import sites as ops
from methloom.plans import adapter as A
from methloom.plans import sites as S
from methloom.schema import decode_context, decode_strand, fixed
from methloom.sources import binary, reads, regions, results, sinks, text
from methloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = S.registered(QUERIES, SQL)
r6 = S.r6


def _text(*columns) -> Column:
    return F.concat_ws("\t", *(c.cast("string") if isinstance(c, Column) else F.lit(c) for c in columns)).alias("value")


_STRAND = lambda: decode_strand(F.col("strand"))
_CONTEXT = lambda: decode_context(F.col("context"))
# Columns can only be named while a session runs.
_C, _S, _M, _N = (lambda c=c: F.col(c) for c in ("chrom", "start", "meth", "coverage"))
_SITE = 'chrom, start, "end", ROUND(CAST(v AS DOUBLE), 5) AS value, coverage, strand, context, meth'


def _parsed(lines: DataFrame, fmt: str, **options) -> DataFrame:
    s = text.parse_sites(lines, fmt, **options)
    whole = (F.col(c).cast("int").alias(c) for c in ("coverage", "strand", "context"))
    return s.select("chrom", "start", "end", F.round(F.col("value").cast("double"), 5).alias("value"), *whole, "meth")


def _sql(columns: str, where: str = "coverage >= 4") -> str:
    return f"WITH {A.SITES} SELECT {_SITE} FROM (SELECT {columns} FROM st WHERE {where}) q"


_PLAIN = "chrom, start, start + 1 AS \"end\", {v} AS v, CAST(coverage AS INT) AS coverage, CAST(strand AS INT) AS strand, CAST(context AS INT) AS context, meth"
_RATIO = "CAST(value AS FLOAT)"


@query(_sql(_PLAIN.format(v=_RATIO)))
def source_methratio(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), _CONTEXT(), _M(), _N(), "further", "columns")), "methratio")


#: The percent in bed texts: whole ones, of which the count is worked out.
_PERCENT = "CAST(FLOOR(value * 100) AS INT)"


@query(_sql(f'chrom, start, start + 1 AS "end", CAST({_PERCENT} AS FLOAT) / CAST(100 AS FLOAT) AS v, CAST(coverage AS INT) AS coverage, CAST(strand AS INT) AS strand, 0 AS context, CAST(FLOOR(CAST(CAST({_PERCENT} AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE) * coverage + 0.5) AS BIGINT) AS meth'))
def source_bedmethyl(spark: SparkSession, d: str) -> DataFrame:
    pct = F.floor(F.col("value") * 100).cast("int")
    return _parsed(A.sites(spark, d).select(_text(_C(), _S() - 1, _S(), ".", _N(), _STRAND(), _S() - 1, _S(), "0,0,0", _N(), pct)), "bedmethyl")


@query(_sql(_PLAIN.format(v="CAST(CAST(PRINTF('%.4f', value) AS DOUBLE) AS FLOAT)")))
def source_bedsimple(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(A.sites(spark, d).select(_text(_C(), _S(), _S() + 1, "site", _STRAND(), _CONTEXT(), _M(), _N())), "bedsimple")


@query(_sql(_PLAIN.format(v=_RATIO)))
def source_bismark(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), _M(), _N() - _M(), _CONTEXT(), "CNN")), "bismark")


@query(_sql(_PLAIN.format(v=f"CAST({_PERCENT} AS FLOAT) / CAST(100 AS FLOAT)").replace(", meth", f", CAST(FLOOR(CAST(CAST(PRINTF('%.2f', CAST({_PERCENT} AS DOUBLE) / 100) AS FLOAT) AS DOUBLE) * coverage + 0.5) AS BIGINT) AS meth")))
def source_simpleme(spark: SparkSession, d: str) -> DataFrame:
    share = F.format_string("%.2f", F.floor(F.col("value") * 100) / F.lit(100.0))
    return _parsed(A.sites(spark, d).select(_text(_C(), _S(), share, _N(), _STRAND(), _CONTEXT())), "simpleme")


@query(_sql(_PLAIN.format(v=_RATIO), "coverage >= 4 AND start % 5 <> 0"))
def source_modkit(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(_S() % 5 == 0, "h").otherwise("m"), F.lit(","), _CONTEXT(), F.lit(",0"))
    return _parsed(A.sites(spark, d).select(_text(_C(), _S() - 1, _S(), name, _N(), _STRAND(), _S() - 1, _S(), "255,0,0", _N(), "1.5", _M(), _N() - _M())), "modkit_pileup")


@query(_sql(_PLAIN.format(v="CAST(CASE WHEN strand = 1 THEN -value ELSE value END AS FLOAT)"), "coverage >= 10 AND chrom = 'chr2' AND context = 1"))
def import_filters(spark: SparkSession, d: str) -> DataFrame:
    lines = A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), _CONTEXT(), _M(), _N()))
    return _parsed(lines.unionByName(spark.createDataFrame([("# a comment",)], "value string")), "methratio", chrom="chr2", context="CG", signed=True, min_cover=10)


def _rg(spark: SparkSession, d: str) -> DataFrame:
    return A.regions(spark, d)


def _bounds() -> list:
    return ["chrom", "rs", "re", F.col("strand").cast("int").alias("strand")]


@query(f"WITH {A.REGIONS} SELECT chrom, rs, re, CAST(CASE WHEN region_idx % 3 = 0 THEN 2 ELSE rstrand END AS INT) AS strand FROM rg")
def source_bed(spark: SparkSession, d: str) -> DataFrame:
    lines = _rg(spark, d).select(F.when(F.col("region_idx") % 3 == 0, _text(_C(), F.col("rs"), F.col("re"))).otherwise(_text(_C(), F.col("rs"), F.col("re"), _STRAND())).alias("value"))
    return regions.parse_bed(lines).select(*_bounds())


@query(f"WITH {A.REGIONS} SELECT chrom, rs, re, region_id AS name, PRINTF('region_%06d', CAST(ROW_NUMBER() OVER (ORDER BY region_idx) AS INT)) AS region_id FROM rg")
def source_bed_names(spark: SparkSession, d: str) -> DataFrame:
    lines = _rg(spark, d).orderBy("region_idx").select(_text(_C(), F.col("rs"), F.col("re"), F.col("region_id")))
    return regions.numbered_regions(regions.parse_bed(lines, "name")).select("chrom", "rs", "re", "name", "region_id")


@query(f"WITH {A.REGIONS} SELECT region_id, chrom, rs, re, CAST(rstrand AS INT) AS strand FROM rg")
def source_gtf(spark: SparkSession, d: str) -> DataFrame:
    lines = _rg(spark, d).select(_text(_C(), "src", "exon", F.col("rs"), F.col("re"), ".", _STRAND(), ".", F.concat(F.lit('gene_id "'), F.col("region_id"), F.lit('"; transcript_id "t";'))))
    return regions.parse_gtf(lines).select("region_id", *_bounds())


@query(f"WITH {A.REGIONS} SELECT region_id, chrom, rs, re, CAST(rstrand AS INT) AS strand FROM rg")
def source_gff(spark: SparkSession, d: str) -> DataFrame:
    lines = _rg(spark, d).select(_text(_C(), "src", "gene", F.col("rs"), F.col("re"), ".", _STRAND(), ".", F.concat(F.lit("ID="), F.col("region_id"), F.lit(";Name=x"))))
    return regions.parse_gff(lines).select("region_id", *_bounds())


@query(f"WITH {A.SITES} SELECT chrom, start, coverage FROM st WHERE (chrom = 'chr1' AND start BETWEEN 100 AND 400) OR (chrom = 'chr3' AND strand = 1 AND start BETWEEN 50 AND 900)")
def view_region_string(spark: SparkSession, d: str) -> DataFrame:
    r = regions.region_string(spark, "chr1:100-400;chr3:50-900,-")
    return ops.view(A.sites(spark, d), regions=r, use_region_strand=True).select("chrom", "start", "coverage")


@query("SELECT CONCAT('cell_', CAST(s_suppkey AS VARCHAR)) AS cell_id, CONCAT('g', CAST(s_nationkey % 4 AS VARCHAR)) AS group_label FROM supplier")
def source_group_map(spark: SparkSession, d: str) -> DataFrame:
    lines = A.groups(spark, d).select(_text(F.col("cell_id"), F.col("group_label"))).unionByName(spark.createDataFrame([("Cell_ID\tgroup",), ("alone",)], "value string"))
    return regions.parse_group_map(lines).select("cell_id", "group_label")


@query(f"WITH {A.SITES}, x AS (SELECT DISTINCT chrom FROM st) SELECT CAST(ROW_NUMBER() OVER (ORDER BY x.chrom IS NULL, s.chrom) - 1 AS INT) AS tid, s.chrom, s.chrom_len AS length FROM chrom_sizes s LEFT JOIN x ON x.chrom = s.chrom")
def source_dictionary(spark: SparkSession, d: str) -> DataFrame:
    sizes = S.table(spark, d, "chrom_sizes").select("chrom", F.col("chrom_len").alias("length"))
    return text.chrom_dictionary(sizes, A.sites(spark, d))


# -- alignments ------------------------------------------------------------------------------------------------------------


@query(f"WITH {A.READS} SELECT qname, {S._FLAGS} + CASE WHEN k % 23 = 0 THEN 1024 ELSE 0 END AS flag, CONCAT('chr', CAST(c AS VARCHAR)) AS rname, CAST(at0 + 1 AS BIGINT) AS pos, CAST(CASE WHEN k % 19 = 0 THEN 29 ELSE 60 END AS INT) AS mapq, "
       "CASE kind WHEN 1 THEN '3S' || n || 'M' WHEN 2 THEN '10M2I' || (n - 10) || 'M' WHEN 3 THEN '10M3D' || (n - 10) || 'M' ELSE n || 'M' END AS cigar, CASE WHEN paired THEN '=' ELSE '*' END AS rnext FROM rd")
def source_sam(spark: SparkSession, d: str) -> DataFrame:
    r = A.reads(spark, d)
    lines = r.select(_text(*(F.col(c) for c in r.columns if c != "tags"), "NM:i:0")).unionByName(spark.createDataFrame([("@SQ\tSN:chr1\tLN:100",), ("@PG\tID:x",)], "value string"))
    return reads.parse_sam(lines).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext")


@query(f"WITH {A.READS} SELECT qname, CAST(at0 + 1 AS BIGINT) AS pos, CONCAT('chr', CAST(c AS VARCHAR)) AS rname, CASE WHEN paired THEN '=' ELSE '*' END AS rnext, "
       "CASE WHEN flag & 16 > 0 THEN 'AACGT' ELSE 'ACGTT' END AS seq, CONCAT('YS:Z:ACGTT', CHR(9), 'SA:Z:chr', CAST(c AS VARCHAR), ',5,+,4M,60,0;') AS tags FROM (SELECT *, " + S._FLAGS + " AS flag FROM rd) q")
def sam_repair(spark: SparkSession, d: str) -> DataFrame:
    r = A.reads(spark, d)
    form = F.when(F.col("pos") % 2 == 0, "f").otherwise("r")
    tags = F.concat(F.lit("YS:Z:ACGTT\tSA:Z:"), form, F.col("rname"), F.lit(",5,+,4M,60,0;"))
    changed = r.withColumn("tags", tags).withColumn("rname", F.concat(form, "rname"))
    return reads.repair_sam(changed).select("qname", "pos", "rname", "rnext", "seq", "tags")


@query(f"WITH {A.READS}, e AS (SELECT *, CASE WHEN (paired AND r = 0) OR (NOT paired AND minus = 0) THEN at0 ELSE at0 + n + CASE WHEN kind = 3 THEN 3 ELSE 0 END - 4 END AS p FROM rd WHERE k % 23 <> 0) "
       f"SELECT CONCAT({', '.join(A._at_sql(i) for i in range(4))}) AS ref4, COUNT(*) AS n FROM e GROUP BY 1")
def head_motif_counts(spark: SparkSession, d: str) -> DataFrame:
    return readops.motif_counts(readops.head_motifs(A.reads(spark, d), S._genome(spark, d), proper_pairs=False, chunk=S._CHUNK))


@query(f"WITH {A.GENOME_LENGTH} SELECT CONCAT('chr', CAST(c AS VARCHAR), CHR(9), CAST(b AS VARCHAR), CHR(9), CAST(LEAST(b + 100, gl) AS VARCHAR)) AS value FROM gn, UNNEST(RANGE(1, 6)) u(c), UNNEST(RANGE(0, gl, 100)) v(b)")
def chrom_bins_text(spark: SparkSession, d: str) -> DataFrame:
    return reads.length_lines(A.genome(spark, d), 100)


# -- further statistics ------------------------------------------------------------------------------------------------------


@query(f"WITH {A.SITES}, {A.REGIONS}, {S._J} SELECT region_id, CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE) AS level, COUNT(*) AS n_sites FROM j WHERE strand = 1 AND context = 2 GROUP BY region_id")
def regionstats_one_context(spark: SparkSession, d: str) -> DataFrame:
    return regionstats.region_stats(A.sites(spark, d), A.regions(spark, d), strand=1, context=2).select("region_id", "level", "n_sites")


@query(f"""WITH {A.SITES}, {A.REGIONS}, z AS (SELECT chrom, start - start % 64 AS w, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi, SUM(value) AS s, SUM(value * value) AS q FROM st GROUP BY 1, 2),
j AS (SELECT rg.region_id, rg.rs, rg.re, z.*, CAST(LEAST(w + 64, re) - GREATEST(w, rs) AS DOUBLE) / 64 AS part FROM z JOIN rg ON rg.chrom = z.chrom AND w < re AND w + 64 > rs),
a AS (SELECT region_id, SUM(n * part) AS n, SUM(s * part) AS s, SUM(q * part) AS q, MIN(lo) AS lo, MAX(hi) AS hi, MAX(re - rs) AS len FROM j GROUP BY region_id)
SELECT region_id, ROUND(s / n, 6) AS mean_value, ROUND(SQRT(GREATEST((q - s * s / n) / CASE WHEN n > 1 THEN n - 1 END, 0)), 5) AS dev_value, lo AS min_value, hi AS max_value, ROUND(n / len, 6) AS covered, ROUND(s, 6) AS sum_value FROM a""")
def zoom_statistics(spark: SparkSession, d: str) -> DataFrame:
    z = ops.zoom_stats(ops.zoom(A.sites(spark, d), 64), 64, A.regions(spark, d))
    return z.select("region_id", r6("mean_value").alias("mean_value"), F.round("dev_value", 5).alias("dev_value"), "min_value", "max_value", r6("covered").alias("covered"), r6("sum_value").alias("sum_value"))


@query(f"WITH {A.SITES} SELECT chrom, start - start % 64 AS win_start, COUNT(*) AS n, MIN(value) AS min_value, MAX(value) AS max_value FROM st WHERE coverage >= 5 AND context = 1 GROUP BY 1, 2")
def add_zoom(spark: SparkSession, d: str) -> DataFrame:
    """A filtered copy with zoom levels; the second one."""
    levels = ops.zoom_levels(ops.view(A.sites(spark, d), min_cover=5, context=1), 2)
    return levels[max(levels)].select("chrom", "win_start", "n", "min_value", "max_value")


@query(f"WITH {A.SITES} SELECT chrom, pos, value FROM (SELECT chrom, value, UNNEST(RANGE(GREATEST(start, 100), LEAST(start + 3, 400))) AS pos FROM st WHERE start < 400 AND start + 3 > 100) q")
def per_base_values(spark: SparkSession, d: str) -> DataFrame:
    return binary.per_base(A.sites(spark, d).withColumn("end", F.col("start") + 3), 100, 400)


@query(f"WITH {A.SAMPLES} SELECT chrom, start, MAX(CASE WHEN sample = 's0' THEN value END) AS s0, MAX(CASE WHEN sample = 's1' THEN value END) AS s1, MAX(CASE WHEN sample = 's2' THEN value END) AS s2 FROM sm WHERE sample <> 's3' GROUP BY chrom, start HAVING COUNT(*) = 3")
def merged_matrices(spark: SparkSession, d: str) -> DataFrame:
    s = A.samples(spark, d)
    return analysis.outer_merge({f"s{i}": s.where(f"sample = 's{i}'") for i in range(3)}, ("chrom", "start"))


# -- sinks -------------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/methloom-{uuid.uuid4().hex}"


@query(f"WITH {A.SITES} SELECT chrom, start, value, CAST(coverage AS INT) AS coverage, CAST(strand AS INT) AS strand, CAST(context AS INT) AS context, meth FROM st")
def native_table(spark: SparkSession, d: str) -> DataFrame:
    """The sites as the native table holds them, by chromosome and position."""
    path = _folder(spark)
    text.write_sites(A.sites(spark, d), path)
    whole = (F.col(c).cast("int").alias(c) for c in ("coverage", "strand", "context"))
    return text.read_table(spark, path).select("chrom", "start", "value", *whole, "meth")


@query(f"WITH {A.SITES} SELECT chrom, start, start + 1 AS \"end\", ROUND(CAST(CAST(CASE WHEN strand = 1 THEN -value ELSE value END AS FLOAT) AS DOUBLE), 5) AS value FROM st")
def bigwig_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sites written as a bigWig, strands merged by sign, and read back by the data source."""
    path = _folder(spark) + ".bw"
    sinks.write_bigwig(A.sites(spark, d), A.lengths(spark, d), path, merge_strands=True)
    return binary.read_binary(spark, path.removeprefix("file://").removeprefix("file:")).select("chrom", "start", "end", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(
    f"WITH {A.CELLS}, {A.REGIONS}, {S._FIRST}, m AS (SELECT id, CONCAT('r', CAST(k AS VARCHAR)) AS f, SUM(coverage) AS v FROM pl WHERE coverage >= 1 GROUP BY 1, 2), fi AS (SELECT f, ROW_NUMBER() OVER (ORDER BY f) AS i FROM (SELECT DISTINCT f FROM m) q), "
    "ci AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS i FROM (SELECT DISTINCT id FROM m) q) SELECT CONCAT(CAST(fi.i AS VARCHAR), ' ', CAST(ci.i AS VARCHAR), ' ', PRINTF('%.6f', CAST(v AS DOUBLE))) AS value FROM m JOIN fi ON fi.f = m.f JOIN ci ON ci.id = m.id "
    "UNION ALL SELECT '%%MatrixMarket matrix coordinate real general' UNION ALL SELECT CONCAT(CAST((SELECT COUNT(*) FROM fi) AS VARCHAR), ' ', CAST((SELECT COUNT(*) FROM ci) AS VARCHAR), ' ', CAST((SELECT COUNT(*) FROM m) AS VARCHAR))"
)
def matrix_market_text(spark: SparkSession, d: str) -> DataFrame:
    m = cells.cell_matrix(cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d)), "coverage", "sum")
    return sinks.matrix_market(m, "id", "region_id", "value")[0]


_PANEL = [f"r{i}" for i in range(1, 9)]


@query(f"WITH {A.CELLS}, {A.REGIONS}, {S._FIRST} SELECT id, " + ", ".join(f"CAST(COALESCE(SUM(CASE WHEN k = {r[1:]} THEN coverage END), 0) AS DOUBLE) AS {r}" for r in _PANEL) + f" FROM pl WHERE coverage >= 1 AND k BETWEEN 1 AND {len(_PANEL)} GROUP BY id")
def dense_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = cells.cell_matrix(cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d)), "coverage", "sum")
    return sinks.dense_matrix(m.where(F.col("region_id").isin(_PANEL)), "id", "region_id", "value", _PANEL)


_GROUPS = f"WITH {A.CELLS}, {A.REGIONS}, {S._FIRST}, gm AS (SELECT CONCAT('cell_', CAST(s_suppkey AS VARCHAR)) AS id, CONCAT('g', CAST(s_nationkey % 4 AS VARCHAR)) AS grp FROM supplier)"


def _aggregate(spark: SparkSession, d: str) -> DataFrame:
    return cells.group_aggregate(cells.placed_in_regions(A.cells(spark, d), A.regions(spark, d)), cells.group_map(A.groups(spark, d), "map_row"))


@query(
    f"{_GROUPS}, a AS (SELECT grp, k, COUNT(DISTINCT pl.id) AS n, COUNT(*) AS s, SUM(coverage) AS c FROM pl JOIN gm ON gm.id = pl.id WHERE coverage >= 1 GROUP BY 1, 2) "
    "SELECT CONCAT(grp, CHR(9), chrom, CHR(9), CAST(rs AS VARCHAR), CHR(9), CAST(re AS VARCHAR), CHR(9), CAST(n AS VARCHAR), CHR(9), CAST(s AS VARCHAR), CHR(9), CAST(c AS VARCHAR)) AS value FROM a JOIN rg ON rg.region_idx = a.k "
    "UNION ALL SELECT 'group' || CHR(9) || 'chrom' || CHR(9) || 'start' || CHR(9) || 'end' || CHR(9) || 'n_cells' || CHR(9) || 'n_sites' || CHR(9) || 'total_coverage'"
)
def groups_text(spark: SparkSession, d: str) -> DataFrame:
    """The groups table, its two columns of decimals left out."""
    return sinks.group_lines(_aggregate(spark, d), A.regions(spark, d)).select(F.substring_index("value", "\t", 7).alias("value"))


@query(f"{_GROUPS} SELECT DISTINCT grp AS value FROM pl JOIN gm ON gm.id = pl.id WHERE coverage >= 1")
def groups_only_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.group_names(_aggregate(spark, d))


@query(f"WITH {A.SITES}, {A.REGIONS}, {S._J} SELECT CONCAT(MAX(rg.chrom), CHR(9), CAST(MAX(rg.rs) AS VARCHAR), CHR(9), CAST(MAX(rg.re) AS VARCHAR), CHR(9), PRINTF('%.3f', CAST(SUM(meth) AS DOUBLE) / CAST(SUM(coverage) AS DOUBLE)), CHR(9), j.region_id) AS value FROM j JOIN rg ON rg.region_id = j.region_id WHERE context = 1 GROUP BY j.region_id")
def region_levels_text(spark: SparkSession, d: str) -> DataFrame:
    """The file of one context; levels cut to three decimals, so that printing can't differ in the last one."""
    lines = sinks.by_context(lambda c: sinks.region_level_lines(regionstats.region_stats(A.sites(spark, d), A.regions(spark, d)), A.regions(spark, d), c))["cg"]
    f = F.split("value", "\t")
    return lines.select(F.concat_ws("\t", f[0], f[1], f[2], F.format_string("%.3f", f[3].cast("double")), f[4]).alias("value"))


@query(f"WITH {A.SITES}, {A.REGIONS}, {S._bins_sql('center')}, av AS (SELECT context, bin, AVG(level) AS level FROM pf GROUP BY context, bin), nm AS (SELECT * FROM (VALUES (0, 'C'), (1, 'CG'), (2, 'CHG'), (3, 'CHH')) t(context, name)) "
       "SELECT name AS context, n_bins FROM (SELECT context, COUNT(*) AS n_bins FROM av GROUP BY context) q JOIN nm USING (context)")
def profile_average_text(spark: SparkSession, d: str) -> DataFrame:
    """The average file of a profile: its context names and how many bins have a level."""
    n = profile.bin_count(S._STEP / 4)
    f = F.split("value", "\t")
    return sinks.profile_average_lines(profile.profile_average(S._profile(spark, d, "center")), n).select(f[0].alias("context"), F.size(F.filter(F.slice(f, 2, n), lambda x: x != "nan")).cast("long").alias("n_bins"))


@query(f"WITH {A.SAMPLES}, {S._GC}, {S._FISHER}, {S._BH} SELECT CONCAT(chrom, CHR(9), CAST(start AS VARCHAR)) AS place, m1, c1, m2, c2 FROM ad WHERE adj <= 1")
def differential_text(spark: SparkSession, d: str) -> DataFrame:
    """The file of differential sites, in the order of p and place: chromosome, position and the four counts."""
    dictionary = text.chrom_dictionary(A.lengths(spark, d))
    lines = sinks.differential_lines(dmr.sites_report(S._adjusted(spark, d), dictionary=dictionary).drop("strand", "context"))
    f = F.split("value", "\t")
    return lines.select(F.concat_ws("\t", f[0], f[1]).alias("place"), *(f[i].cast("long").alias(c) for i, c in ((4, "m1"), (5, "c1"), (6, "m2"), (7, "c2"))))


@query(
    f"WITH {A.SITES_FROM_READS} SELECT CONCAT(chrom, CHR(9), CAST(start AS VARCHAR), CHR(9), strand, CHR(9), COALESCE(context, 'NA'), CHR(9), CAST(meth AS VARCHAR), CHR(9), CAST(cov AS VARCHAR), CHR(9), PRINTF('%.6f', level), CHR(9), COALESCE(PRINTF('%.1f', eff), 'null'), CHR(9), "
    "CAST(rev_g AS VARCHAR), CHR(9), CAST(rev_ga AS VARCHAR), CHR(9), CASE WHEN level >= 0.8 THEN 'M' WHEN level >= 0.6 THEN 'Mh' WHEN level >= 0.4 THEN 'H' WHEN level >= 0.2 THEN 'hU' ELSE 'U' END, CHR(9), fivemer) AS value FROM sx"
)
def ratio_report_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the ratio report without its head."""
    return sinks.ratio_lines(readops.emit_sites(readops.pileup(S._pieces(spark, d)))).where("value not like '#%'")


@query(_sql(_PLAIN.format(v=_RATIO)))
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Text read as a stream, appended to the native table and read from there."""
    folder = _folder(spark)
    sinks.write_lines(A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), _CONTEXT(), _M(), _N())), f"{folder}/in")
    stream = ingest.stream_sites(spark, f"{folder}/in", "methratio")
    ingest.append_table(stream, f"{folder}/out", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    whole = (F.col(c).cast("int").alias(c) for c in ("coverage", "strand", "context"))
    return text.read_table(spark, f"{folder}/out").select("chrom", "start", "end", F.round(F.col("value").cast("double"), 5).alias("value"), *whole, "meth")


# -- results read again --------------------------------------------------------------------------------------------------------


@query(f"WITH {A.SITES}, {A.REGIONS}, {S._bins_sql('center')} SELECT region_id, bin, CAST(PRINTF('%.4f', level) AS DOUBLE) AS level FROM pf WHERE context = 1")
def results_profile_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A profile matrix written as text and read again, without the bins that have no level."""
    lines = sinks.profile_matrix_lines(S._profile(spark, d, "center"), profile.bin_count(S._STEP / 4), 1)
    return results.parse_matrix(lines).where("level is not null").select("region_id", "bin", "level")


@query(f"WITH {A.SAMPLES} SELECT chrom, start, MAX(CASE WHEN sample = 's0' THEN v END) AS s0, MAX(CASE WHEN sample = 's1' THEN v END) AS s1 FROM (SELECT sample, chrom, start, CAST(PRINTF('%.6f', value) AS DOUBLE) AS v FROM sm WHERE sample IN ('s0', 's1') AND context = 1) q GROUP BY chrom, start HAVING COUNT(*) = 2")
def results_merged_views(spark: SparkSession, d: str) -> DataFrame:
    """Text views of two samples read again, one context, merged by position; positions that a sample lacks are dropped."""
    s = A.samples(spark, d)
    views = {n: results.parse_view(text.site_lines(s.where(f"sample = '{n}'"), bed=True), "CG") for n in ("s0", "s1")}
    return analysis.outer_merge(views).select("chrom", "start", "s0", "s1")


@query(f"WITH {A.SITES} SELECT chrom, start, CAST(strand AS INT) AS strand, CAST(PRINTF('%.6f', value) AS DOUBLE) AS value, CAST(context AS INT) AS context FROM st")
def results_levels(spark: SparkSession, d: str) -> DataFrame:
    lines = A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), fixed(F.col("value"), 6), _CONTEXT()))
    return results.parse_levels(lines).select("chrom", "start", F.col("strand").cast("int").alias("strand"), "value", F.col("context").cast("int").alias("context"))


@query(f"WITH {A.SITES} SELECT chrom, start, CAST(strand AS INT) AS strand, meth, CAST(coverage AS INT) AS coverage, 'x' AS id, value FROM st")
def results_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = A.sites(spark, d).select(_text(_C(), _S(), _STRAND(), _M(), _N(), "x"))
    return results.parse_counts(lines).withColumn("strand", F.col("strand").cast("int"))
