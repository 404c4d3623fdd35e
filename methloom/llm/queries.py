"""Queries of the training-data operators over the driver tables, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import durable, table
from methloom.functions.clean import clean_chrom, clean_context
from methloom.llm.bpe import encode_corpus
from methloom.llm.chunking import split_long_texts
from methloom.llm.leakage import find_leaks, without_leaks
from methloom.llm.percentiles import combine_states, exact_percentiles, value_states
from methloom.llm.spectral import cell_pairs, cell_table, group_summary, groups_and_meetings, purified, spectral_groups
from methloom.operators.imputation import count_or_null

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _cells(spark: SparkSession, d: str, unnamed: bool = False) -> DataFrame:
    return cell_table(table(spark, d, "sc_matrix"), table(spark, d, "sc_qc"), unnamed)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups, meetings = groups_and_meetings(_cells(spark, d))
    return cell_pairs(groups, meetings=meetings)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_summary(purified(spectral_groups(_cells(spark, d, unnamed=True))))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "site_proportions")
    name = F.col("site_name")
    by = {"chrom": clean_chrom(F.col("chrom"), name), "context": clean_context(F.col("context"), name)}
    return value_states(t, by | {"sample_id": "sample_id"}, count_or_null("total"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of total per chrom and context, of each sample and, combined from the samples' states, of all ('(all)')."""
    by = ["sample_id", "chrom", "context"]
    single = durable(_totals(spark, d))
    whole = combine_states(single, ["chrom", "context"]).withColumn("sample_id", F.lit("(all)"))
    return exact_percentiles(single.unionByName(whole), by, PROBS)


def p2_sample_medians(spark: SparkSession, d: str) -> DataFrame:
    return exact_percentiles(combine_states(_totals(spark, d), ["sample_id", "context"]), ["sample_id", "context"], [0.5])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return without_leaks(docs, "doc_id", _leaks(spark, d)).select("doc_id", "thread_id", "lang", "n_chars")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_long_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The same per run day and context, of each day and of all days combined."""
    t = table(spark, d, "site_proportions")
    by = {"run_day": F.date_format("run_at", "yyyy-MM-dd"), "context": clean_context(F.col("context"), F.col("site_name"))}
    single = durable(value_states(t, by, count_or_null("total")))
    whole = combine_states(single, ["context"]).withColumn("run_day", F.lit("(all)"))
    return exact_percentiles(single.unionByName(whole), ["run_day", "context"], PROBS)


def p2_day_chrom_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of total per chrom and context, of each run day and, combined from the days' states, of all days ('(all)')."""
    t = table(spark, d, "site_proportions")
    name = F.col("site_name")
    by = {"run_day": F.date_format("run_at", "yyyy-MM-dd"), "chrom": clean_chrom(F.col("chrom"), name), "context": clean_context(F.col("context"), name)}
    single = durable(value_states(t, by, count_or_null("total")))
    whole = combine_states(single, ["chrom", "context"]).withColumn("run_day", F.lit("(all)"))
    return exact_percentiles(single.unionByName(whole), ["run_day", "chrom", "context"], PROBS)


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_percentiles, p2_day_percentiles, p2_day_chrom_percentiles, p2_sample_medians, p6_ids, p7_found, p7_matches, p7_clean, p8_found, p8_pieces)}

_TOTALS = """
WITH q AS (SELECT sample_id, STRFTIME(run_at, '%Y-%m-%d') AS run_day, COALESCE(CASE WHEN TRIM(chrom) <> '' THEN chrom END, SPLIT_PART(site_name, ':', 1)) AS chrom,
    CASE UPPER(TRIM(COALESCE(CASE WHEN TRIM(context) <> '' THEN context END, SPLIT_PART(site_name, ':', 4)))) WHEN 'CPG' THEN 'CG'
      ELSE UPPER(TRIM(COALESCE(CASE WHEN TRIM(context) <> '' THEN context END, SPLIT_PART(site_name, ':', 4)))) END AS context, CAST(total AS DOUBLE) AS v
  FROM site_proportions WHERE total >= 0)"""
_PROBS = "(VALUES " + ", ".join(f"(CAST({p} AS DOUBLE))" for p in PROBS) + ") AS ps(prob)"

def _percentiles_sql(by: str) -> str:
    """By linear interpolation between the order statistics at floor and ceil of prob (n - 1), for the rows of ``u``."""
    same = lambda x: " AND ".join(f"{x}.{c} = t.{c}" for c in by.split(", "))
    return f"""r AS (SELECT {by}, v, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY v) - 1 AS i, COUNT(*) OVER (PARTITION BY {by}) AS n FROM u),
t AS (SELECT {by}, prob, n, prob * (n - 1) AS h, CAST(FLOOR(prob * (n - 1)) AS BIGINT) AS lo FROM (SELECT DISTINCT {by}, n FROM r) g, {_PROBS})
SELECT {", ".join(f"t.{c}" for c in by.split(", "))}, t.prob, t.n, CASE WHEN b.v IS NULL OR t.h = t.lo OR a.v = b.v THEN a.v ELSE a.v + (b.v - a.v) * (1 - (1 - (t.h - t.lo))) END AS value, CAST(0 AS DOUBLE) AS max_error
FROM t JOIN r a ON {same("a")} AND a.i = t.lo LEFT JOIN r b ON {same("b")} AND b.i = t.lo + 1"""


SQL = {
    "p2_percentiles": f"""{_TOTALS},
u AS (SELECT sample_id, chrom, context, v FROM q UNION ALL SELECT '(all)', chrom, context, v FROM q),
{_percentiles_sql("sample_id, chrom, context")}""",
    "p2_day_percentiles": f"""{_TOTALS},
u AS (SELECT run_day, context, v FROM q UNION ALL SELECT '(all)', context, v FROM q),
{_percentiles_sql("run_day, context")}""",
    "p2_day_chrom_percentiles": f"""{_TOTALS},
u AS (SELECT run_day, chrom, context, v FROM q UNION ALL SELECT '(all)', chrom, context, v FROM q),
{_percentiles_sql("run_day, chrom, context")}""",
    "p2_sample_medians": f"""{_TOTALS}
SELECT sample_id, context, CAST(0.5 AS DOUBLE) AS prob, COUNT(*) AS n, QUANTILE_CONT(v, 0.5) AS value, CAST(0 AS DOUBLE) AS max_error FROM q GROUP BY sample_id, context""",
}
