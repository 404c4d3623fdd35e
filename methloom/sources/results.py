"""Readers of the result texts, for comparisons and plots: levels, counts, profile matrices and averages, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methloom.schema import encode_context, encode_strand


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where((F.size("f") > 1) & ~F.col("f")[0].startswith("#"))


def _at(i: int, kind: str = "string") -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def _level(c: Column) -> Column:
    """The number, null for NA, nan and anything else that is none."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def parse_levels(lines: DataFrame) -> DataFrame:
    """Lines of chromosome, position, strand, level and context, as of chromosome bins: chrom, start, strand, value, context (codes); rows without level are dropped."""
    out = _fields(lines).select(_at(0).alias("chrom"), _at(1, "long").alias("start"), encode_strand(_at(2)).alias("strand"), _level(_at(3)).alias("value"), encode_context(_at(4)).alias("context"))
    return out.where("start is not null and value is not null")


def parse_counts(lines: DataFrame) -> DataFrame:
    """Lines of chromosome, position, strand, methylated count, coverage [strand] and an id: chrom, start, strand, meth, coverage, id, value; rows without coverage are dropped."""
    ident = F.element_at("f", -1)
    out = _fields(lines).where(F.size("f") >= 6).select(_at(0).alias("chrom"), _at(1, "long").alias("start"), encode_strand(_at(2)).alias("strand"), _at(3, "long").alias("meth"), _at(4, "int").alias("coverage"), ident.alias("id"))
    return out.where("start is not null and coverage > 0").withColumn("value", F.col("meth").cast("double") / F.col("coverage").cast("double"))


def parse_view(lines: DataFrame, context: str | None = None) -> DataFrame:
    """Lines of the text view with end, coverage, strand and context: chrom, start, end, value, coverage, strand, context (codes).

    ``context`` keeps one; 'All' keeps all that have one.
    """
    out = _fields(lines).select(
        _at(0).alias("chrom"), _at(1, "long").alias("start"), _at(2, "long").alias("end"), _level(_at(3)).alias("value"), _at(4, "int").alias("coverage"), encode_strand(_at(5)).alias("strand"), encode_context(_at(6)).alias("context"),
    ).where("start is not null")
    if context is None:
        return out
    return out.where(F.col("context") != 0) if context == "All" else out.where(F.col("context") == encode_context(F.lit(context)))


def parse_matrix(lines: DataFrame, missing: float | None = None) -> DataFrame:
    """Profile matrices: region and a level per bin, as rows (region_id, bin, level); nan is ``missing``."""
    f = _fields(lines).select(F.col("f")[0].alias("region_id"), F.posexplode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("bin", "t"))
    return f.select("region_id", "bin", F.coalesce(_level(F.col("t")), F.lit(missing).cast("double")).alias("level"))


def parse_average(lines: DataFrame) -> DataFrame:
    """Profile averages: context and a level per bin, as rows (context, bin, level)."""
    m = parse_matrix(lines)
    return m.select(encode_context(F.col("region_id")).alias("context"), "bin", "level").where("context is not null")


def parse_histogram(lines: DataFrame) -> DataFrame:
    """Histograms as written by ``stats``: lines of a bin and its values, a head line being left out (bin, values)."""
    f = _fields(lines).where(_at(1, "double").isNotNull())
    return f.select(_at(0).alias("bin"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda t: t.try_cast("double")).alias("values"))
