"""Region sets from BED, GTF, GFF and region strings; group maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.functions.sequence import clean_attribute
from methloom.schema import encode_strand
from methloom.sources.text import _at, _fields


def parse_bed(lines: DataFrame, fourth: str = "strand") -> DataFrame:
    """BED lines; column 4 is the strand (missing: '.') or, with ``fourth='name'``, the name."""
    f = _fields(lines)
    name = _at(4) if fourth == "name" else F.lit(None).cast("string")
    strand = encode_strand(F.coalesce(_at(4), F.lit("."))) if fourth == "strand" else F.coalesce(encode_strand(_at(6)), F.lit(2).cast("byte"))
    rid = F.concat(_at(1), F.lit(":"), _at(2), F.lit("-"), _at(3))
    out = f.select(rid.alias("region_id"), _at(1).alias("chrom"), _at(2, "long").alias("rs"), _at(3, "long").alias("re"), F.coalesce(strand, F.lit(2).cast("byte")).alias("strand"), name.alias("name"))
    return out.where("rs is not null and re is not null")


def read_bed(spark: SparkSession, path: str, fourth: str = "strand") -> DataFrame:
    return parse_bed(spark.read.text(path), fourth)


def numbered_regions(regions: DataFrame) -> DataFrame:
    """Regions in file order as ``region_idx`` (from 1) and ``region_%06d``."""
    from methloom.core import dense_index

    n = dense_index(regions.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "_g").drop("_at")
    idx = (F.col("_g") + 1).cast("int")
    return n.withColumn("region_idx", idx).withColumn("region_id", F.format_string("region_%06d", idx)).drop("_g")


def parse_gtf(lines: DataFrame) -> DataFrame:
    """GTF features of every type: the second attribute token, without quotes and semicolons, is the gene."""
    f = _fields(lines)
    gene = clean_attribute(_at(10))
    return f.select(gene.alias("region_id"), _at(1).alias("chrom"), _at(4, "long").alias("rs"), _at(5, "long").alias("re"), F.coalesce(encode_strand(_at(7)), F.lit(2).cast("byte")).alias("strand"), gene.alias("name")).where("rs is not null")


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF features of every type: the text between the first = and the next ; names the gene."""
    f = _fields(lines)
    gene = F.regexp_extract(F.concat_ws(" ", F.slice("f", 9, 100)), r"^[^=]*=([^;]+)", 1)
    return f.select(gene.alias("region_id"), _at(1).alias("chrom"), _at(4, "long").alias("rs"), _at(5, "long").alias("re"), F.coalesce(encode_strand(_at(7)), F.lit(2).cast("byte")).alias("strand"), gene.alias("name")).where("rs is not null")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def region_string(spark: SparkSession, text: str) -> DataFrame:
    """Regions of ``chrom:start-end[,strand];…``. The last colon parts the name, so names may hold '-'."""
    rows = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.fullmatch(r"(.+):(\d+)-(\d+)(?:,([+\-.]))?", part)
        if not m:
            raise ValueError(f"not a region: {part!r}")
        rows.append((part, m[1], int(m[2]), int(m[3]), {"+": 0, "-": 1}.get(m[4], 2), None))
    return spark.createDataFrame(rows, "region_id string, chrom string, rs long, re long, strand byte, name string")


def parse_group_map(lines: DataFrame) -> DataFrame:
    """Cell and group per line; a header line (cell, cell_id or cellid) is skipped. ``map_row`` keeps the order."""
    parts = F.split(F.trim("value"), r"\s+")
    out = lines.select(F.monotonically_increasing_id().alias("map_row"), F.get(parts, F.lit(0)).alias("cell_id"), F.get(parts, F.lit(1)).alias("group_label"))
    return out.where(F.col("group_label").isNotNull() & ~F.lower("cell_id").isin("cell", "cell_id", "cellid") & ~F.col("cell_id").startswith("#"))
