"""Site tables from methylation text formats, and chromosome sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methloom.core import partitions_for
from methloom.schema import SITE, encode_context, encode_strand, fixed

FORMATS = ("methratio", "bedmethyl", "bedsimple", "bismark", "simpleme", "modkit_pileup")


def _fields(lines: DataFrame) -> DataFrame:
    """Non-comment lines split at white space (``f``), whatever the number of columns."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.where(~F.col("value").startswith("#")).select(F.split(text, " ").alias("f")).where(F.size("f") > 1)


def _at(i: int, kind: str | None = None) -> Column:
    c = F.get("f", F.lit(i - 1))
    return c if kind is None else c.try_cast(kind)


def parse_sites(
    lines: DataFrame, fmt: str, chrom: str | None = None, min_cover: int = 4, context: str = "ALL", signed: bool = False,
    default_context: str = "C", decimals: int = 4, mod_code: str = "m",
) -> DataFrame:
    """Site rows from lines of text (column ``value``) of one of FORMATS, with ``meth`` where the text has counts.

    Batch or streaming. Lines beginning with # are skipped, so are lines whose
    position or coverage isn't a number. ``min_cover``, ``chrom`` and ``context``
    filter; ``signed`` negates the level on the - strand. BED-like formats are
    shifted by one base, the others keep their positions. Formats without a
    context column get ``default_context``. Unknown strands and contexts become
    null; a coverage of 0 gives a null level.
    """
    f = _fields(lines)
    ratio = lambda m, c: m.cast("double") / F.when(c > 0, c).cast("double")
    none = F.lit(None)
    if fmt == "methratio":
        start, m, c = _at(2, "long"), _at(5, "long"), _at(6, "int")
        cols = (_at(1), start, start + 1, ratio(m, c), c, _at(3), _at(4), none.cast("string"), m)
    elif fmt == "bedmethyl":
        c = _at(10, "int")
        v = (_at(11, "float") / F.lit(100).cast("float")).cast("float")
        cols = (_at(1), _at(2, "long") + 1, _at(3, "long") + 1, v, c, _at(6), F.lit(default_context), _at(4), F.floor(v.cast("double") * c + 0.5).cast("long"))
    elif fmt == "bedsimple":
        m, c = _at(7, "long"), _at(8, "int")
        v = fixed(ratio(m, c), decimals).try_cast("double")
        cols = (_at(1), _at(2, "long"), _at(3, "long"), F.when(c > 0, v), c, _at(5), _at(6), _at(4), m)
    elif fmt == "bismark":
        start, m = _at(2, "long"), _at(4, "long")
        c = (m + _at(5, "long")).cast("int")
        cols = (_at(1), start, start + 1, ratio(m, c), c, _at(3), _at(6), none.cast("string"), m)
    elif fmt == "simpleme":
        start, c = _at(2, "long"), _at(4, "int")
        v = _at(3, "float")
        cols = (_at(1), start, start + 1, v, c, _at(5), _at(6), none.cast("string"), F.floor(v.cast("double") * c + 0.5).cast("long"))
    elif fmt == "modkit_pileup":
        name = F.split(_at(4), ",")
        c, m = _at(10, "int"), _at(12, "long")
        f = f.where((F.get(name, F.lit(0)) == mod_code) & (F.size(name) > 1) & m.isNotNull() & (c > 0))
        strand = F.when(_at(6) == ".", "+").otherwise(_at(6))
        cols = (_at(1), _at(2, "long") + 1, _at(3, "long") + 1, ratio(m, c), c, strand, F.get(name, F.lit(1)), none.cast("string"), m)
    else:
        raise ValueError(f"no format {fmt!r}; one of {', '.join(FORMATS)}")
    ch, s, e, v, c, strand, ctx, ident, m = cols
    st, cx = encode_strand(strand), encode_context(ctx)
    if signed:
        v = F.when(st == 1, -v).otherwise(v)
    out = f.select(
        ch.alias("chrom"), s.alias("start"), e.alias("end"), v.cast("float").alias("value"), c.alias("coverage"), st.alias("strand"), cx.alias("context"),
        F.when(ident != ".", ident).alias("id"), m.cast("long").alias("meth"),
    ).where(F.col("start").isNotNull() & (F.col("coverage") >= min_cover))
    if chrom is not None:
        out = out.where(F.col("chrom") == chrom)
    if context != "ALL":
        out = out.where(F.col("context") == encode_context(F.lit(context)))
    return out


def read_sites(spark: SparkSession, path: str | list[str], fmt: str, **options) -> DataFrame:
    return parse_sites(spark.read.text(path), fmt, **options)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome sizes (``chrom``, ``length``) of a two-column text."""
    f = _fields(spark.read.text(path))
    return f.select(_at(1).alias("chrom"), _at(2, "long").alias("length")).where("length is not null")


def chrom_dictionary(sizes: DataFrame, sites: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Numbered chromosomes (``tid``, from 0): by name, or, with sites, those that have some, by name first.

    ``order`` names a column of ``sites`` that grows along the input (``at`` of
    ``first_rows``): chromosomes then come in the order of their first row, and
    those without any follow by name.
    """
    from pyspark.sql import Window

    place = [F.col("_has").asc_nulls_last()] if sites is not None else []
    d = sizes
    if sites is not None:
        first = sites.groupBy("chrom").agg((F.min(order) if order else F.lit(1)).alias("_has"))
        d = sizes.join(first, "chrom", "left")
    return d.withColumn("tid", (F.row_number().over(Window.orderBy(*place, "chrom")) - 1).cast("int")).select("tid", "chrom", "length")  # one row per chromosome


def first_rows(lines: DataFrame) -> DataFrame:
    """Chromosomes (first field) of lines read from files, with ``at``, the file, stretch and place of their first line that is no comment."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = lines.where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+")[0].alias("chrom"), at.alias("at"))
    return rows.where("chrom <> ''").groupBy("chrom").agg(F.min("at").alias("at"))


def site_lines(sites: DataFrame, bed: bool = False) -> DataFrame:
    """Rows as tab-separated text (``value``) in the column order of the view command; levels with 6 decimals, NA where there is none."""
    from methloom.schema import decode_context, decode_strand, has

    cols: list[Column] = [F.col("chrom"), F.col("start").cast("string")]
    if has(sites, "end"):
        cols.append(F.col("end").cast("string"))
    elif bed:
        cols.append((F.col("start") + 1).cast("string"))
    cols.append(F.coalesce(fixed(F.col("value"), 6), F.lit("NA")))
    if has(sites, "coverage"):
        cols.append(F.col("coverage").cast("string"))
    if has(sites, "strand"):
        cols.append(decode_strand(F.col("strand")))
    if has(sites, "context"):
        cols.append(decode_context(F.col("context")))
    if has(sites, "id"):
        cols.append(F.col("id"))
    return sites.select(F.concat_ws("\t", *cols).alias("value"))


def write_sites(sites: DataFrame, path: str, files_per_chrom: int = 1) -> None:
    """The native table: Parquet by chromosome, sorted by position, so that row-group statistics prune ranges.

    Position ranges, not whole chromosomes, go to the tasks.
    """
    n = partitions_for(sites) * files_per_chrom
    sites.repartitionByRange(n, "chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    order = [f.name for f in SITE if f.name in df.columns]
    return df.select(*order, *(c for c in df.columns if c not in order))


def bedgraph_lines(sites: DataFrame, merge_strands: bool = False) -> DataFrame:
    """chrom, start, end, level; with ``merge_strands`` levels of the - strand are negative. Sites without level are left out."""
    v = F.when(F.col("strand") == 1, -F.col("value")).otherwise(F.col("value")) if merge_strands and "strand" in sites.columns else F.col("value")
    e = F.col("end") if "end" in sites.columns else F.col("start") + 1
    return sites.where(v.isNotNull()).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), e.cast("string"), fixed(v, 6)).alias("value"))
