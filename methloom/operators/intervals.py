"""Range joins, first matches, bins and windows over half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methloom.core import BROADCAST_BYTES, BROADCAST_ROWS, durable, row_bytes, small_side

#: Widths of join bins to choose from, in bases, and the least one where sites are wide too.
BINS, WIDE_BIN = (64, 256, 1024, 4096, 16_384, 65_536, 1 << 20), 1024


def overlaps(start: Column, end: Column, qs: Column, qe: Column, inclusive: bool = False) -> Column:
    """NOT (end <= qs OR start >= qe); ``inclusive`` queries one base more at the end."""
    return (end > qs) & (start < (qe + 1 if inclusive else qe))


def _ends(sites: DataFrame) -> Column:
    return F.col("end") if "end" in sites.columns else F.col("start") + 1


def range_join(sites: DataFrame, regions: DataFrame, inclusive: bool = False, bin_size: int | None = None, how: str = "inner", same_strand: bool = False) -> DataFrame:
    """All pairs of a site and a region (chrom, rs, re) of its chrom that it overlaps.

    Both sides are cut into bins and joined on (chrom, bin), so no pair is tested
    that shares no bin; a pair that shares several is kept in the later of the
    two first bins only. ``bin_size`` defaults to the least width of BINS at which the
    regions fill no more than four bins each on average, so that neither a bin
    holds many short regions nor a long region many bins. Regions are broadcast
    after the same count shows that they are few, else both sides shuffle on the
    bin, which spreads a chromosome over many tasks. Site columns come first; region columns that clash get ``r_`` before
    their names (chrom is not repeated). Null bounds or chroms and empty regions
    match nothing. ``how`` is 'inner' or 'left_semi' (sites in any region, once).
    With ``same_strand`` a region of strand 0 or 1 takes sites of its strand only; a
    region of any other strand (also null) takes all.
    """
    wide = "end" in sites.columns
    e = F.col("re") + (1 if inclusive else 0)
    taken = set(sites.columns) | {"_b", "_qs", "_qe", "_qb", "_qc", "_qst", "_id"}
    keep = [F.col(c).alias(c if c not in taken else f"r_{c}") for c in regions.columns if c != "chrom"] if how == "inner" else []
    q = regions.where((F.col("rs").isNotNull()) & (e > F.col("rs"))).select(
        F.col("chrom").alias("_qc"), F.col("rs").cast("long").alias("_qs"), e.cast("long").alias("_qe"), *([F.col("strand").alias("_qst")] if same_strand else []), *keep
    )
    size = F.col("_qe") - F.col("_qs")
    widths = dict.fromkeys((*BINS, bin_size) if bin_size else BINS)
    fit = q.agg(F.count(F.lit(1)).alias("n"), F.avg(row_bytes(q)).alias("bytes"), *(F.sum(F.floor((size + b - 1) / b) + 1).alias(f"b{b}") for b in widths)).first()
    if bin_size is None:
        least = WIDE_BIN if wide else 0
        bin_size = next((b for b in BINS if b >= least and (fit[f"b{b}"] or 0) <= 4 * max(fit.n, 1)), BINS[-1])
    cut = fit[f"b{bin_size}"] or 0  # rows after the cut into bins
    if cut <= 4 * BROADCAST_ROWS and cut * (fit.bytes or 0) <= BROADCAST_BYTES:
        q = F.broadcast(q)
    q = q.withColumn("_qb", F.explode(F.sequence(F.floor(F.col("_qs") / bin_size), F.floor((F.col("_qe") - 1) / bin_size))))
    first = F.floor(F.col("start") / bin_size)
    if wide:
        last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bin_size)
        s = sites.where("start is not null").withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.sequence(first, last)))
    else:
        s = sites.withColumn("_b", first)
    cond = (F.col("chrom") == F.col("_qc")) & (F.col("_b") == F.col("_qb")) & overlaps(F.col("start"), _ends(sites), F.col("_qs"), F.col("_qe"))
    if same_strand:
        cond = cond & ((F.coalesce(F.col("_qst"), F.lit(2)) > 1) | (F.col("strand") == F.col("_qst")))
    if wide:
        cond = cond & (F.col("_b") == F.greatest(first, F.floor(F.col("_qs") / bin_size)))
    if how == "left_semi":
        hit = s.join(q, cond, "left_semi").drop("_b")
        if not wide:
            return hit
        # A wide site can be hit in several bins; its number makes it one row again.
        return hit.groupBy("_id").agg(F.first(F.struct(*sites.columns)).alias("_r")).select("_r.*")
    return s.join(q, cond).drop("_b", "_qb", "_qc", "_qs", "_qe", "_qst", "_id")


def first_cover(regions: DataFrame, order: str, inclusive: bool = False) -> DataFrame:
    """The stretches between neighbouring bounds of the regions, each with the first region (least ``order``) that covers it; disjoint, so a position lies in one at most.

    Equal orders: the region of the least values. Columns: chrom, rs, re (of the
    stretch), and the regions' other columns.
    """
    e = F.col("re") + (1 if inclusive else 0)
    valid = regions.where(F.col("chrom").isNotNull() & F.col("rs").isNotNull() & (e > F.col("rs"))).withColumn("re", e)
    bounds = valid.select("chrom", F.explode(F.array(*(F.col(c).cast("long") for c in ("rs", "re")))).alias("start")).distinct()
    after = F.lead("start").over(Window.partitionBy("chrom").orderBy("start"))  # two rows per region
    cut = bounds.withColumn("end", after).where("end is not null")
    others = [c for c in regions.columns if c not in ("chrom", "rs", "re")]
    pairs = range_join(cut, valid.select("chrom", "rs", "re", *(F.col(c).alias(f"_o_{c}") for c in others)))
    best = pairs.groupBy("chrom", "start", "end").agg(F.min_by(F.struct(*(f"_o_{c}" for c in others)), F.struct(f"_o_{order}", *(f"_o_{c}" for c in others if c != order))).alias("_m"))
    return best.select("chrom", F.col("start").alias("rs"), F.col("end").alias("re"), *(F.col(f"_m._o_{c}").alias(c) for c in others))


def first_match(sites: DataFrame, regions: DataFrame, order: str, inclusive: bool = False) -> DataFrame:
    """Each site with the first region (least ``order``) that it overlaps; sites in none are dropped, repeated rows all stay.

    The regions are made disjoint first, each stretch with the region that wins
    there (``first_cover``), so a point site meets one stretch at most and nothing
    is grouped. Of a site with an end the least region of its stretches is taken,
    per distinct place, which its rows then look up. The region's own bounds are
    not given back.
    """
    cover = durable(first_cover(regions, order, inclusive))
    if "end" not in sites.columns:
        taken = set(sites.columns)
        return range_join(sites, cover).drop(*("r_rs" if "rs" in taken else "rs", "r_re" if "re" in taken else "re"))
    where = ["chrom", "start", "end"]
    pairs = range_join(sites.select(*where).distinct(), cover).drop("rs", "re")
    cols = [c for c in pairs.columns if c not in where]
    best = pairs.groupBy(*(F.col(c).alias(f"_m_{c}") for c in where)).agg(F.min_by(F.struct(*cols), F.struct(F.col(order), *(c for c in cols if c != order))).alias("_m"))
    taken = set(sites.columns)
    named = [F.col(f"_m.{c}").alias(c if c not in taken else f"r_{c}") for c in cols]
    joined = sites.join(best, [sites[c] == F.col(f"_m_{c}") for c in where])
    return joined.select(*(F.col(f"`{c}`") for c in sites.columns), *named)


def fixed_bins(sites: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """Sites with their bin (``bin_start``, ``bin_end`` clipped to the chromosome); sites beyond the length are dropped."""
    q = small_side(lengths.select(F.col("chrom").alias("_c"), F.col("length").cast("long").alias("_len")))
    b = F.floor(F.col("start") / size) * size
    joined = sites.join(q, (F.col("chrom") == F.col("_c")) & (F.col("start") >= 0) & (F.col("start") < F.col("_len")))
    return joined.withColumn("bin_start", b).withColumn("bin_end", F.least(b + size, F.col("_len"))).drop("_c", "_len")


def sliding_windows(sites: DataFrame, lengths: DataFrame, step: int, move: int) -> DataFrame:
    """Each site once per window [k move, min(k move + step, length)) that holds it (``rs``, ``re``).

    The windows of a site follow from arithmetic; nothing is joined but the
    chromosome's length.
    """
    q = small_side(lengths.select(F.col("chrom").alias("_c"), F.col("length").cast("long").alias("_len")))
    hi = F.floor(F.col("start") / move)
    lo = F.greatest(F.floor((F.col("start") - step) / move) + 1, F.lit(0))
    joined = sites.join(q, (F.col("chrom") == F.col("_c")) & (F.col("start") >= 0) & (F.col("start") < F.col("_len"))).where(lo <= hi)
    return (
        joined.withColumn("_k", F.explode(F.sequence(lo, hi)))
        .withColumn("rs", F.col("_k") * move).withColumn("re", F.least(F.col("_k") * move + step, F.col("_len"))).drop("_k", "_c", "_len")
    )


def region_windows(regions: DataFrame, bins: int, size: int, move: int) -> DataFrame:
    """The windows [rs + i move, rs + i move + size), i < bins, of each region (``bin``, and rs and re of the window)."""
    return (
        regions.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("_s", F.col("rs") + F.col("bin") * move).withColumn("rs", F.col("_s")).withColumn("re", F.col("_s") + size).drop("_s")
    )


def islands(df: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """Number the runs of positions with steps of at most ``gap`` within each ``by`` (``island``, unique over all).

    Positions are range partitioned by (by, at); the last row of each partition
    and its number of runs are carried to the later ones, so a chromosome is
    spread over tasks and only a row per partition is gathered. Ties in position
    fall into one run.
    """
    b = durable(df.where(F.col(at).isNotNull()).repartitionByRange(by, at).withColumn("_b", F.spark_partition_id()))
    w = Window.partitionBy("_b").orderBy(by, at)
    ends = b.groupBy("_b").agg(F.max(F.struct(by, at)).alias("_end"))
    before = ends.select("_b", F.lag("_end").over(Window.orderBy("_b")).alias("_prev"))  # one row per partition
    here = F.struct(F.col(by), F.col(at))
    x = b.join(F.broadcast(before), "_b").withColumn("_last", F.coalesce(F.lag(here).over(w), F.col("_prev")))
    joins = F.col(f"_last.{by}").eqNullSafe(F.col(by)) & (F.col(at) - F.col(f"_last.{at}") <= gap)
    x = x.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("long"))
    runs = x.groupBy("_b").agg(F.sum("_new").alias("_n"))
    earlier = runs.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_run", number).join(F.broadcast(earlier), "_b").withColumn("island", F.col("_run") + F.col("_off")).drop("_b", "_prev", "_last", "_new", "_run", "_off")
