"""The site and region tables.

A site table has chrom, start, end (half-open, ``start + 1`` for point sites),
value (level), and optionally coverage, strand, context, id and meth (the
methylated count, where the source has it). Optional columns are absent as a
whole; operators ask ``has`` before they use one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE = T.StructType(
    [
        T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("value", T.FloatType()), T.StructField("coverage", T.IntegerType()), T.StructField("strand", T.ByteType()),
        T.StructField("context", T.ByteType()), T.StructField("id", T.StringType()),
    ]
)
REGION = T.StructType(
    [
        T.StructField("region_id", T.StringType()), T.StructField("chrom", T.StringType()), T.StructField("rs", T.LongType()),
        T.StructField("re", T.LongType()), T.StructField("strand", T.ByteType()), T.StructField("name", T.StringType()),
    ]
)

#: The codes of strands and contexts.
STRANDS = ("+", "-", ".")
CONTEXTS = ("C", "CG", "CHG", "CHH")
BOTH_STRANDS, ALL_CONTEXTS = 2, 4


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def _code(c: Column, names: tuple[str, ...]) -> Column:
    out = F.when(c == names[0], F.lit(0))
    for i, n in enumerate(names[1:], 1):
        out = out.when(c == n, F.lit(i))
    return out.cast("byte")


def _name(c: Column, names: tuple[str, ...]) -> Column:
    out = F.when(c == 0, F.lit(names[0]))
    for i, n in enumerate(names[1:], 1):
        out = out.when(c == i, F.lit(n))
    return out


def encode_strand(c: Column) -> Column:
    """0 for +, 1 for -, 2 for . ; null for anything else."""
    return _code(F.trim(c), STRANDS)


def encode_context(c: Column) -> Column:
    """0 C, 1 CG, 2 CHG, 3 CHH (upper or lower case, blanks trimmed); null for anything else."""
    return _code(F.upper(F.trim(c)), CONTEXTS)


def decode_strand(c: Column) -> Column:
    return _name(c, STRANDS)


def decode_context(c: Column) -> Column:
    return _name(c, CONTEXTS)


def cover_c(value: Column, coverage: Column, precision: str = "double") -> Column:
    """The methylated count value * coverage, rounded half up and truncated.

    ``precision`` 'float' multiplies in single precision, as region statistics
    are defined; 'double' as merges, overlaps and tests are.
    """
    if precision == "float":
        product = value.cast("float") * coverage.cast("float")
    else:
        product = value.cast("double") * coverage.cast("double")
    return F.floor(product.cast("double") + 0.5).cast("long")


def meth_count(df: DataFrame, precision: str = "double") -> Column:
    """The methylated count: the source's own where the table has ``meth``, else reconstructed."""
    return F.col("meth").cast("long") if has(df, "meth") else cover_c(F.col("value"), F.col("coverage"), precision)


def fixed(c: Column, decimals: int) -> Column:
    """The number as text with so many decimals, rounded as C's printf does: by the exact binary value, exact ties to the even digit.

    The product with the power of ten is taken with its rounding error (both
    factors are split in halves whose products are exact), which tells on which
    side of a tie the value lies. Values of 1e9 and more, which have no room for
    that, are rounded by their shortest decimal form. Null stays null.
    """
    x, scale = F.abs(c.cast("double")), 10.0**decimals
    half = 134_217_729.0  # 2 ** 27 + 1
    scale_high = scale * half - (scale * half - scale)

    def near(v: Column) -> Column:
        high, p = v * half - (v * half - v), v * scale
        error = ((high * scale_high - p) + high * (scale - scale_high) + (v - high) * scale_high) + (v - high) * (scale - scale_high)
        up = (error > 0) | ((error == 0) & (F.floor(p) % 2 == 1))
        return (F.floor(p) + F.when(up, 1).otherwise(0)).cast("double") / scale

    # Only what may be a tie needs the error; as a function of an array's element it stays out of the generated code.
    rest = x * scale - F.floor(x * scale)
    other = (F.floor(x * scale) + F.when(rest > 0.5, 1).otherwise(0)).cast("double") / scale
    text = F.format_string(f"%.{decimals}f", F.when(x >= 1e9, F.bround(x, decimals)).when(rest == 0.5, F.transform(F.array(x), near)[0]).otherwise(other))
    # A negative zero keeps its sign.
    negative = (c.cast("double") < 0) | ((c.cast("double") == 0) & c.cast("string").startswith("-"))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(negative, F.concat(F.lit("-"), text)).otherwise(text)
