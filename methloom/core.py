"""Shared plumbing: durable cuts of lineage, size-checked broadcasts, dense row numbers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension table up to this many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Bytes of a row that a task's share of a shuffle is reckoned with.
TASK_BYTES = 128 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="methloom-code-")) / "methloom_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary one serves a local master only; on a cluster
    each executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="methloom-"))
    return sc.getCheckpointDir()


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` wrote in this process, once their results have been used; gives their number."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame) -> str:
    """Write ``df`` as a Parquet table in the shared folder; gives its path, which ``release`` deletes."""
    path = f"{shared_dir(df.sparkSession)}/methloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors; columnar and
    compressed, so later steps read only the columns they use. ``release`` deletes
    the tables of a session.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def table_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table of the shared folder in batches of ``rows``, read within a Python worker."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if ":" in path else (fs.LocalFileSystem(), path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    held: list[pa.RecordBatch] = []
    for b in ds.dataset(files, filesystem=system, format="parquet").to_batches() if files else ():
        while len(b):
            take = b.slice(0, rows - sum(map(len, held)))
            held.append(take)
            b = b.slice(len(take))
            if sum(map(len, held)) == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_bytes(df: DataFrame) -> Column:
    """A row's size as a join holds it: 16 bytes a column, and the length of texts, binaries and collections."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size.cast("long")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, otherwise: str | None = None) -> DataFrame:
    """Hint a broadcast only if at most ``max_rows`` rows of together at most ``max_bytes`` are seen; else leave the join to Catalyst, or hint ``otherwise``.

    Of what a Python function makes Catalyst knows no size and may still broadcast it, which "merge" prevents.
    """
    seen = df.select(row_bytes(df).alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    if seen.n <= max_rows and (seen.b or 0) <= max_bytes:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def partitions_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of all of ``df``: by the size of what it reads, not less than the session's setting, 20,000 at most.

    The sources' sizes are added up as the optimizer knows them (a join's own
    estimate is a product); files are compressed, which a factor of 4 allows for. A
    source of unknown size counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(n for n in sizes if n < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-4 * size // task_bytes)))


def dense_index(df: DataFrame, order: list, name: str = "_g") -> DataFrame:
    """Globally sort ``df`` and number its rows 0, 1, 2, … in that order.

    A range-partitioned sort gives each row a (partition, place) pair; the rows
    of earlier partitions are added from a table with one row per partition, the
    only thing that is broadcast. No group is gathered in one task.
    The sorted rows are written once, so that the numbers can't differ between
    the counting and the use.
    """
    at = durable(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    sizes = at.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    rows = sorted((r._pid, r._n) for r in sizes.collect())  # one row per partition
    before, total = [], 0
    for p, n in rows:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_pid long, _before long")
    return (
        at.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_pid", "_before", "_mid")
    )
