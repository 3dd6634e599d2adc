"""Small helpers of the subpackage: tables in the shared folder, and batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

IN_MEMORY = 10.0  # how much larger than its file a table may be in memory
BATCH_ROWS = 256  # rows worked on at once: whole contracts travel in Arrow batches, which may have 10,000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a function makes of one of them stays small, whatever the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def scratch(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local()
    return f"{base.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def kept(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives an executor.

    The folder is removed when the driver's process ends, or by ``clear``, as results may read it until then.
    """
    spark = df.sparkSession
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor, "1.0")) < IN_MEMORY:
        spark.conf.set(factor, str(IN_MEMORY))  # else a file counts as small enough to broadcast by its compressed size
    path = scratch(spark)
    _WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


_WRITTEN: list[str] = []


@atexit.register
def clear() -> None:
    """Removes every table this process has written to the shared folder; results that read one are of no use afterwards."""
    from pyarrow import fs

    while _WRITTEN:
        try:
            where, inner = fs.FileSystem.from_uri(_WRITTEN.pop())
            where.delete_dir(inner)
        except (OSError, pa.ArrowException):
            continue  # gone already, or out of this process's reach
