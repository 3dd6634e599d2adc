"""Files as a resumable stream: the position is the query's checkpoint, so a restart goes on where the last run ended."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(value, file): each file of a folder as one row, new files as they come."""
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder).withColumn("file", F.input_file_name())


def append_available(rows: DataFrame, target: str, checkpoint: str, kind: str = "parquet") -> None:
    """Appends all that is there and not yet done to ``target``; each row gets there once."""
    rows.writeStream.format(kind).option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(rows: DataFrame, into, checkpoint: str) -> None:
    """Gives every finished batch, with its number, to ``into``."""
    rows.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def after(rows: DataFrame, file_index: int, chunk_index: int) -> DataFrame:
    """The batch form of resuming: rows behind a position (file_index, chunk_index)."""
    return rows.filter((F.col("file_index") > file_index) | ((F.col("file_index") == file_index) & (F.col("chunk_index") > chunk_index)))


def seeded_order(paths: DataFrame, seed: int, parts: int = 1, path: str = "path") -> DataFrame:
    """Paths in a seeded order that doesn't depend on how they were listed: ``lot`` sorts them, ``part`` divides them among readers."""
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(path)))
    return paths.withColumn("lot", lot).withColumn("part", F.pmod(F.conv(F.substring("lot", 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spanloom-stream-"))
        base = "file://" + _LOCAL[0]
    _WRITTEN.append(f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


_LOCAL: list[str] = []
_WRITTEN: list[str] = []


@atexit.register
def clear() -> None:
    """Removes every folder that ``scratch`` gave out in this process."""
    from pyarrow import fs

    for path in [*_WRITTEN, *(f"file://{p}" for p in _LOCAL)]:
        try:
            where, inner = fs.FileSystem.from_uri(path)
            where.delete_dir(inner)
        except (OSError, ValueError):
            continue  # never written, or out of this process's reach
    _WRITTEN.clear()
    _LOCAL.clear()


def read_twice(rows: DataFrame, schema: str) -> DataFrame:
    """Rows written as files in two lots, each followed by a run of the same stream; what the runs appended."""
    spark = rows.sparkSession
    at = scratch(spark)
    for lot in (0, 1):
        rows.filter(F.pmod(F.xxhash64(rows.columns[0]), F.lit(2)) == lot).write.mode("append").parquet(f"{at}/in")
        append_available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(schema).parquet(f"{at}/out")
