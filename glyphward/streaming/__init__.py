"""The scan of a stream: a stateless projection, the same expressions as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan
from ..tables import ScanOptions

#: The folders of a split stream: rows that are dangerous, and all others.
KEPT, QUARANTINED = "clean", "quarantine"


def scan_stream(stream: DataFrame, text: str = "text", options: ScanOptions = ScanOptions(), prefix: str = "") -> DataFrame:
    """scan() of a streaming DataFrame; needs no watermark, keeps no state."""
    return scan(stream, text, options, prefix)


def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a scanned stream to Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def splitter(root: str, prefix: str = "") -> Callable[[DataFrame, int], None]:
    """What start_split() does with a scanned batch and its number: one write, so one scan, for both tables.

    A batch is a folder of its own, so a batch that comes again replaces itself and changes nothing.
    """

    def split(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col(f"{prefix}dangerous"), QUARANTINED).otherwise(KEPT)
        batch.withColumn("table", kind).write.mode("overwrite").partitionBy("table").parquet(f"{root}/batch={number}")

    return split


def start_split(stream: DataFrame, root: str, checkpoint: str, prefix: str = "", **trigger) -> StreamingQuery:
    """Write a scanned stream to two tables under root, the dangerous rows and the others; see table()."""
    return stream.writeStream.foreachBatch(splitter(root, prefix)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def table(spark: SparkSession, root: str, which: str = KEPT) -> DataFrame:
    """A table of a split stream, KEPT or QUARANTINED, with column batch; the other's files are not read."""
    if which not in (KEPT, QUARANTINED):
        raise ValueError(f"tables {KEPT} and {QUARANTINED}; not {which!r}")
    return spark.read.parquet(root).filter(F.col("table") == which).drop("table")
