"""Session helpers shared by the operators: shared scratch tables, row ranks, worker import path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROOT = str(Path(__file__).resolve().parents[2])


#: Rows and bytes of an Arrow batch at most, so that a batch of long texts stays small beside the heap.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes that are broadcast at most where sizes have no other bound.
BROADCAST = 64 << 20
#: Numbers that are broadcast at most as keys of a join (about 20 bytes each).
IDS = 2_000_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: --py-files), and bound batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only on a local master, where it is unset, a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glyphward-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one computation: stash() as above, drop() for those that are done with; all go when the block ends.

    The block's own result must be given through result(), which writes it first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def stash(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths[id(out)] = out, path
        return out

    def result(self, df: DataFrame) -> DataFrame:
        return stash(df)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])


def heavy(rows: DataFrame, key: str, share: float, least: int = 1000) -> DataFrame:
    """The values of key that at least this share of the rows have, and so many rows: 1 / share of them at most."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter(F.col("_n") >= max(least, total * share)).select(key)


def heavy_join(left: DataFrame, right: DataFrame, on: str | list[str], hot: DataFrame, weighed: str | None = None) -> DataFrame:
    """Inner join with right, which has one row a key; rows of the few hot keys meet broadcast rows where they stand.

    So no task gets all rows of a hot key. If column weighed of the hot keys' rows takes over BROADCAST bytes, all are shuffled.
    """
    if hot.isEmpty():
        return left.join(right, on)
    few = right.join(F.broadcast(hot), on, "left_semi")
    if weighed and (few.agg(F.sum(F.octet_length(weighed))).first()[0] or 0) > BROADCAST:
        return left.join(right, on)
    here = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on)
    return here.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


def only(rows: DataFrame, ids: DataFrame, key: str, out: bool = False) -> DataFrame:
    """The rows whose key is in ids, or with out those whose is not; nulls are in no ids.

    Up to IDS ids (a stashed table of that one column) are broadcast, so the rows, with their texts, stay where they are;
    beyond that both sides are shuffled.
    """
    few = ids.limit(IDS + 1).count() <= IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_anti" if out else "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])


def ranked(df: DataFrame, group: str, cell: str, order: list, out: str) -> DataFrame:
    """Adds out: the 0-based rank of each row in its group, by (cell, *order), without a task for a group.

    Only rows of one (group, cell) are sorted together; the starts of cells come from their counts.
    """
    counts = df.groupBy(group, cell).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        F.col(group).alias("_g"),
        F.col(cell).alias("_c"),
        (F.sum("_n").over(Window.partitionBy(group).orderBy(cell)) - F.col("_n")).alias("_start"),
    )
    joined = df.join(starts, (F.col(group) == F.col("_g")) & (F.col(cell) == F.col("_c")))
    here = F.row_number().over(Window.partitionBy(group, cell).orderBy(*order))
    return joined.withColumn(out, F.col("_start") + here - 1).drop("_g", "_c", "_start")
