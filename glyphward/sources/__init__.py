"""Texts from files, strings and tables, and results to files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, newlines: bool = True) -> DataFrame:
    """(path, text) of whole files: bad UTF-8 is replaced, a byte-order mark stays; newlines: CRLF and CR become LF."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if newlines:
        text = F.regexp_replace(text, "\r\n?", "\n")
    return spark.read.format("binaryFile").load(path).select("path", text.alias("text"))


def read_text(spark: SparkSession, *texts: str | None) -> DataFrame:
    """(doc_id, text) of strings given inline."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column of JSON, SARIF or reports as text files."""
    df.select(F.col(column).alias("value")).write.text(path)


#: Bytes up to which a table counts as small.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores if it is small: a small file is often one row group, which one task reads alone.

    Larger tables have many row groups and stay as they are read. The condition, which all rows meet, is not the same for
    two runs in the optimizer's eyes, so it moves no later filter below the deal, where one task would do its work.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism).filter(F.monotonically_increasing_id() >= 0)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir and read from there: worked out once, however often it is used.

    Where that is unset, a local master takes a temporary folder; any other is a ValueError.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="glyphward-"))
    return df.checkpoint()
