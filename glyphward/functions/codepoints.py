"""The names of all characters as a table of intervals, for joins: no Python on executors, no literal in the plan of each query."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import BIDI

#: Intervals end where blocks of so many code points do, so a character is looked for in those of its block alone.
BLOCK = 256
COLUMNS = "block int, first int, last int, name string, numbered boolean, unicode_category string"


@lru_cache(1)
def intervals() -> list[tuple[int, int, int, str, bool, str]]:
    """(block, first, last, name, numbered, general category) of all characters that have a name.

    A run of characters whose names are one text and their own numbers is one interval a block, numbered.
    """
    out: list[list] = []
    for cp in range(0x110000):
        c = chr(cp)
        name = BIDI.get(cp) or unicodedata.name(c, None)
        if name is None:
            continue
        number, category = f"-{cp:04X}", unicodedata.category(c)
        numbered = name.endswith(number)
        stem = name.removesuffix(number) if numbered else name
        if out and numbered and out[-1][4] and out[-1][2] == cp - 1 and cp % BLOCK and (out[-1][3], out[-1][5]) == (stem, category):
            out[-1][2] = cp
        else:
            out.append([cp // BLOCK, cp, cp, stem, numbered, category])
    return [tuple(r) for r in out]


def code_points(spark: SparkSession) -> DataFrame:
    """The intervals as a table: about 36,000 rows, the same whatever the data."""
    return spark.createDataFrame(intervals(), COLUMNS)


def with_names(df: DataFrame, ch: str = "ch", name: str = "name") -> DataFrame:
    """df with the name of the character in column ch: of the bidirectional controls, else of Unicode, else U+XXXX; null for null and
    for strings that are not one character.

    The table is broadcast; each character meets the intervals of its block.
    """
    one: Column = F.when(F.char_length(ch) == 1, F.conv(F.hex(F.encode(F.col(ch), "UTF-32")), 16, 10).cast("int"))
    own = df.withColumn("_cp", one)
    table = code_points(df.sparkSession).select(*[F.col(n).alias(f"_of_{n}") for n in ("block", "first", "last", "name", "numbered")])
    met = own.join(F.broadcast(table), (F.floor(F.col("_cp") / BLOCK).cast("int") == F.col("_of_block")) & F.col("_cp").between(F.col("_of_first"), F.col("_of_last")), "left")
    number = F.lpad(F.hex("_cp"), 4, "0")
    number = F.when(F.length(F.hex("_cp")) > 4, F.hex("_cp")).otherwise(number)
    named = F.when(F.col("_of_numbered"), F.concat("_of_name", F.lit("-"), number)).otherwise(F.coalesce("_of_name", F.concat(F.lit("U+"), number)))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_cp").isNotNull(), named).alias(name))
