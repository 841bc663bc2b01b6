"""Operator 12: a mix of sources at target weights by systematic sampling. Built-in functions alone: no Python on executors."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Scratch

#: Weights of the sources in the order of their names, over and over; the share of all sizes that the mix takes; the most
#: that it takes of a source, in times its size.
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: A row's expected copies and an offset: no more digits than products with 10**17 rows keep exactly.
EXACT = "decimal(18,16)"
#: Columns that mix() adds.
ADDED = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for a null one: each word with the blanks behind it becomes one sign."""
    blank = " \t\n\x0b\x0c\r"
    signs = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.coalesce(F.char_length(F.translate(signs, blank, "")), F.lit(0)).cast("long")


def deal(rows: DataFrame, group: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with _cell: written in ranges of (group, order), so a group of any size spans many cells. Groups are not null."""
    cells = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.stash(rows.repartitionByRange(cells, *[F.col(g) for g in group], *order).withColumn("_cell", F.spark_partition_id()))


def before(dealt: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], facts: DataFrame | None = None) -> DataFrame:
    """dealt rows with each named sum over the rows of their group that stand before them; no task has all rows of a group.

    Where a group's cells start comes from their totals; the rows of one (group, cell) alone are walked through together.
    facts (one row a group) are joined to those starts, of which a group has one a cell.
    """
    whole = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_cell").agg(*[F.sum(x).alias(f"_sum_{n}") for n, x in sums.items()])
    starts = totals.select(*group, "_cell", *[F.coalesce(F.sum(f"_sum_{n}").over(whole), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    if facts is not None:
        starts = starts.join(facts, group)
    own = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, [*group, "_cell"])
    added = {n: F.col(f"_sum_{n}") + F.coalesce(F.sum(x).over(own), F.lit(0)) for n, x in sums.items()}
    return joined.withColumns(added).drop("_cell", *[f"_sum_{n}" for n in sums])


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, absent, source_size: one row a source) with target: what the mix takes of each source.

    Sources weigh by their place in the order of (absent, source). All share `share` of the total by weight, but none
    more than `most` times its size; what is above goes to the others by weight, until none is above. So a target is the
    lesser of that bound and one level times the weight, and the level is known where sources, ordered by bound over
    weight, stop being above it. share must not exceed most.
    """
    if share > most:
        raise ValueError(f"sources of {most} times their size cannot make {float(share)} times the total")
    names = [F.col("absent"), F.col("source")]
    placed = before(deal(sizes.withColumn("_all", F.lit(0)), ["_all"], names, scratch), ["_all"], names, {"_place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("_weight", weight.cast("long")).withColumn("_bound", most * F.col("source_size"))
    ratio = (F.col("_bound") / F.col("_weight")).alias("_ratio")
    weighed = scratch.stash(weighed.select("source", "absent", "source_size", "_all", "_weight", "_bound", ratio))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    if not total:
        return weighed.select("source", "absent", "source_size", F.lit(0.0).alias("target"))
    # what all sources of a lesser ratio leave, shared by the weight of the rest: the first that it fits sets the level
    by_ratio = [F.col("_ratio"), *names]
    ordered = before(deal(weighed, ["_all"], by_ratio, scratch), ["_all"], by_ratio, {"_bounds": F.col("_bound"), "_weights": F.col("_weight")})
    level = (F.lit(float(share * total)) - F.col("_bounds")) / (F.lit(all_weights) - F.col("_weights"))
    first = ordered.select("_ratio", level.alias("_level")).filter("_level <= _ratio").agg(F.min(F.struct("_ratio", "_level"))).first()[0]
    at = F.lit(float("inf") if first is None else first["_level"])
    return weighed.select("source", "absent", "source_size", F.least(F.col("_bound").cast("double"), at * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, key: str = "doc_id", weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = "0") -> DataFrame:
    """docs with size (its words), source_size and target (its source's), copies (how often the mix takes it: 0 to `most`).

    Systematic sampling: within a source, expected copies (target over size of the source, the same for each row) are
    summed up row by row from one offset, which a hash of the source and the seed draws; a row is taken once for each
    whole number that its part of the sum reaches or crosses. Rows are in the order of their size, then of a hash of the key,
    so what a source gives differs from its target by at most its largest size, whatever the offset.

    A source may be null (it is last, and no part of the others); texts that are null or without words have size 0 and
    are drawn like all others, as are rows without a key. Repeated rows are drawn each for itself; where rows are alike in
    source, size and key, it is open which of them is taken more often, so with equal rows reruns agree. An empty table
    gives no rows. Columns of docs named size, source_size, target or copies are replaced.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_mixed(docs, size, key, weights, share, most, seed, scratch))


def _mixed(docs: DataFrame, size: Column | None, key: str, weights, share: Fraction, most: int, seed: str, scratch: Scratch) -> DataFrame:
    kept = [c for c in docs.columns if c not in ADDED]
    size = word_count(F.col("text")) if size is None else size
    drawn = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    # the last part of the order tells equal rows apart, so that a cell need not hold all of them
    rows = docs.select(own, size.alias("_size"), F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_absent"), drawn.alias("_drawn"), F.monotonically_increasing_id().alias("_at"))
    group, order = ["_source", "_absent"], [F.col("_size"), F.col("_drawn"), F.col("_at")]
    dealt = deal(rows, group, order, scratch)
    sizes = scratch.stash(dealt.groupBy(F.col("_source").alias("source"), F.col("_absent").alias("absent")).agg(F.sum("_size").alias("source_size")))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    name = F.concat(F.lit(f"{seed}/"), F.col("source"), F.when(F.col("absent"), "/null").otherwise(""))
    offset = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(1 << 48)
    facts = targets(sizes, scratch, weights, share, most).select(
        F.col("source").alias("_source"), F.col("absent").alias("_absent"), "source_size", "target", each.cast(EXACT).alias("_each"), offset.cast(EXACT).alias("_offset")
    )
    placed = before(dealt, group, order, {"_rank": F.lit(1)}, facts)
    # as all rows of a source expect the same, the sum over those before is their number times that
    reach = lambda n: F.floor(n.cast("decimal(17,0)") * F.col("_each") + F.col("_offset"))
    copies = (reach(F.col("_rank") + 1) - reach(F.col("_rank"))).cast("int")
    return placed.select(*[F.col(f"_row.`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of mix()'s result, each as often as the mix takes it, with column copy from 0."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def digest(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the row, repeats counted), copies."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same rows in DuckDB's SQL; alone the order of rows alike in source, size and doc_id is open in both.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS absent, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT s, absent, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY absent, encode(s)) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight FROM s),
r AS (
  SELECT *, (2 * source_size) / weight AS ratio, CAST(sum(2 * source_size) OVER o - 2 * source_size AS BIGINT) AS bounds, CAST(sum(weight) OVER o - weight AS BIGINT) AS weights
  FROM w WINDOW o AS (ORDER BY (2 * source_size) / weight, absent, encode(s) ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s)::DOUBLE - bounds::DOUBLE) / ((SELECT sum(weight)::BIGINT FROM w) - weights)::DOUBLE AS level FROM r),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, absent, encode(s) LIMIT 1),
t AS (
  SELECT s, absent, source_size, CASE WHEN (SELECT sum(source_size) FROM s) = 0 THEN 0::DOUBLE ELSE least((2 * source_size)::DOUBLE, (SELECT level FROM f) * weight) END AS target FROM w),
e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN least(target / source_size, 2) ELSE 0 END AS DECIMAL(18,16)) AS each,
    CAST(('0x' || substr(md5('0/' || s || CASE WHEN absent THEN '/null' ELSE '' END), 1, 12))::BIGINT / 281474976710656 AS DECIMAL(18,16)) AS offset_ FROM t),
p AS (
  SELECT d.doc_id, d.size, e.*, row_number() OVER (PARTITION BY d.s, d.absent ORDER BY d.size, d.drawn) - 1 AS n FROM d JOIN e USING (s, absent)),
c AS (
  SELECT *, CAST(floor(CAST(n + 1 AS DECIMAL(20,0)) * each + offset_) - floor(CAST(n AS DECIMAL(20,0)) * each + offset_) AS INT) AS copies FROM p)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
