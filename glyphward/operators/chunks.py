"""Scanning texts larger than a task: pieces are scanned apart, and small summaries of them are joined by a prefix scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import bind
from ..functions.unicode import DANGEROUS, LINE_ENDS, SIGNS, unicode_findings, walked
from ..sources import settled
from ..tables import UnicodeScanOptions
from .scan import regions

#: Chunks of a text whose summaries are walked through together; a text's cells of so many are added up before.
CELL = 4096
#: Findings of a chunk that are placed one by one, each with a look at the text up to there.
FEW = 32


def cut(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk (from 0), text: each text in pieces of size code points. Null and empty texts are one piece."""
    whole = F.col(f"`{text}`")
    last = F.floor((F.coalesce(F.char_length(whole), F.lit(0)) - 1) / size)
    at = df.select(key, whole.alias("_whole"), F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).alias("chunk"))
    return at.select(key, F.col("chunk").cast("long").alias("chunk"), F.substr("_whole", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def _piece(signs: Column) -> Column:
    """struct<e, e_low, i, i_low>: what the embeddings and isolates of a line's part add up to, and the least on the way."""
    e, i = walked(signs, "‪‫‭‮", "‬"), walked(signs, "⁦⁧⁨", "⁩")
    return F.struct(e["n"].alias("e"), e["low"].alias("e_low"), i["n"].alias("i"), i["low"].alias("i_low"))


def summaries(chunks: DataFrame, key: str = "doc_id", options: UnicodeScanOptions = UnicodeScanOptions()) -> DataFrame:
    """A row for each of the chunks (key, chunk, text), without its text: lengths, line ends, bidirectional sums, findings. Written once.

    findings have line and column as if the chunk were the text. breaks: whether a line that counts for bidirectional signs ends
    in it; head and tail: the sums before the first such end (or of all) and behind the last; bad: a line between them is unbalanced.
    """
    return settled(_summed(chunks, key, options))


def _summed(chunks: DataFrame, key: str, options: UnicodeScanOptions) -> DataFrame:
    """summaries() before they are written; signs and findings have columns of their own, so that each is worked out once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.col("_found")
    own = chunks.select(key, F.col("chunk").cast("long").alias("chunk"), text.alias("text"), unicode_findings(text, options).alias("_found"))
    # lines without signs are balanced: of each run of line ends the first and the last stay, and of a chunk without signs any one
    kept = F.regexp_replace(F.regexp_replace("text", f"[^{SIGNS}{LINE_ENDS}]+", ""), f"([{LINE_ENDS}])[{LINE_ENDS}]*([{LINE_ENDS}])", "$1$2")
    kept = F.when(F.col("text").rlike(f"[{SIGNS}]"), kept).when(F.col("text").rlike(f"[{LINE_ENDS}]"), "\n").otherwise("")
    own, signs = own.withColumn("_signs", F.split(kept, f"[{LINE_ENDS}]", -1)), F.col("_signs")
    inner = F.slice(signs, 2, F.greatest(F.size(signs) - 2, F.lit(0)))
    off = lambda p: (p["e"] != 0) | (p["i"] != 0) | (p["e_low"] < 0) | (p["i_low"] < 0)
    head = lambda x: F.substr(F.col("text"), F.lit(1), x["offset"])
    line = lambda h: F.struct((F.char_length(h) - F.char_length(F.translate(h, "\n", "")) + 1).alias("line"), (F.char_length(F.substring_index(h, "\n", -1)) + 1).alias("column"))
    few = F.transform(found, lambda x: bind(F.struct(x.alias("x"), line(head(x)).alias("r")), lambda v: F.struct(v["x"].alias("found"), v["r"]["line"].alias("line"), v["r"]["column"].alias("column"))))
    many = F.zip_with(found, F.when(F.size(found) > 0, regions(F.col("text"), found)), lambda x, r: F.struct(x.alias("found"), r["line"].alias("line"), r["column"].alias("column")))
    return own.select(
        key, "chunk", F.char_length("text").cast("long").alias("chars"), (F.char_length("text") - F.char_length(F.translate("text", "\n", ""))).cast("long").alias("lines"),
        F.char_length(F.substring_index("text", "\n", -1)).cast("long").alias("rest"), (F.size(signs) > 1).alias("breaks"), _piece(F.element_at(signs, 1)).alias("head"),
        F.when(F.size(signs) > 1, _piece(F.element_at(signs, -1))).alias("tail"), F.exists(F.transform(inner, _piece), off).alias("bad"), F.when(F.size(found) > FEW, many).when(F.size(found) > 0, few).alias("findings"),
    )


def carried(parts: DataFrame, key: str, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """parts with each named value of the chunks before it, added up ("sum") or the greatest ("max"); 0 for the first.

    In two levels, so a text of very many chunks is no single task's: cells of CELL chunks, and within them chunk by chunk.
    """
    how = {"sum": F.sum, "max": F.max}
    celled = parts.withColumn("_cell", F.floor(F.col("chunk") / CELL))
    before = lambda order, *of: Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(F.col(key).alias("_key"), F.col("_cell").alias("_c")).agg(*[how[h](x).alias(n) for n, (x, h) in values.items()])
    starts = cells.select("_key", "_c", *[how[h](n).over(before("_c", "_key")).alias(f"_cell_{n}") for n, (_, h) in values.items()])
    joined = celled.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_c")))
    none = F.lit(0)
    here = {n: (F.coalesce(how[h](x).over(before("chunk", key, "_cell")), none), F.coalesce(F.col(f"_cell_{n}"), none)) for n, (x, h) in values.items()}
    return joined.select(*[F.col(f"`{c}`") for c in parts.columns], *[(a + b if values[n][1] == "sum" else F.greatest(a, b)).cast("long").alias(n) for n, (a, b) in here.items()])


def _based(parts: DataFrame, key: str) -> DataFrame:
    """parts with start, lines_before and line_start (code points and line ends of the text before the chunk, and where its first line starts)."""
    placed = carried(parts, key, {"start": (F.col("chars"), "sum"), "lines_before": (F.col("lines"), "sum")})
    return carried(placed, key, {"line_start": (F.when(F.col("lines") > 0, F.col("start") + F.col("chars") - F.col("rest")), "max")})


def chunk_findings(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, offset, line, column (longs, in the whole text), char, codepoint and all else of each finding of summaries().

    As scan() and sarif_results() have them of the text as one row. Null keys are one key.
    """
    rows = _based(parts.select(key, "chunk", "chars", "lines", "rest", "findings"), key).filter("findings is not null")
    each = rows.select(key, "start", "lines_before", "line_start", F.explode("findings").alias("_f"))
    names = ("char", "codepoint", "name", "category", "unicode_category", "severity", "action", "replacement", "detail")
    column = F.when(F.col("_f.line") == 1, F.col("start") - F.col("line_start") + F.col("_f.column")).otherwise(F.col("_f.column"))
    return each.select(
        key, (F.col("start") + F.col("_f.found.offset")).alias("offset"), (F.col("lines_before") + F.col("_f.line")).alias("line"), column.cast("long").alias("column"), *[F.col(f"_f.found.{n}").alias(n) for n in names]
    )


def chunk_verdicts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, dangerous, unbalanced, n_chars, n_lines, n_findings, counts: one row a text of summaries().

    unbalanced: as unbalanced_bidi() has it; a line may begin in one chunk and end in any later one. counts: findings by category.
    """
    kinds = parts.select(key, F.explode("findings").alias("_f")).groupBy(key, F.col("_f.found.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    listed = kinds.groupBy(F.col(key).alias("_k")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"), F.sum("n").alias("n_findings"), F.max(F.col("category").isin(*DANGEROUS)).alias("dangerous")
    )
    sizes = parts.groupBy(key).agg(F.sum("chars").alias("n_chars"), (F.sum("lines") + 1).alias("n_lines"), F.max("bad").alias("bad"))
    lines = _lines(parts, key).withColumnRenamed(key, "_l")
    out = sizes.join(listed, F.col(key).eqNullSafe(F.col("_k")), "left").join(lines, F.col(key).eqNullSafe(F.col("_l")), "left")
    return out.select(
        key, F.coalesce("dangerous", F.lit(False)).alias("dangerous"), (F.col("bad") | F.coalesce("off", F.lit(False))).alias("unbalanced"), "n_chars", "n_lines",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"),
    )


def _lines(parts: DataFrame, key: str) -> DataFrame:
    """key, off: whether a line that more than one chunk may have a part of is unbalanced.

    A line is the parts between two chunks that break it. What a part starts from is the sum before it less that
    before its line's first part; so lines are grouped by partial results, however many chunks they span.
    """
    both = lambda n: F.col(f"head.{n}") + F.coalesce(F.col(f"tail.{n}"), F.lit(0))
    placed = carried(parts.select(key, "chunk", "breaks", "head", "tail"), key, {"line": (F.col("breaks").cast("long"), "sum"), "e_before": (both("e"), "sum"), "i_before": (both("i"), "sum")})
    part = lambda line, at, e, i, own: F.struct(line.alias("line"), at.alias("at"), e.alias("e_before"), i.alias("i_before"), own.alias("part"))
    head = part(F.col("line"), F.col("chunk") * 2, F.col("e_before"), F.col("i_before"), F.col("head"))
    tail = part(F.col("line") + 1, F.col("chunk") * 2 + 1, F.col("e_before") + F.col("head.e"), F.col("i_before") + F.col("head.i"), F.col("tail"))
    each = placed.select(key, F.inline(F.when(F.col("breaks"), F.array(head, tail)).otherwise(F.array(head))))
    whole = each.groupBy(key, "line").agg(
        *[F.sum(f"part.{n}").alias(n) for n in "ei"], *[F.min_by(f"{n}_before", "at").alias(f"{n}_base") for n in "ei"], *[F.min(F.col(f"{n}_before") + F.col(f"part.{n}_low")).alias(f"{n}_low") for n in "ei"]
    )
    off = (F.col("e") != 0) | (F.col("i") != 0) | (F.col("e_low") < F.col("e_base")) | (F.col("i_low") < F.col("i_base"))
    return whole.groupBy(key).agg(F.max(off).alias("off"))
