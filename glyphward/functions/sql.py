"""SQL functions of the operators, for users who write SQL: their bodies are SQL over built-in functions, so no Python runs on executors."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..tables import BIDI, UnicodeScanOptions, confusables, flagged, folds
from .codepoints import code_points
from .unicode import DANGEROUS

#: What unicode_scan() gives, in order; all but the offset are strings.
FIELDS = ("char", "codepoint", "name", "category", "unicode_category", "severity", "action", "replacement", "detail")


def literal(text: str) -> str:
    """A SQL literal of any text: all but letters, digits and blanks as code points."""
    return "'" + "".join(c if c.isascii() and (c.isalnum() or c == " ") else f"\\U{ord(c):08X}" for c in text) + "'"


def _holds(chars: str) -> str:
    return f"translate(t, {literal(chars)}, '') <> t" if chars else "false"


def _swapped(table: dict[str, str]) -> str:
    """The text with each character by its value, as the column functions have it: most by translate(), longer values one by one."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    long = {k: v for k, v in table.items() if len(v) > 1}
    gone = "".join(k for k, v in table.items() if not v)
    out = f"translate(t, {literal(''.join(one) + gone)}, {literal(''.join(one.values()))})"
    if not long:
        return out
    keys, values = literal("".join(long)), f"from_json({literal(json.dumps(long))}, 'map<string,string>')"
    each = f"array_join(transform(split({out}, ''), c -> coalesce(try_element_at({values}, c), c)), '')"
    return f"CASE WHEN translate(t, {keys}, '') <> t THEN {each} ELSE {out} END"


def bodies(options: UnicodeScanOptions = UnicodeScanOptions()) -> dict[str, tuple[str, str]]:
    """name -> (type, body over t) of the scalar functions."""
    table = flagged(options)
    bad = "".join(c for c, f in table.items() if f["category"] in DANGEROUS)
    plain = "t RLIKE {}".format(literal("[^\\x00-\\x7F]"))
    folded = _swapped(folds())
    return {
        "clean_unicode": ("STRING", _swapped({c: f["replacement"] for c, f in table.items() if f["action"] != "flagged"})),
        "skeleton": ("STRING", folded),
        "strip_bidi": ("STRING", f"translate(t, {literal(''.join(map(chr, BIDI)))}, '')"),
        "contains_bidi": ("BOOLEAN", _holds("".join(map(chr, BIDI)))),
        "is_dangerous": ("BOOLEAN", _holds(bad)),
        "is_confusable": ("BOOLEAN", f"char_length(t) = 1 AND {_holds(''.join(confusables()))}"),
        "confusable_with_ascii": ("BOOLEAN", f"{plain} AND {folded} <> t AND NOT {folded} RLIKE {literal('[^\\x00-\\x7F]')}"),
    }


def scan_body(options: UnicodeScanOptions = UnicodeScanOptions()) -> str:
    """The query of unicode_scan(t): texts that hold nothing flagged are not taken apart."""
    table = flagged(options)
    chars = literal("".join(table))
    kind = "array<struct<" + ",".join(f"{n}:string" for n in FIELDS) + ">>"
    values = f"from_json({literal(json.dumps(list(table.values())))}, '{kind}')"
    parts = f"posexplode(CASE WHEN {_holds(''.join(table))} THEN split(t, '') ELSE CAST(array() AS ARRAY<STRING>) END)"
    found = f"SELECT pos, element_at({values}, instr({chars}, c)) AS f FROM (SELECT {parts} AS (pos, c)) WHERE translate(c, {chars}, '') <> c"
    return f"SELECT pos, {', '.join(f'f.{n}' for n in FIELDS)} FROM ({found})"


def register(spark: SparkSession, options: UnicodeScanOptions = UnicodeScanOptions()) -> None:
    """Adds table function unicode_scan(text) and functions clean_unicode, skeleton, strip_bidi, contains_bidi, is_dangerous, is_confusable, confusable_with_ascii (text).

    Null texts give null, and no rows. View code_points has the names of all characters by intervals: (block, first, last, name,
    numbered, unicode_category), where a numbered name goes on with its character's own number.
    """
    code_points(spark).createOrReplaceTempView("code_points")
    for name, (kind, body) in bodies(options).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    columns = ", ".join(["offset INT", *[f"{n} STRING" for n in FIELDS]])
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION unicode_scan(t STRING) RETURNS TABLE({columns}) RETURN {scan_body(options)}")
