"""Column functions over characters. All are built-in expressions: no Python runs on executors, nothing shuffles."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import BIDI, UnicodeScanOptions, confusables, flagged, folds
from .arrays import bind, call, none, running

FINDING = "struct<char:string,codepoint:string,name:string,category:string,unicode_category:string,severity:string,action:string,replacement:string,detail:string>"
_BIDI = "".join(map(chr, BIDI))
#: Kinds of findings that make a text dangerous; look-alikes alone do not.
DANGEROUS = ("bidi", "zero_width", "invisible", "control")


def _lookup(table: dict, value_type: str) -> Column:
    """A literal map; constant folding evaluates it once a plan."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{value_type}>")


def _holds(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "") != text


#: Characters other than visible ASCII, blanks and line ends; few texts need more than a look for one.
_UNUSUAL = "[^\\t\\n\\r -~]"
#: Ranges of characters that a pattern tests together, behind one test of where they all lie.
_TESTED = 16


def _any_of(table) -> str:
    """A pattern of one character of the table. Most characters are told from those of it by their place, in a few tests."""
    cps, ranges = sorted(map(ord, table)), []
    for cp in cps:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    span = lambda lo, hi: f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"
    near = [ranges[i : i + _TESTED] for i in range(0, len(ranges), _TESTED)]
    classes = "".join(f"[{span(x[0][0], x[-1][1])}&&[{''.join(span(*r) for r in x)}]]" for x in near)
    return f"[{'[^ -~]' if any(c in table for c in '\t\n\r') else _UNUSUAL}&&[{classes}]]"


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """What stands between the runs of characters of the pattern, and the runs; only these are looked at one by one."""
    return F.split(text, f"{pattern}+", -1), F.regexp_extract_all(text, F.lit(f"{pattern}+"), F.lit(0))


def _swap(text: Column, table: dict[str, str]) -> Column:
    """Each character by its value: one-to-one and deletions in one translate(), longer values in a split run."""
    if not table:
        return text
    one = {k: v for k, v in table.items() if len(v) == 1}
    gone = "".join(k for k, v in table.items() if not v)
    long = {k: v for k, v in table.items() if len(v) > 1}
    pattern, keys, values = _any_of(table), "".join(long), _lookup(long, "string")

    def swapped(run: Column) -> Column:
        out = F.translate(run, "".join(one) + gone, "".join(one.values())) if one or gone else run
        parts = F.transform(F.split(out, ""), lambda c: F.when(_holds(c, keys), F.element_at(values, c)).otherwise(c))
        return F.when(_holds(out, keys), F.array_join(parts, "")).otherwise(out) if long else out

    parts = F.zip_with(*_cut(text, pattern), lambda gap, run: F.concat(gap, F.when(run.isNotNull(), swapped(run)).otherwise("")))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def unicode_findings(text: Column, options: UnicodeScanOptions = UnicodeScanOptions()) -> Column:
    """array<struct<offset, char, ...>> in offset order (code points from 0); empty for null texts.

    Runs of flagged characters cut the text; lengths of what stands between them and of the runs add up to offsets, so a text
    is read through a few times, however many findings it has.
    """
    table = flagged(options)
    kind = "struct<offset:int," + FINDING.removeprefix("struct<")
    if not table:
        return none(kind)
    chars, pattern = "".join(table), _any_of(table)
    values = F.from_json(F.lit(json.dumps(list(table.values()))), f"array<{FINDING}>")
    runs = call("zip_with", *_cut(text, pattern), "(g, r) -> named_struct('gap', char_length(g), 'run', r)")
    placed = running(runs, "0", "a.state + x.gap + coalesce(char_length(x.run), 0)", "named_struct('at', a.state + x.gap, 'run', x.run)", "struct<at:int,run:string>")

    def whole(offset: Column, c: Column) -> Column:
        names = ("char", "codepoint", "name", "category", "unicode_category", "severity", "action", "replacement", "detail")
        found = F.struct(offset.alias("offset"), F.element_at(values, F.instr(F.lit(chars), c)).alias("f"))
        return bind(found, lambda v: F.struct(v["offset"].alias("offset"), *[v["f"][n].alias(n) for n in names]))

    inside = lambda x: F.transform(F.split(x["run"], ""), lambda c, i: whole(x["at"] + i, c))
    found = F.flatten(F.transform(call("filter", placed, "x -> x.run is not null"), inside))
    return F.coalesce(F.when(text.rlike(pattern), found), none(kind))


def is_dangerous(text: Column, options: UnicodeScanOptions = UnicodeScanOptions()) -> Column:
    """Whether the text holds a flagged character that is no look-alike: a look alone, no findings are made. Null texts hold none."""
    table = {c: f for c, f in flagged(options).items() if f["category"] in DANGEROUS}
    return F.coalesce(text.rlike(_any_of(table)), F.lit(False)) if table else F.lit(False)


def clean_unicode(text: Column, options: UnicodeScanOptions = UnicodeScanOptions()) -> Column:
    """The text without stripped characters and with normalized ones replaced."""
    return _swap(text, {c: f["replacement"] for c, f in flagged(options).items() if f["action"] != "flagged"})


def skeleton(text: Column) -> Column:
    """Look-alikes by their ASCII forms; nothing is stripped."""
    return _swap(text, folds())


def strip_bidi(text: Column) -> Column:
    return F.translate(text, _BIDI, "")


def contains_bidi(text: Column) -> Column:
    return _holds(text, _BIDI)


def is_bidi_control(ch: Column) -> Column:
    return (F.char_length(ch) == 1) & _holds(ch, _BIDI)


def find_bidi(text: Column) -> Column:
    """array<struct<offset, char>> of all bidirectional controls, by offset; empty for null texts."""
    only = UnicodeScanOptions(zero_width=False, invisible=False, control=False, homoglyph=False)
    return F.transform(unicode_findings(text, only), lambda x: F.struct(x["offset"].alias("offset"), x["char"].alias("char")))


def bidi_name(ch: Column) -> Column:
    """The name of a character: of the bidirectional controls, else of Unicode, else its code point as U+XXXX.

    Names of all other characters are not in the plan, so a pandas function looks them up.
    """

    def named(chars: pd.Series) -> pd.Series:
        return chars.map(lambda c: unicodedata.name(c, f"U+{ord(c):04X}"), na_action="ignore")

    own = _lookup({chr(cp): name for cp, name in BIDI.items()}, "string")
    return F.coalesce(F.try_element_at(own, ch), F.pandas_udf(named, "string")(ch))


def target(ch: Column) -> Column:
    """The ASCII form that the fixed table gives a character; null for others."""
    return F.try_element_at(_lookup(confusables(), "string"), ch)


def is_confusable(ch: Column) -> Column:
    """Whether the fixed table has the character; compatibility forms alone do not count."""
    return (F.char_length(ch) == 1) & _holds(ch, "".join(confusables()))


def confusable_with_ascii(text: Column) -> Column:
    """Whether the text is not ASCII but its skeleton is, and differs."""
    other = "[^\\x00-\\x7F]"
    s = skeleton(text)
    return text.rlike(other) & (s != text) & ~s.rlike(other)


#: Openings and closings of embeddings and isolates, and the ends of lines as Python's splitlines() has them, within brackets of a pattern.
SIGNS, LINE_ENDS = "\u202a-\u202e\u2066-\u2069", "\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def walked(signs: Column, opening: str, closing: str) -> Column:
    """struct<n, low>: openings less closings of one kind, and the least that this is on the way (0 at most)."""
    step = lambda c: F.when(F.translate(c, opening, "") == "", F.when(c == "", 0).otherwise(1)).when(c == closing, -1).otherwise(0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("low"))
    return F.aggregate(F.split(signs, ""), start, lambda a, c: F.struct((a["n"] + step(c)).alias("n"), F.least(a["low"], a["n"] + step(c)).alias("low")))


def unbalanced_bidi(text: Column) -> Column:
    """Whether a line closes an embedding or isolate that it has not opened, or leaves one open.

    The two kinds count apart; marks count for neither. Lines end as Python's splitlines() has it.
    """
    lines = F.split(F.regexp_replace(text, f"[^{SIGNS}{LINE_ENDS}]", ""), f"[{LINE_ENDS}]")

    def off(line: Column, opening: str, closing: str) -> Column:
        return bind(walked(line, opening, closing), lambda w: (w["n"] != 0) | (w["low"] < 0))

    found = F.exists(lines, lambda x: off(x, "\u202a\u202b\u202d\u202e", "\u202c") | off(x, "\u2066\u2067\u2068", "\u2069"))
    return F.when(contains_bidi(text), found).otherwise(F.lit(False))
