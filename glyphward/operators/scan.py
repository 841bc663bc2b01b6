"""Scan and clean a corpus: one row a document in, one row out, with its findings as arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, call, none, rows_of, running
from ..functions.spans import FOUND, Lexicon, apply_spans, detect
from ..functions.unicode import clean_unicode, is_dangerous, unicode_findings
from ..tables import LEVEL, RULES, ScanOptions

TOOL = "glyphward"


#: What scan() adds, behind its prefix.
ADDED = ("clean", "unicode_findings", "pii_findings", "dangerous", "counts")


def free(df: DataFrame, names: Iterable[str]) -> None:
    """ValueError if df has a column of one of these names, in any case: nothing of a user's is overwritten."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the table has columns {', '.join(sorted(taken))} already; give a prefix for the new ones")


def scan(df: DataFrame, text: str = "text", options: ScanOptions = ScanOptions(), prefix: str = "") -> DataFrame:
    """df, all its columns as they are, with clean, unicode_findings, pii_findings, dangerous, counts, each name behind the prefix.

    Unicode offsets are of the text, those of PII of the text without dangerous characters. All detectors compete
    for spans before only pii and secret ones stay. A null text has a null clean text and no findings. A table that has one of the new
    columns is a ValueError; a prefix avoids it.
    """
    free(df, [prefix + n for n in ADDED])
    given, (cleaned, uf, pf, dangerous, counts) = F.col(f"`{text}`"), (prefix + n for n in ADDED)
    plain = f"{prefix}_plain_{len(df.columns)}"
    out = df.withColumn(uf, unicode_findings(given, options.unicode)).withColumn(plain, clean_unicode(given, options.unicode))
    # where no spans are wanted, none are searched for
    kept = F.filter(detect(F.col(plain), Lexicon()), lambda x: x["category"].isin("pii", "secret")) if options.pii else none(FOUND)
    out = out.withColumn(pf, kept)
    out = out.withColumn(cleaned, apply_spans(F.col(plain), F.col(pf)))
    keys = F.concat(F.transform(uf, lambda x: x["category"]), F.transform(pf, lambda x: F.when(x["category"] == "pii", "pii:pii").otherwise(x["category"])))
    numbers = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.size(F.filter(keys, lambda x: x == k)))))
    out = out.withColumn(dangerous, is_dangerous(given, options.unicode)).withColumn(counts, numbers)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], cleaned, uf, pf, dangerous, counts)


def clean(df: DataFrame, text: str = "text", options: ScanOptions = ScanOptions(), prefix: str = "") -> DataFrame:
    """df, all its columns as they are, with column clean (behind the prefix) alone added."""
    free(df, [f"{prefix}clean"])
    own = "_glyphward_"
    return scan(df, text, options, own).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{own}clean").alias(f"{prefix}clean"))


def findings(df: DataFrame, key: str = "doc_id", column: str = "unicode_findings") -> DataFrame:
    """One row a finding of scan()'s result."""
    return rows_of(df, column, "category", key)


def to_json(prefix: str = "") -> Column:
    """A scanned row as JSON; neither the source nor what PII matched is in it. prefix is scan()'s."""
    cleaned, uf, pf, dangerous, counts = (F.col(prefix + n) for n in ADDED)
    pii = F.transform(pf, lambda x: F.struct(*[x[n].alias(n) for n in ("start", "end", "category", "severity", "detector", "replacement")]))
    unicode = F.transform(uf, lambda x: F.struct(*[x[n].alias(n) for n in ("offset", "char", "codepoint", "name", "category", "unicode_category", "severity", "action", "replacement", "detail")]))
    return F.to_json(F.struct(dangerous.alias("dangerous"), counts.alias("counts"), cleaned.alias("clean"), unicode.alias("unicode_findings"), pii.alias("pii_findings")))


def _categories(findings: Column) -> Column:
    """The categories in the order of their first findings."""
    return F.array_distinct(F.transform(findings, lambda x: x["category"]))


def regions(source: Column, findings: Column) -> Column:
    """array<struct<line, column>> from 1 of the findings (by offset): line ends and findings are walked through once."""
    ends = running(F.split(source, "\n"), "0", "a.state + char_length(x) + 1", "named_struct('at', a.state + char_length(x), 'here', false)", "struct<at:int,here:boolean>")
    events = F.array_sort(F.concat(ends, call("transform", findings, "x -> named_struct('at', x.offset, 'here', true)")))
    after = "if(x.here, a.state, named_struct('line', a.state.line + 1, 'start', x.at + 1))"
    place = "named_struct('line', a.state.line, 'column', x.at - a.state.start + 1, 'here', x.here)"
    walked = running(events, "named_struct('line', 1, 'start', 0)", after, place, "struct<line:int,column:int,here:boolean>")
    return call("transform", call("filter", walked, "x -> x.here"), "x -> named_struct('line', x.line, 'column', x.column)")


def _by_key(table: dict, key: Column, value=lambda v: v) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, value(v))])[key]


def _message(x: Column) -> Column:
    return F.format_string("%s (%s, category %s) at offset %d: %s. Action: %s.", x["name"], x["codepoint"], x["unicode_category"], x["offset"], x["detail"], x["action"])


def sarif_results(scanned: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """One row a Unicode finding: rule, index of the rule by first appearance, level, line and column from 1. text and prefix are scan()'s."""

    def result(order: Column, x: Column, r: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"{TOOL}/"), _by_key(RULES, x["category"], lambda v: v[0])).alias("rule_id"), (F.array_position(order, x["category"]) - 1).cast("int").alias("rule_index"),
            _by_key(LEVEL, x["severity"]).alias("level"), r["line"].alias("start_line"), r["column"].alias("start_column"), (r["column"] + 1).alias("end_column"),
            x["offset"].alias("char_offset"), F.lit(1).alias("char_length"), _message(x).alias("message"), *[x[n].alias(n) for n in ("category", "codepoint", "unicode_category", "severity", "action")],
        )

    found = F.col(f"{prefix}unicode_findings")
    rows = bind(_categories(found), lambda order: F.zip_with(found, regions(F.col(f"`{text}`"), found), lambda x, r: result(order, x, r)))
    return rows_of(scanned, rows, "rule_id", key)


def sarif(scanned: DataFrame, key: str = "doc_id", uri: Column | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """key and a SARIF 2.1.0 log a document, as JSON; PII is not in it. text and prefix are scan()'s.

    The tool has no address of its own, so the driver has no informationUri.
    """
    place = F.struct((F.lit("input") if uri is None else uri).alias("uri"))

    def result(order: Column, x: Column, r: Column) -> Column:
        region = F.struct(r["line"].alias("startLine"), r["column"].alias("startColumn"), (r["column"] + 1).alias("endColumn"), x["offset"].alias("charOffset"), F.lit(1).alias("charLength"))
        spot = F.struct(F.struct(place.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        props = F.struct(x["codepoint"].alias("codepoint"), x["unicode_category"].alias("unicodeCategory"), x["severity"].alias("severity"), x["action"].alias("action"))
        return F.struct(
            F.concat(F.lit(f"{TOOL}/"), _by_key(RULES, x["category"], lambda v: v[0])).alias("ruleId"), (F.array_position(order, x["category"]) - 1).cast("int").alias("ruleIndex"),
            _by_key(LEVEL, x["severity"]).alias("level"), F.struct(_message(x).alias("text")).alias("message"), F.array(spot).alias("locations"), props.alias("properties"),
        )

    def rule(c: Column) -> Column:
        name, short, more, level = (_by_key(RULES, c, lambda v, i=i: v[i]) for i in range(1, 5))
        return F.struct(
            F.concat(F.lit(f"{TOOL}/"), _by_key(RULES, c, lambda v: v[0])).alias("id"), name.alias("name"), F.struct(short.alias("text")).alias("shortDescription"),
            more.alias("helpUri"), F.struct(level.alias("level")).alias("defaultConfiguration"),
        )

    found = F.col(f"{prefix}unicode_findings")
    driver = F.struct(F.lit(TOOL).alias("name"), F.transform(_categories(found), rule).alias("rules"))
    results = bind(_categories(found), lambda order: F.zip_with(found, regions(F.col(f"`{text}`"), found), lambda x, r: result(order, x, r)))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    log = F.struct(F.lit("https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return scanned.select(key, F.to_json(log).alias("sarif"))


def _preview(text: Column) -> Column:
    """The first 80 visible characters: controls as \\xNN, other unseen ones as a middle dot."""
    unseen = "[\\p{Cf}\\p{Cc}\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
    show = lambda c: F.when(c.rlike("[\\x00-\\x1F\\x7F-\\x9F]"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).when(c.rlike(unseen), "·").otherwise(c)
    v = F.array_join(F.transform(F.split(F.left(text, F.lit(81)), ""), show), "")
    return F.when(F.char_length(v) > 80, F.concat(F.left(v, F.lit(79)), F.lit("…"))).otherwise(v)


def render_scan(text: str = "text", prefix: str = "") -> Column:
    """A report for people of a scanned row; text and prefix are scan()'s."""
    uf, pf = f"{prefix}unicode_findings", f"{prefix}pii_findings"
    head = F.format_string("  %5s  %-9s  %-10s  %-3s  %-10s  name", F.lit("off"), F.lit("codepoint"), F.lit("cat"), F.lit("gc"), F.lit("action"))
    row = lambda x: F.format_string("  %5d  %-9s  %-10s  %-3s  %-10s  %s", x["offset"], x["codepoint"], x["category"], x["unicode_category"], x["action"], x["name"])
    pii = lambda x: F.format_string("  %5d..%-5d  %-7s  %-14s  -> %s", x["start"], x["end"], x["category"], x["detector"], x["replacement"])
    nothing = F.array().cast("array<string>")
    first = F.when(F.size(uf) > 0, F.concat(F.array(F.format_string("Unicode-security findings (%d):", F.size(uf)), head), F.transform(uf, row))).otherwise(nothing)
    second = F.when(F.size(pf) > 0, F.concat(F.array(F.format_string("PII / secret findings (%d):", F.size(pf))), F.transform(pf, pii))).otherwise(nothing)
    counts = F.array_join(F.array_sort(F.transform(F.map_entries(f"{prefix}counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")
    verdict = F.concat(F.lit("Verdict: "), F.when(F.col(f"{prefix}dangerous"), "DANGEROUS").otherwise("clean-ish"), F.lit("  ("), counts, F.lit(")"))
    last = F.array(F.lit("Before/after:"), F.concat(F.lit("  before: "), _preview(F.col(f"`{text}`"))), F.concat(F.lit("  after : "), _preview(F.col(f"{prefix}clean"))), verdict)
    return F.when(F.size(uf) + F.size(pf) == 0, f"{TOOL}: no dangerous characters or PII found.").otherwise(F.array_join(F.concat(first, second, last), "\n"))
