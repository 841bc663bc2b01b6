"""Column functions over spans: personal data, secrets and lexicon hits, resolved and applied without Python."""

from __future__ import annotations

import json
import operator
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import PROFANITY, SOFTENERS
from .arrays import BLOCK, bind, call, none, running
from .lexicon import LARGE, lexicon_spans

#: Word characters as in Python; the literal character beyond U+FFFF makes Java's look-behind step by code points.
_W = "[\\p{L}\\p{N}_\U00020000]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
_OCTET = "(?:25[0-5]|2[0-4]\\p{Nd}|1?\\p{Nd}?\\p{Nd})"
_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
#: Non-ASCII characters that match ASCII letters where case is ignored, and those letters.
_CASED, _PLAIN = "\u017f\u212a\u0130\u0131", "skii"
#: A match behind what stands before it, whose length is gap; without a match behind the last one.
_CUT = "struct<detector:int,gap:int,m:string>"
#: A match before any choice, with what the choice goes by first.
_SPAN = "rank:int,less:int,start:int,seq:int,end:int,category:string,severity:string,matched:string,replacement:string,detector:string"
#: Shapes of secrets and personal data, in the order of detection (fixed values): detector, pattern, category, severity,
#: replacement, and the pattern of what a text must hold to be worth a search. A look at the first characters comes before
#: the costlier look behind them.
SHAPES = (
    ("openai_key", f"(?=sk-){_EDGE}sk-[A-Za-z0-9]{{16,}}{_EDGE}", "secret", "critical", "[redacted-secret]", "sk-"),
    ("anthropic_key", f"(?=sk-ant-){_EDGE}sk-ant-[A-Za-z0-9_-]{{16,}}{_EDGE}", "secret", "critical", "[redacted-secret]", "sk-ant-"),
    ("aws_access_key", f"(?=AKIA){_EDGE}AKIA[0-9A-Z]{{16}}{_EDGE}", "secret", "critical", "[redacted-secret]", "AKIA"),
    ("github_token", f"(?=gh[pousr]_){_EDGE}gh[pousr]_[A-Za-z0-9]{{20,}}{_EDGE}", "secret", "critical", "[redacted-secret]", "gh[pousr]_"),
    ("slack_token", f"(?=xox){_EDGE}xox[baprs]-[A-Za-z0-9-]{{10,}}{_EDGE}", "secret", "critical", "[redacted-secret]", "xox[baprs]-"),
    ("generic_bearer", f"(?=[Bb]earer){_EDGE}[Bb]earer{_SPACE}+[A-Za-z0-9._-]{{20,}}{_EDGE}", "secret", "critical", "[redacted-secret]", "earer"),
    ("email", f"{_EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{_EDGE}", "pii", "high", "[redacted-email]", "@"),
    ("ssn", f"(?=\\p{{Nd}}){_EDGE}\\p{{Nd}}{{3}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{4}}{_EDGE}", "pii", "critical", "[redacted-ssn]", "\\p{Nd}-\\p{Nd}"),
    ("phone", f"(?=[+(\\p{{Nd}}])(?<!{_W})(?:\\+?1(?:[-.]|{_SPACE})?)?\\(?\\p{{Nd}}{{3}}\\)?(?:[-.]|{_SPACE})?\\p{{Nd}}{{3}}(?:[-.]|{_SPACE})?\\p{{Nd}}{{4}}(?!{_W})", "pii", "medium", "[redacted-phone]", "\\p{Nd}{4}"),
    ("ipv4", f"(?=\\p{{Nd}}){_EDGE}(?:{_OCTET}\\.){{3}}{_OCTET}{_EDGE}", "pii", "low", "[redacted-ip]", "\\p{Nd}\\.\\p{Nd}"),
)


@dataclass(frozen=True)
class Lexicon:
    """Words and phrases with replacements, and slurs. Empty words match nothing; empty phrases are refused."""

    profanity: dict = field(default_factory=lambda: dict(PROFANITY))
    softeners: dict = field(default_factory=lambda: dict(SOFTENERS))
    slurs: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if "" in self.softeners:
            raise ValueError("a lexicon phrase is empty")

    @classmethod
    def default(cls) -> Lexicon:
        return cls()

    @classmethod
    def from_table(cls, entries: DataFrame) -> Lexicon:
        """The lexicon of a table (kind, entry, replacement): kinds profanity, softener and slur; the first of equal entries by replacement.

        Entries go to the driver, which ships them to the workers: a lexicon, not a corpus. Rows without an entry are left out; other kinds are
        a ValueError. Words without a replacement get [removed].
        """
        rows = entries.filter("entry <> ''").groupBy("kind", "entry").agg(F.min("replacement").alias("replacement")).orderBy("kind", "entry").collect()
        if bad := {r["kind"] for r in rows} - {"profanity", "softener", "slur"}:
            raise ValueError(f"kinds of entries: profanity, softener, slur; not {sorted(map(str, bad))}")
        of = lambda kind: {r["entry"]: r["replacement"] or "[removed]" for r in rows if r["kind"] == kind}
        return cls(of("profanity"), of("softener"), list(of("slur")))

    def entries(self) -> int:
        return len(self.profanity) + len(self.softeners) + len(self.slurs)

    def merged_with(self, path: str) -> Lexicon:
        """This lexicon with a JSON file's entries put over it."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return Lexicon(self.profanity | data.get("profanity", {}), self.softeners | data.get("softeners", {}), list(dict.fromkeys([*self.slurs, *data.get("slurs", [])])))


def _first_letters(words: list[str]) -> str:
    """A look-ahead for the first characters of the words, where case is ignored; it spares a look-behind at most places."""
    first = {c for w in words for c in (w[0], w[0].lower(), w[0].upper(), w[0].upper().lower(), w[0].lower().upper()) if len(c) == 1}
    first |= {odd for odd, c in zip(_CASED, _PLAIN, strict=True) if c in first}
    return f"(?=[{''.join(re.escape(c) for c in sorted(first))}])" if all(c.isascii() or c in _CASED for c in first) else ""


def _whole_words(words) -> str | None:
    """A pattern of the words, longest first, with no word character on either side; None without words."""
    own = sorted((w for w in words if w), key=len, reverse=True)
    return f"{_first_letters(own)}(?iu)(?<!{_W})(?:{'|'.join(map(re.escape, own))})(?!{_W})" if own else None


def _seen(text: Column) -> Column:
    """struct<low, odd>: the text in lower case, and whether it holds one of the characters of _CASED; made once a text."""
    return F.struct(F.lower(text).alias("low"), reduce(operator.or_, [text.contains(c) for c in _CASED]).alias("odd"))


def _mentions(seen: Column, words) -> Column:
    """Whether the text may hold one of the words, in any case: a quick look without patterns.

    Of the characters that match ASCII letters, lower() turns only the Kelvin sign into one; texts with the others may
    hold anything.
    """
    own = sorted({w.translate(str.maketrans(_CASED, _PLAIN)).lower() for w in words if w})
    if not all(w.isascii() for w in own):
        return F.lit(True)
    kept = [w for w in own if not any(x != w and x in w for x in own)]
    return reduce(operator.or_, [seen["low"].contains(w) for w in kept]) | seen["odd"]


def _cuts(text: Column, pattern: str, detector: int, gate: Column) -> Column:
    """array<struct<detector, gap, m>>: the length of what stands before each match, and the match; last, what is behind them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = call("zip_with", gaps, hits, f"(g, h) -> named_struct('detector', {detector}, 'gap', char_length(g), 'm', h)")
    return F.when(gate, each).otherwise(none(_CUT))


#: Characters that end an e-mail address, and how far from its @ they are looked for.
_BREAK, _NEAR = "[^A-Za-z0-9._%+-]", 128


def _mail_cuts(text: Column, pattern: str, detector: int) -> Column:
    """_cuts() of e-mail addresses, from what is near each @ alone.

    An address holds one @, and none of _BREAK. Where one of these stands close to each @ on both sides, addresses do not
    depend on each other or on anything farther away; other texts are searched as a whole. Steps back have negative gaps.
    """

    def one(a: Column, b: Column) -> Column:
        found = F.concat(F.right(a, F.lit(_NEAR)), F.lit("@"), F.left(b, F.lit(_NEAR)))
        # what stands before the address, the address, and the way back to behind its @
        told = "x -> if(x.m = '', array(named_struct('detector', {0}, 'gap', x.n + 1, 'm', cast(null as string))), array("
        told += "named_struct('detector', {0}, 'gap', x.n + 1 - instr(x.m, '@'), 'm', x.m), named_struct('detector', {0}, 'gap', instr(x.m, '@') - char_length(x.m), 'm', cast(null as string))))"
        each = F.struct(F.char_length(a).alias("n"), F.regexp_extract(found, pattern, 0).alias("m"))
        return F.element_at(call("transform", F.array(each), told.format(detector)), 1)

    def whole(pieces: Column) -> Column:
        n = F.size(pieces)
        ended = lambda p, first, last: F.when(first, True).otherwise(F.left(p, F.lit(_NEAR)).rlike(_BREAK)) & F.when(last, True).otherwise(F.right(p, F.lit(_NEAR)).rlike(_BREAK))
        alone = lambda p, i: F.when((i > 0) & (i < n - 1), ended(p, F.lit(False), F.lit(False))).otherwise((F.char_length(p) <= _NEAR) | ended(p, i == 0, i == n - 1))
        near = F.flatten(F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n - 1), one))
        return F.when(F.forall(F.transform(pieces, alone), lambda x: x), near).otherwise(_cuts(text, pattern, detector, F.lit(True)))

    return F.when(text.contains("@"), bind(F.split(text, "@", -1), whole)).otherwise(none(_CUT))


def _detectors(text: Column, lexicon: Lexicon, seen: Column | None) -> list[tuple[str, str, str, str, str, Column]]:
    """name, pattern, category, severity, replacement (for words that have one each: what others get), and a quick look first."""
    literal = re.compile(r"[A-Za-z@-]+")
    out = [(name, p, cat, sev, repl, text.contains(need) if literal.fullmatch(need) else text.rlike(need)) for name, p, cat, sev, repl, need in SHAPES]
    if p := _whole_words(lexicon.profanity):
        out.append(("profanity", p, "profanity", "medium", "[removed]", _mentions(seen, lexicon.profanity) & text.rlike(p)))
    for phrase, repl in lexicon.softeners.items():
        p = f"{_first_letters([phrase])}(?iu)(?<!{_W}){re.escape(phrase)}(?!{_W})"
        out.append(("softener", p, "hostility", "critical" if repl == "[removed]" else "high", repl, _mentions(seen, [phrase]) & text.rlike(p)))
    if p := _whole_words(lexicon.slurs):
        out.append(("slur", p, "slur", "critical", "[redacted-slur]", _mentions(seen, lexicon.slurs) & text.rlike(p)))
    return out


def raw_spans(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """All detectors' matches in the order of detection; they may overlap.

    Lengths of matches and of what stands between them add up to offsets, for all detectors in one walk. A lexicon of very
    many entries is looked up by an automaton instead of patterns.
    """
    if lexicon.entries() > LARGE:
        shapes = _raw_spans(text, Lexicon({}, {}, []))
        return F.coalesce(F.concat(shapes, lexicon_spans(text, lexicon, len(SHAPES), _SPAN)), none(f"struct<{_SPAN}>"))
    return _raw_spans(text, lexicon)


def _raw_spans(text: Column, lexicon: Lexicon) -> Column:
    detectors = _detectors(text, lexicon, _seen(text))

    def all_cuts(seen: Column | None) -> Column:
        own = _detectors(text, lexicon, seen)
        return F.flatten(F.array(*[_mail_cuts(text, p, i) if name == "email" else _cuts(text, p, i, gate) for i, (name, p, _, _, _, gate) in enumerate(own)]))

    cuts = bind(_seen(text), all_cuts) if lexicon.entries() else all_cuts(None)
    at = "if(a.state.detector = x.detector, a.state.at, 0) + x.gap"
    after = f"named_struct('detector', x.detector, 'at', {at} + coalesce(char_length(x.m), 0))"
    element = f"named_struct('detector', x.detector, 'start', {at}, 'm', x.m)"
    placed = running(cuts, "named_struct('detector', -1, 'at', 0)", after, element, "struct<detector:int,start:int,m:string>")
    rows = [{"rank": -_RANK[sev], "category": cat, "severity": sev, "replacement": repl, "detector": name} for name, _, cat, sev, repl, _ in detectors]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<rank:int,category:string,severity:string,replacement:string,detector:string>>")
    words = F.from_json(F.lit(json.dumps(lexicon.profanity)), "map<string,string>")

    def whole(x: Column) -> Column:
        own = F.element_at(table, x["detector"] + 1)
        named = F.when(own["detector"] == "profanity", F.try_element_at(words, F.lower(x["m"])))
        return bind(F.struct(x.alias("x"), own.alias("own"), named.alias("named"), (x["start"] + F.char_length(x["m"])).alias("end")), _span)

    return F.transform(call("filter", placed, "x -> x.m is not null"), whole)


def _span(v: Column) -> Column:
    fields = "named_struct('rank', y.own.rank, 'less', y.x.start - y.end, 'start', y.x.start, 'seq', y.x.detector, 'end', y.end, 'category', y.own.category, "
    fields += "'severity', y.own.severity, 'matched', y.x.m, 'replacement', coalesce(y.named, y.own.replacement), 'detector', y.own.detector)"
    return F.element_at(call("transform", F.array(v), f"y -> {fields}"), 1)


def resolve(spans: Column) -> Column:
    """Greedy choice of disjoint spans: by severity, length, start, then order of detection; sorted by start.

    Spans that overlap, directly or through others, form a group; a choice never depends on another group's.
    """
    by_start = F.array_sort(call("transform", spans, "x -> named_struct('from', x.start, 'span', x)"))
    fresh = "x.span.start >= a.state.reach"
    group = f"if({fresh}, x.span.start, a.state.grp)"
    reach = f"if({fresh}, x.span.end, greatest(a.state.reach, x.span.end))"
    first = "named_struct('reach', -1, 'grp', -1)"
    grouped = running(by_start, first, f"named_struct('reach', {reach}, 'grp', {group})", f"named_struct('grp', {group}, 'span', x.span)", f"struct<grp:int,span:struct<{_SPAN}>>")
    # spans of a group come in the order of choice; state: what the group has taken so far
    nothing = "cast(array() as array<struct<start:int,end:int>>)"
    taken = f"if(a.state.grp = x.grp, a.state.taken, {nothing})"
    clear = f"not exists({taken}, c -> x.span.start < c.end and x.span.end > c.start)"
    more = f"if({clear}, concat({taken}, array(named_struct('start', x.span.start, 'end', x.span.end))), {taken})"
    chosen = running(F.array_sort(grouped), f"named_struct('grp', -1, 'taken', {nothing})", f"named_struct('grp', x.grp, 'taken', {more})", f"named_struct('clear', {clear}, 'span', x.span)", f"struct<clear:boolean,span:struct<{_SPAN}>>")
    names = ("start", "end", "category", "severity", "matched", "replacement", "detector")
    fields = ", ".join(f"'{n}', x.span.{n}" for n in names)
    return F.array_sort(call("transform", call("filter", chosen, "x -> x.clear"), f"x -> named_struct({fields})"))


#: A chosen span, as detect() gives it.
FOUND = "struct<start:int,end:int,category:string,severity:string,matched:string,replacement:string,detector:string>"


def detect(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """array<FOUND> of the disjoint spans, by start; empty for null texts."""
    return F.coalesce(resolve(raw_spans(text, lexicon)), none(FOUND)).cast(f"array<{FOUND}>")


def _lifted(x: Column) -> Column:
    """The replacement, with its match's capital where it softens a word."""
    r, m = x["replacement"], x["matched"]
    a, b = F.left(m, F.lit(1)), F.left(r, F.lit(1))
    lift = ~(r.startswith("[") & r.endswith("]")) & (F.upper(a) == a) & (F.lower(a) != a) & (F.lower(b) == b) & (F.upper(b) != b)
    return F.when(lift, F.concat(F.upper(b), F.substr(r, F.lit(2)))).otherwise(r)


def apply_spans(text: Column, spans: Column, keep_case: bool = False) -> Column:
    """The text with each span replaced, but for spans that begin inside an earlier one.

    keep_case gives a softened word its match's capital. The text is cut once for a block of spans and each section once
    for a span, so long texts with many spans are not read from the start for each of them.
    """
    apart = running(spans, "0", "if(x.start >= a.state, x.end, a.state)", "named_struct('keep', x.start >= a.state, 'span', x)", f"struct<keep:boolean,span:{FOUND}>")
    kept = call("transform", call("filter", apart, "x -> x.keep"), "x -> x.span")

    def section(xs: Column, b: Column) -> Column:
        first, after = b * BLOCK, (b + 1) * BLOCK
        lo = F.when(b == 0, F.lit(0)).otherwise(xs[first]["start"])
        hi = F.when(after < F.size(xs), xs[after]["start"]).otherwise(F.char_length(text))
        whole = F.struct(lo.alias("lo"), F.substr(text, lo + 1, hi - lo).alias("cut"), F.slice(xs, first + 1, F.lit(BLOCK)).alias("own"))

        def put(s: Column) -> Column:
            end = lambda i: F.when(i == 0, s["lo"]).otherwise(s["own"][i - 1]["end"])
            piece = lambda x, i: F.concat(F.substr(s["cut"], end(i) - s["lo"] + 1, x["start"] - end(i)), _lifted(x) if keep_case else x["replacement"])
            rest = F.substr(s["cut"], end(F.size(s["own"])) - s["lo"] + 1)
            return F.concat(F.array_join(F.transform(s["own"], piece), ""), rest)

        return bind(whole, put)

    def whole(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.array_join(F.transform(blocks, lambda b: section(xs, b)), "")

    return F.when(F.size(spans) > 0, bind(kept, whole)).otherwise(text)
