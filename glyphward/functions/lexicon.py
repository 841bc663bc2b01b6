"""Lexicon hits by an automaton of all words and phrases: one pass over a text, however many entries there are.

A lexicon of more than LARGE entries is looked up this way, by Arrow batches in Python workers; smaller ones stay regular
expressions. Both find the same spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Entries beyond which regular expressions cost more than the way to Python workers and back.
LARGE = 400
#: Rows of an Arrow batch at most: a batch's hits, many for each text, are all in a worker's memory at once.
BATCH = 250


class _Fold(dict):
    """For str.translate(): each character by the one that stands for all that match it where case is ignored."""

    def __missing__(self, cp: int) -> int:
        # one to one, as regular expressions of the JVM have it: characters whose case has several letters stay
        upper = chr(cp).upper()
        upper = upper if len(upper) == 1 else chr(cp)
        lower = "i" if upper == "İ" else upper.lower()
        self[cp] = ord(lower if len(lower) == 1 else upper)
        return self[cp]


_FOLD = _Fold()


@lru_cache(1 << 16)
def _in_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


class Automaton:
    """Words (detector `profanity` and `slur`) and phrases (`softener`) of a lexicon, each folded, with what a span of it carries."""

    def __init__(self, profanity: dict, softeners: dict, slurs: list, first: int):
        import ahocorasick

        self.words, self.found = profanity, ahocorasick.Automaton()
        entries: dict[str, list] = {}
        seq = first
        for kind, own in (("profanity", profanity), ("softener", softeners), ("slur", slurs)):
            if kind == "softener":
                for phrase, repl in own.items():
                    entries.setdefault(folded(phrase), []).append((seq, -4 if repl == "[removed]" else -3, "hostility", "critical" if repl == "[removed]" else "high", repl, kind))
                    seq += 1
            elif any(own):
                rank, severity, repl = (-2, "medium", "[removed]") if kind == "profanity" else (-4, "critical", "[redacted-slur]")
                for word in filter(None, own):
                    if all(e[0] != seq for e in entries.setdefault(folded(word), [])):
                        entries[folded(word)].append((seq, rank, kind, severity, repl, kind))
                seq += 1
        for key, value in entries.items():
            self.found.add_word(key, (len(key), value))
        if entries:
            self.found.make_automaton()
        self.empty = not entries

    def spans(self, text: str) -> list[dict]:
        """All detectors' matches in the order of detection, then of their starts.

        Of words, the longest at a place; matches of one detector do not overlap, the first counts.
        """
        if self.empty:
            return []
        hits: dict[int, list] = {}
        plain = folded(text)
        for last, (n, entries) in self.found.iter(plain):
            start, end = last + 1 - n, last + 1
            if (start == 0 or not _in_word(text[start - 1])) and (end == len(text) or not _in_word(text[end])):
                for e in entries:
                    hits.setdefault(e[0], []).append((start, -end, e))
        out = []
        for seq in sorted(hits):
            reach = 0
            for start, less, (_, rank, category, severity, repl, detector) in sorted(hits[seq], key=lambda h: h[:2]):
                if start >= reach:
                    reach, matched = -less, text[start:-less]
                    own = self.words.get(matched.lower(), repl) if detector == "profanity" else repl
                    out.append({"rank": rank, "less": start - reach, "start": start, "seq": seq, "end": reach, "category": category, "severity": severity, "matched": matched, "replacement": own, "detector": detector})
        return out


@lru_cache(4)
def automaton(profanity: tuple, softeners: tuple, slurs: tuple, first: int) -> Automaton:
    """Made once a worker."""
    return Automaton(dict(profanity), dict(softeners), list(slurs), first)


def _bounded() -> None:
    """Bound the session's Arrow batches, so that a worker's memory does not grow with the rows of its task."""
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def lexicon_spans(text: Column, lexicon, first: int, kind: str) -> Column:
    """array<struct<kind>> of the lexicon's matches, numbered from detector `first`; empty for null texts."""
    own = (tuple(lexicon.profanity.items()), tuple(lexicon.softeners.items()), tuple(lexicon.slurs), first)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(*own)
        for texts in batches:
            yield texts.map(lambda t: machine.spans(t) if t else [])

    _bounded()
    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(work, f"array<struct<{kind}>>")(text)
