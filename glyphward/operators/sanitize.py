"""Soften, redact and score texts under a policy."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, call, running
from ..functions.spans import _SPACE, Lexicon, apply_spans, detect
from ..tables import OTHER_WEIGHT, WEIGHTS
from .scan import free


@dataclass(frozen=True)
class Policy:
    name: str
    blocking: frozenset
    threshold: int
    description: str = ""


#: The policies.
PROFILES = {
    "generic": Policy("generic", frozenset({"secret", "slur"}), 80, "any public channel or LLM provider endpoint"),
    "strict": Policy("strict", frozenset({"secret", "slur", "hostility"}), 90, "a strict destination that also rejects hostile tone"),
}


def get_policy(name: str) -> Policy:
    if name not in PROFILES:
        raise ValueError(f"unknown provider profile {name!r}; choose from {sorted(PROFILES)}")
    return PROFILES[name]


#: Where a sentence ends and the next begins.
_BREAK = f"(?<=[.!?]){_SPACE}+"


def _trimmed(sentences: Column) -> Column:
    return F.regexp_replace(F.array_join(sentences, " "), f"^{_SPACE}+|{_SPACE}+$", "")


def _sentence_by_sentence(text: Column, lexicon: Lexicon, policy: Policy) -> Column:
    """The sentences in which nothing that blocks is found, each looked at on its own."""
    return _trimmed(F.filter(F.split(text, _BREAK, -1), lambda s: ~F.exists(detect(s, lexicon), lambda x: x["category"].isin(*policy.blocking))))


def _safe_sentences(text: Column, found: Column, lexicon: Lexicon, policy: Policy) -> Column:
    """The sentences without a blocking finding, joined by one blank; found: all findings of the text.

    No shape of a secret or personal data, and no word or phrase without a sentence's end in it, reaches from one sentence into
    the next, so the text's findings are those of its sentences: they are told from each other by offsets, in one walk.
    A lexicon with such an entry has each sentence looked at on its own.
    """
    if any(re.search(r"[.!?]\s", e) for e in (*lexicon.profanity, *lexicon.softeners, *lexicon.slurs)):
        return _sentence_by_sentence(text, lexicon, policy)
    parts = F.split(text, _BREAK, -1)
    lengths = call("zip_with", parts, F.regexp_extract_all(text, F.lit(_BREAK), F.lit(0)), "(p, g) -> char_length(p) + coalesce(char_length(g), 0)")
    starts = running(lengths, "0", "a.state + x", "named_struct('at', a.state, 'bad', false)", "struct<at:int,bad:boolean>")
    blocked = F.transform(F.filter(found, lambda x: x["category"].isin(*policy.blocking)), lambda x: F.struct(x["start"].alias("at"), F.lit(True).alias("bad")))
    # sentences and findings by offset: a finding is of the last sentence that has begun
    walked = running(F.array_sort(F.concat(starts, blocked)), "0", "if(x.bad, a.state, a.state + 1)", "if(x.bad, a.state, 0)", "int")
    fine = F.array_except(F.sequence(F.lit(1), F.size(parts)), walked)
    return F.when(text.isNotNull(), bind(parts, lambda p: _trimmed(F.transform(fine, lambda i: F.element_at(p, i)))))


#: What sanitize() adds, behind its prefix.
ADDED = ("clean", "score", "acceptable", "threshold", "blocked_by", "counts", "findings", "summary")


def sanitize(df: DataFrame, text: str = "text", provider: str = "generic", lexicon: Lexicon | None = None, aggressive: bool = False, prefix: str = "") -> DataFrame:
    """df, all its columns as they are, with clean, score, acceptable, threshold, blocked_by, counts, findings, summary, each name behind the prefix.

    A table that has one of them is a ValueError; a prefix avoids it. A null text has a null clean text and no findings.

    Findings and score are of the original text; with aggressive, sentences with a blocking finding are dropped
    before the rest is softened and redacted.
    """
    free(df, [prefix + n for n in ADDED])
    own = "_glyphward_"
    given = df.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{text}`").alias(f"{own}text"))
    out = _sanitized(given, own, lexicon or Lexicon(), get_policy(provider), aggressive)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(own + n).alias(prefix + n) for n in ADDED])


def _sanitized(df: DataFrame, own: str, lexicon: Lexicon, policy: Policy, aggressive: bool) -> DataFrame:
    text, found, score, blocked_by, acceptable = (F.col(own + n) for n in ("text", "findings", "score", "blocked_by", "acceptable"))
    out = df.withColumn(f"{own}findings", detect(text, lexicon))
    if aggressive:
        out = out.withColumn(f"{own}rest", _safe_sentences(text, found, lexicon, policy)).withColumn(f"{own}spans", detect(F.col(f"{own}rest"), lexicon))
        out = out.withColumn(f"{own}clean", apply_spans(F.col(f"{own}rest"), F.col(f"{own}spans"), keep_case=True))
    else:
        out = out.withColumn(f"{own}clean", apply_spans(text, found, keep_case=True))
    kinds = F.transform(found, lambda x: x["category"])
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    lost = F.aggregate(kinds, F.lit(0), lambda a, k: a + F.coalesce(F.try_element_at(weights, k), F.lit(OTHER_WEIGHT)))
    out = out.withColumn(f"{own}score", F.greatest(F.lit(0), 100 - lost)).withColumn(f"{own}threshold", F.lit(policy.threshold))
    out = out.withColumn(f"{own}blocked_by", F.array_sort(F.array_distinct(F.filter(kinds, lambda k: k.isin(*policy.blocking)))))
    out = out.withColumn(f"{own}acceptable", (F.size(blocked_by) == 0) & (score >= policy.threshold))
    out = out.withColumn(f"{own}counts", F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k))))))
    verdict = F.when(acceptable, "ACCEPTABLE").otherwise("NOT ACCEPTABLE")
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(f"{own}counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")
    blocked = F.when(F.size(blocked_by) > 0, F.concat(F.lit("  blocked by: "), F.array_join(blocked_by, ", ")))
    lines = [F.format_string(f"[{policy.name}] %s  score=%d/100 (threshold {policy.threshold})", verdict, score), blocked, F.concat(F.lit("  findings: "), F.when(listed != "", listed).otherwise("none"))]
    return out.withColumn(f"{own}summary", F.concat_ws("\n", *lines))
