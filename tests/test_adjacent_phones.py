"""Phones one character apart, each of them found: the borders are looked at, not taken."""

import re

from pyspark.sql import functions as F

from glyphward.functions import detect
from glyphward.functions.spans import apply_spans
from glyphward.sources import read_text

PHONE = re.compile(r"(?<!\w)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\w)")


def test_phones_one_character_apart(spark):
    texts = ["+1 (988) 555-2485 +1 (319) 555-5132", "988-555-2485 319-555-5132", "988-555-2485,319-555-5132", "+1 (555) 010-9999 (386) 555-3733 x", "988-555-2485\n319-555-5132.724-555-7058"]
    for r in read_text(spark, *texts).select("text", detect(F.col("text")).alias("own"), apply_spans(F.col("text"), detect(F.col("text"))).alias("clean")).collect():
        assert [(x["start"], x["end"], x["detector"]) for x in r["own"]] == [(*m.span(), "phone") for m in PHONE.finditer(r["text"])]
        assert len(r["own"]) > 1 and r["clean"] == PHONE.sub("[redacted-phone]", r["text"])
