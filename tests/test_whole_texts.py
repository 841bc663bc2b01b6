"""Words after the first of a text."""

import re
from collections import Counter, defaultdict

import __spark_entry__ as entry


def test_words_after_the_first(spark, tmp_path):
    docs = [(19, "a note from раypal.com and раypal.com"), (39, "paypal.com für Αlpha"), (59, "Alpha Zoë naïve")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ascii_ = {"раypal.com": "paypal.com", "Αlpha": "Alpha"}
    words = [(i, w) for i, t in docs for w in f"plain {t}".split(" ")]
    confusable = Counter((i, w) for i, w in words if re.search("[^\\x00-\\x7F]", w) and w in ascii_)
    out = entry.queries()["confusable_words"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["word"]): r["n"] for r in out} == confusable == {(19, "раypal.com"): 2, (39, "Αlpha"): 1}
    groups = defaultdict(set)
    for _, w in words:
        groups[ascii_.get(w, w)].add(w)
    out = entry.queries()["spoof_words"](spark, str(tmp_path)).collect()
    assert {r["skeleton"]: r["n"] for r in out} == {k: len(x) for k, x in groups.items() if len(x) > 1} == {"paypal.com": 2, "Alpha": 2}
