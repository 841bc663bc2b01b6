"""What is costly is worked out once, and only where it is asked for."""

from glyphward import scan
from glyphward.operators import chunks
from glyphward.tables import ScanOptions, UnicodeScanOptions


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signs_of_a_chunk_are_looked_up_once(spark):
    docs = spark.createDataFrame([(1, "a\u202eb\nc\u2069" * 300), (2, None)], "doc_id long, text string")
    assert plan(chunks._summed(chunks.cut(docs, 700), "doc_id", UnicodeScanOptions())).count("regexp_replace") == 2


def test_signs_and_line_ends_alone(spark):
    """Pieces without signs, without line ends and with both, against whole texts."""
    texts = ["a\nb\nc", "\n", "", "abc", "\u202a\nb\u202c", "x\u202ay\n\n\u2067z\u2069", "\u202a" + "a" * 9 + "\u202c", "\u2067\n\n\n\u2069"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["unbalanced"] for r in chunks.chunk_verdicts(chunks.summaries(chunks.cut(docs, 1000))).collect()}
    assert want == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}
    for size in (1, 2, 5):
        got = chunks.chunk_verdicts(chunks.summaries(chunks.cut(docs, size))).collect()
        assert {r["doc_id"]: r["unbalanced"] for r in got} == want


def test_no_detector_runs_where_personal_data_is_off(spark):
    docs = spark.createDataFrame([(1, "bob@example.com \u202e")], "doc_id long, text string")
    out = scan(docs, options=ScanOptions(pii=False))
    assert "sk-ant-" not in plan(out) and "sk-ant-" in plan(scan(docs))
    assert [(r["clean"], r["pii_findings"], r["counts"]) for r in out.collect()] == [("bob@example.com ", [], {"bidi": 1})]
