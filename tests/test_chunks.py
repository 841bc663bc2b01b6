"""Texts in pieces: the same findings, lines and verdicts as whole; the data source that reads and writes them."""

import json
import os
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphward import scan
from glyphward.functions import unbalanced_bidi
from glyphward.operators import chunks, sarif, sarif_results
from glyphward.sources import read_files
from glyphward.sources.datasource import border, decoded, register_source

SIGNS = ["a", "\n", "\r", " ", "\x85", "‮", "‪", "‬", "⁦", "⁩", "р", "​", "é", "😀"]


def texts(n=120):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(SIGNS) if r.random() < 0.4 else "z" for _ in range(r.randrange(0, 90)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (None, "a‮b"), (902, "‮" + "x" * 400 + "‬\n" + "y" * 300 + "​")]


def same(parts, docs, key="doc_id"):
    place = lambda rows: sorted(repr(tuple(r)) for r in rows)
    whole = scan(docs)
    want = sarif_results(whole, key).select(key, F.col("char_offset").cast("long"), F.col("start_line").cast("long"), F.col("start_column").cast("long"), "codepoint", "category")
    assert place(chunks.chunk_findings(parts, key).select(key, "offset", "line", "column", "codepoint", "category").collect()) == place(want.collect())
    verdicts = {r[key]: (r["dangerous"], r["unbalanced"], r["n_chars"], r["n_lines"], r["n_findings"], dict(r["counts"])) for r in chunks.chunk_verdicts(parts, key).collect()}
    for r in whole.withColumn("off", unbalanced_bidi(F.col("text"))).collect():
        kinds = [f["category"] for f in r["unicode_findings"]]
        text = r["text"] or ""
        assert verdicts.pop(r[key]) == (r["dangerous"], bool(r["off"]), len(text), text.count("\n") + 1, len(kinds), {k: kinds.count(k) for k in kinds})
    assert not verdicts


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pieces_say_what_the_whole_says(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "CELL", 2)
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    same(chunks.summaries(chunks.cut(docs, size).repartition(5)), docs)


def test_no_texts(spark):
    parts = chunks.summaries(chunks.cut(spark.createDataFrame([], "doc_id long, text string"), 5))
    assert chunks.chunk_findings(parts).count() == chunks.chunk_verdicts(parts).count() == 0


def test_cuts_fall_between_characters():
    """Whatever the bytes, pieces decode to what the whole decodes to."""
    r = random.Random(2)
    alphabet = [b"a", b"\r", b"\n", b"\r\n", "é".encode(), "漢".encode(), "😀".encode(), b"\xff", b"\x80", b"\xe2\x80", b"\xf0\x9f\x98", b"\x80\x80\x80\x80", b"\xc3"]
    for _ in range(400):
        raw = b"".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))
        at = r.randrange(1, len(raw) + 1)
        at = min(len(raw), at + border(raw[at - 1 : at + 7], 1))
        for newlines in (True, False):
            assert decoded(raw[:at], newlines) + decoded(raw[at:], newlines) == decoded(raw, newlines), (raw, at)


@pytest.fixture
def folder(tmp_path):
    r = random.Random(3)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(6):
        raw = b"".join(r.choice([s.encode() for s in SIGNS] + [b"\r\n", b"\xff", b"plain words "]) for _ in range(r.randrange(0, 900)))
        (tmp_path / "in" / ("deep" if i % 2 else "") / f"f{i}.txt").write_bytes(raw)
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    (tmp_path / "in" / ".hidden").write_bytes(b"x\xe2\x80\xae")
    return tmp_path / "in"


def test_a_file_in_chunks_is_the_file(spark, folder):
    register_source(spark)
    read = spark.read.format("glyphward").option("chunkBytes", 64).option("taskBytes", 256).load(str(folder))
    assert read.rdd.getNumPartitions() > 5
    rows = read.orderBy("path", "chunk").collect()
    joined = {}
    for r in rows:
        joined[r["path"]] = joined.get(r["path"], "") + r["text"]
    files = [p for p in folder.rglob("*.txt")]
    assert joined == {str(p): p.read_bytes().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for p in files}
    whole = spark.createDataFrame(list(joined.items()), "path string, text string")
    # bytes that are no UTF-8 are replaced as Spark's own reader of files has it
    plain = {r["path"].removeprefix("file:"): r["text"] for r in read_files(spark, str(folder / "f0.txt")).collect()}
    assert plain == {str(folder / "f0.txt"): joined[str(folder / "f0.txt")]}
    same(chunks.summaries(read, "path"), whole, "path")
    with pytest.raises(PySparkException, match="chunkBytes"):
        spark.read.format("glyphward").option("chunkBytes", 3).load(str(folder)).count()


def test_documents_are_written_whole_or_not(spark, folder, tmp_path):
    register_source(spark)
    docs = spark.createDataFrame([(f"dir/d{i}.txt", f"a‮{i}") for i in range(20)], "path string, text string").repartition(4)
    logs = sarif(scan(docs), "path").select(F.col("path").alias("name"), F.col("sarif").alias("value"))
    out = tmp_path / "out"
    logs.write.format("glyphward").option("suffix", ".sarif").mode("append").save(str(out))
    written = sorted(out.rglob("*.sarif"))
    assert sorted(p.name for p in written) == sorted(f"dir_d{i}.txt.sarif" for i in range(20)) and (out / "_SUCCESS").exists()
    assert all(json.loads(p.read_text())["runs"][0]["results"][0]["ruleId"] == "glyphward/bidi-control" for p in written)
    assert sorted(os.listdir(out)) == sorted(["_SUCCESS", *{p.parent.name for p in written}])
    # one task of four fails: nothing of the job is left, what was there stays
    fails = logs.withColumn("value", F.when(F.col("name").endswith("d7.txt"), F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        fails.write.format("glyphward").mode("append").save(str(out))
    assert sorted(out.rglob("*.sarif")) == written and not list(out.rglob("*staged*"))
    logs.limit(3).write.format("glyphward").option("layout", "lines").mode("overwrite").save(str(out))
    lines = [x for p in out.rglob("*.jsonl") for x in p.read_text().splitlines()]
    assert len(lines) == 3 and all(json.loads(x)["version"] == "2.1.0" for x in lines) and not list(out.rglob("*.sarif"))


def test_streams_of_files(spark, folder, tmp_path):
    register_source(spark)

    def run():
        stream = spark.readStream.format("glyphward").option("chunkBytes", 100).option("settledSeconds", 0).load(str(folder))
        rows = stream.select(F.concat_ws("-", F.element_at(F.split("path", "/"), -1), "chunk").alias("name"), F.col("text").alias("value"))
        query = rows.writeStream.format("glyphward").option("suffix", ".txt").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "streamed"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return {p.name: p.read_text(newline="") for p in (tmp_path / "streamed").rglob("*.txt")}

    first = run()
    assert "".join(first[f"f0.txt-{i}.txt"] for i in range(sum(n.startswith("f0.txt-") for n in first))) == decoded((folder / "f0.txt").read_bytes(), True)
    assert not any("hidden" in n for n in first)
    time.sleep(0.1)
    (folder / "later.txt").write_text("more")
    second = run()
    assert second == first | {"later.txt-0.txt": "more"}
    assert not list((tmp_path / "streamed").rglob("*staged*"))


def test_the_command_reads_files_in_pieces(spark, tmp_path, capsys, monkeypatch):
    from glyphward.cli import main
    from glyphward.sources import datasource

    monkeypatch.setattr(datasource, "CHUNK", 64)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain words\n" * 50)
    assert main(["scan", str(tmp_path / "in"), "--pieces"], spark) == 0 and "clean-ish  ()  51 lines" in capsys.readouterr().out
    (tmp_path / "in" / "b.txt").write_text("plain words\n" * 50 + "x‮y р")
    assert main(["scan", str(tmp_path / "in"), "--pieces", "--table", str(tmp_path / "t")], spark) == 1
    assert "DANGEROUS  (bidi=1, homoglyph=1)  51 lines, unbalanced" in capsys.readouterr().out
    assert [(r["offset"], r["line"], r["column"]) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("offset").collect()] == [(601, 51, 2), (604, 51, 5)]
    assert main(["scan", str(tmp_path / "in" / "b.txt"), "--pieces", "--no-bidi", "--json"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["n_lines"] == 51 and said["counts"] == {"homoglyph": 1} and not said["dangerous"]
    with pytest.raises(SystemExit):
        main(["scan", "-t", "x", "--pieces"], spark)
