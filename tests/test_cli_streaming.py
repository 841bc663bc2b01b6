"""The command line and the stream give what the batch expressions give."""

import json

from glyphward import scan
from glyphward.cli import main
from glyphward.streaming import scan_stream, start


def test_cli_scan(spark, tmp_path, capsys):
    f = tmp_path / "in.txt"
    f.write_text("line1\nabc‮def")
    assert main(["scan", str(f), "--sarif"], spark) == 1
    region = json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert (region["startLine"], region["startColumn"]) == (2, 4)
    assert main(["scan", "-t", "plain text", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["dangerous"] is False


def test_cli_clean(spark, tmp_path, capsys):
    assert main(["clean", "-t", "email b​ob@example.com and ‮ more"], spark) == 0
    out = capsys.readouterr().out
    assert "​" not in out and "‮" not in out and "bob@example.com" not in out
    assert main(["clean", "-t", "a​b", "-o", str(tmp_path / "o")], spark) == 0
    assert (tmp_path / "o").read_text() == "ab\n"


def test_cli_normalize(spark, capsys):
    assert main(["normalize", "-t", "this is shit"], spark) == 0
    assert "shit" not in capsys.readouterr().out
    assert main(["normalize", "-t", "a calm sentence", "--check", "-p", "strict"], spark) == 0
    assert main(["normalize", "-t", "a calm sentence", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["clean"] == "a calm sentence"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a​b"), (2, None), (3, "mail bob@example.com"), (4, "")]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    source.write.parquet(str(tmp_path / "in"))
    stream = scan_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = start(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    cols = ("doc_id", "clean", "dangerous")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    assert got == sorted(map(tuple, scan(source).select(*cols).collect()))
