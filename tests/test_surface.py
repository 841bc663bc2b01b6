"""What users call: the command line on files and folders, objects of one text, SQL functions, rewriting, lexicons."""

import json
import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

import glyphward
from glyphward import Lexicon, ScanOptions, UnicodeScanOptions, register, rewrite, sanitize_text, scan_text
from glyphward.cli import main
from glyphward.functions import bidi_name, find_bidi, target
from glyphward.operators.rewrite import answer, prompt, request
from glyphward.sources import read_text


def test_version():
    done = subprocess.run([sys.executable, "-m", "glyphward.cli", "--version"], capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and glyphward.__version__ in done.stdout
    with pytest.raises(SystemExit) as end:
        main(["-V"])
    assert end.value.code == 0


def test_json_keeps_secrets_out(spark, capsys):
    """Keys in their order; neither the source nor the address found in it."""
    assert main(["scan", "-t", "bob@example.com‮", "--json"], spark) == 1
    said = capsys.readouterr().out
    assert list(json.loads(said)) == ["dangerous", "counts", "clean", "unicode_findings", "pii_findings"] and "bob@" not in said
    assert list(json.loads(said)["unicode_findings"][0]) == ["offset", "char", "codepoint", "name", "category", "unicode_category", "severity", "action", "replacement", "detail"]


def test_folder(spark, tmp_path, capsys):
    """Every file counts, whichever comes first; no files, nothing found."""
    (tmp_path / "in").mkdir()
    assert main(["scan", str(tmp_path / "in")], spark) == 0
    (tmp_path / "in" / "a.txt").write_text("plain")
    assert main(["scan", str(tmp_path / "in")], spark) == 0
    (tmp_path / "in" / "b.txt").write_text("x‮y")
    capsys.readouterr()
    assert main(["scan", str(tmp_path / "in"), "--json"], spark) == 1
    assert [x["result"]["dangerous"] for x in json.loads(capsys.readouterr().out)] == [False, True]
    assert main(["scan", str(tmp_path / "in"), "--sarif"], spark) == 1
    logs = json.loads(capsys.readouterr().out)
    assert logs[1]["result"]["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].endswith("b.txt")
    assert main(["clean", str(tmp_path / "in"), "-o", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / "b.txt").read_text() == "xy\n" and (tmp_path / "out" / "a.txt").read_text() == "plain\n"
    assert main(["normalize", str(tmp_path / "in"), "--check"], spark) == 0


def test_exit_codes_and_toggles(spark, capsys):
    assert main(["-t", "this is shit"], spark) == 0 and "junk" in capsys.readouterr().out
    assert main(["scan", "-t", "a‮b", "--no-bidi"], spark) == 0
    assert main(["clean", "-t", "bob@example.com", "--no-pii"], spark) == 0 and "bob@example.com" in capsys.readouterr().out
    assert main(["clean", "-t", "р", "--flag-only-homoglyphs"], spark) == 0 and "р" in capsys.readouterr().out
    assert main(["normalize", "-t", "key sk-ABCDEF0123456789ABCD", "--check"], spark) == 1
    assert main([], spark) == 0


def test_scan_text(spark):
    r = scan_text(spark, "раypal\n​ bob@example.com")
    assert [f.category for f in r.findings] == ["homoglyph", "homoglyph", "zero_width"] and r.dangerous
    assert r.clean == "paypal\n [redacted-email]" and r.counts == {"homoglyph": 2, "zero_width": 1, "pii:pii": 1}
    assert r.to_dict()["pii_findings"][0]["detector"] == "email" and r.pii_findings[0].redacted and "DANGEROUS" in r.report
    off = scan_text(spark, "р", ScanOptions(UnicodeScanOptions(normalize_homoglyphs=False)))
    assert off.clean == "р" and off.unicode_findings[0].action == "flagged"


def test_sanitize_text(spark, tmp_path):
    r = sanitize_text(spark, "Shit happens. My key is sk-ABCDEF0123456789ABCD.")
    assert r.clean.startswith("Junk happens.") and not r.report.acceptable and r.report.blocked_by == ["secret"]
    assert r.report.score == 0 and "blocked by: secret" in r.report.summary()
    assert sanitize_text(spark, "Fine day. My key is sk-ABCDEF0123456789ABCD. Bye.", aggressive=True).clean == "Fine day. Bye."
    (tmp_path / "l.json").write_text(json.dumps({"profanity": {"frob": "tweak"}, "softeners": {"go away": "see you"}, "slurs": ["zorg", "zorg"]}))
    own = Lexicon.default().merged_with(str(tmp_path / "l.json"))
    r = sanitize_text(spark, "Frob it, Go away, Zorg! shit", lexicon=own, provider="strict")
    assert r.clean == "Tweak it, See you, [redacted-slur]! junk" and r.report.blocked_by == ["hostility", "slur"]
    assert own.slurs == ["zorg"] and Lexicon.default().profanity.get("frob") is None
    with pytest.raises(ValueError):
        Lexicon(softeners={"": "x"})
    with pytest.raises(ValueError):
        sanitize_text(spark, "x", provider="nobody")


def test_ignored_case_beyond_ascii(spark):
    """Letters that match ASCII ones where case is ignored are found like them."""
    r = sanitize_text(spark, "ſhit SHİT ſtfu KYS zorg.", lexicon=Lexicon(slurs=["Zorg"]))
    assert [f.detector for f in r.report.findings] == ["profanity", "profanity", "softener", "softener", "slur"]


def test_names_and_targets(spark):
    chars = ["‮", "р", "\x07", "a", "\U000e0001", "Ａ"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for r in df.select("c", bidi_name(F.col("c")).alias("name"), target(F.col("c")).alias("t")).collect():
        assert r["name"] == ("RIGHT-TO-LEFT OVERRIDE" if r["c"] == "‮" else unicodedata.name(r["c"], f"U+{ord(r['c']):04X}"))
        assert r["t"] == {"р": "p", "Ａ": "A"}.get(r["c"])
    found = read_text(spark, "a‮b\n⁦", None).select(find_bidi(F.col("text")).alias("f")).collect()
    assert [[tuple(x) for x in r["f"]] for r in found] == [[(1, "‮"), (4, "⁦")], []]


def test_sql_functions(spark):
    register(spark)
    read_text(spark, "a‮раy", None, "").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT doc_id, f.offset, f.category FROM texts, LATERAL unicode_scan(text) f ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "bidi"), (0, 2, "homoglyph"), (0, 3, "homoglyph")]
    row = spark.sql("SELECT clean_unicode(text) c, skeleton(text) s, contains_bidi(text) b, is_dangerous(text) d FROM texts ORDER BY doc_id").collect()
    assert tuple(row[0]) == ("apay", "a‮pay", True, True) and tuple(row[1]) == (None, None, None, None) and tuple(row[2]) == ("", "", False, False)


def test_rewrite(spark):
    def send(path, body):
        assert path == "/api/chat" and body["messages"][0]["role"] == "system"
        return {"message": {"content": f"  {body['messages'][1]['content'].upper()} "}}

    out = rewrite(read_text(spark, "be calm", None), send, provider="strict").orderBy("doc_id").collect()
    assert [r["rewritten"] for r in out] == ["BE CALM", None]
    assert "strict" in prompt(glyphward.get_policy("strict")) and answer({"choices": []}, "openai") == ""
    with pytest.raises(ValueError):
        request("x", glyphward.get_policy("generic"), "carrier pigeon", "m")


def test_stdin_and_newlines(spark, tmp_path, capsys):
    f = tmp_path / "crlf.txt"
    f.write_bytes(b"one\r\ntwo\rx\xe2\x80\xaey\xff")
    assert main(["scan", str(f), "--sarif"], spark) == 1
    region = json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert (region["startLine"], region["startColumn"], region["charOffset"]) == (3, 2, 9)


def test_streams_of_the_process_are_utf8(spark, monkeypatch):
    """Output that cannot show a character replaces it, whatever the terminal."""
    import io

    raw = io.BytesIO()
    monkeypatch.setattr(sys, "stdout", io.TextIOWrapper(raw, encoding="ascii"))
    assert main(["clean", "-t", "naïve ‮😀"], spark) == 0
    sys.stdout.flush()
    assert raw.getvalue().decode() == "naïve 😀\n"
