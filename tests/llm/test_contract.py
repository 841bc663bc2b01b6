"""The registered queries' operators on cases that the contract names, against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from glyphward.llm import bpe, fingerprint, langid, packing, pii, quality, registry, runtime, sharding

from .conftest import prose
from .test_operators import JSON, RANKS, rows


@pytest.fixture()
def sf(spark, tmp_path):
    """A folder with a table of documents that spell the added token, and hard rows."""
    r = random.Random(2)
    parts = ["a", "b ", " ", "\n", "the", "<|endoftext|>", "<|endof", "text|>", "é", " 12", ".", "漢", "'s"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(40))), "en") for i in range(300)] + [(300, None, "en"), (301, "", None), (None, "a<|endoftext|>b", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), docs


def test_packing_ids_are_the_librarys(spark, sf):
    """op3's ids are those of the library as it is, for texts that spell the added token too."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    path, docs = sf
    out = rows(registry.op3_packing(spark, path))
    by = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, _ in docs}
    assert any(50256 in v for v in by.values()) and {r["doc_id"] for r in out} == set(by)
    for r in out:
        own = by[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total, sequences = packing.pack_documents(docs, JSON, added=True).selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert total >= 0.97 * 2048 * sequences


def test_short_pieces_share_places(spark):
    """Thousands of empty and tiny texts fill few sequences, each id in its place once."""
    docs = [(i, "") for i in range(5000)] + [(10_000 + i, "a b c d e f g h i j k l m n o p"[: 2 * (i % 9)]) for i in range(900)]
    out = rows(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), JSON))
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(out) == len(docs) and len(by) <= 1.2 * total / 2048 + 1


def test_memo_survives_many_segments(monkeypatch):
    """A worker's memo that starts afresh gives the same ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO", 50)
    code, t = packing.Coder(JSON, True), Tokenizer.from_file(JSON)
    for i in range(6):
        texts = [prose(i * 10 + j, 80) + " <|endoftext|> end" for j in range(3)]
        ids, offs = code.encode(pa.array(texts))
        for j, x in enumerate(texts):
            assert ids[offs[j] : offs[j + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_language_needs_letters(spark):
    d = {"en": b" the and of to in is was ", "de": b" der und die das ist ein war "}
    docs = [(0, "½"), (1, "² 3"), (2, "12 _ !"), (3, "the"), (4, "١٢"), (5, "Ⅷ"), (6, None), (7, "und ²")]
    out = {r["doc_id"]: r["lang_pred"] for r in rows(langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), d))}
    for i, t in docs:
        assert (out[i] == "und") == (not t or not any(c.isalpha() for c in t)), t


def test_language_sizes_equal_plain_compression(spark):
    """Sizes are those of whole texts part by part at one level; the smallest wins."""
    import zstandard as z

    docs = [(i, prose(i, 40), "en" if i % 2 else "xx") for i in range(40)]
    d = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    c = langid.Classifier(d)
    for i in (1, 2, 3):
        raw = langid.plain(prose(100 + i, 2000 * i)).encode()
        want = []
        for data in d.values():
            coder = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            want.append(sum(len(coder.compress(raw[at : at + langid.PART])) for at in range(0, len(raw), langid.PART)))
        assert np.abs(c.sizes(raw) - want).max() <= 0.02 * max(want)


def test_spread_reaches_the_end():
    text = bytes(range(256)) * 40
    cut = langid.spread(text, 1024)
    assert len(cut) <= 1024 and text.startswith(cut[:256]) and text.endswith(cut[-256:]) and langid.spread(b"abc", 3) == b"abc"


def test_language_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    out = rows(registry.op4_language(spark, path))
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rows(registry.op10_quality(spark, path))}
    held = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(out[r["doc_id"]]["held_out"] for r in held) and len(held) > 20
    assert sum(out[r["doc_id"]]["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_bradley_terry_equals_plain_descent():
    """The weights are where plain gradient descent of the same loss ends."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    label = (x @ [2.0, -1.0, 0.0, 0.5] + r.normal(size=300) > 0).astype(int)
    model = quality.fit(x, label, pairs=2000)
    good, bad, draw = np.flatnonzero(label == 1), np.flatnonzero(label == 0), np.random.default_rng(10)
    spread = x.std(axis=0) + 1e-3
    z = (x - x.mean(axis=0)) / spread
    d = z[draw.choice(good, 2000)] - z[draw.choice(bad, 2000)]
    w = np.zeros(4)
    for _ in range(4000):
        p = 1 / (1 + np.exp(d @ w))
        w += 0.002 * (d.T @ p - 2.0 * w)
    assert np.allclose(model.weights * spread, w, atol=0.02)


@pytest.mark.parametrize("kind", ["жук и кот. ", "漢字語言你好的是一，", "한국어 문장 ", "كلمة عربية ", "a'b 'll "])
def test_bpe_trees_of_other_scripts(kind):
    enc, _ = bpe.load(RANKS, P.PATTERN)
    r = random.Random(kind)
    for n in (30, 300, 3000):
        t = "".join(r.choice(kind) for _ in range(n))
        for leaf in (3, 17, 100):
            assert bpe.encode(enc, t, leaf) == enc.encode_ordinary(t)


def test_fingerprints_next_of_repeated_ids(spark, monkeypatch):
    """Rows of one doc_id, or without one, follow each other by their texts' hash, over many ranges."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 32)
    docs = [(None if i < 60 else 7 if i < 160 else i, prose(i, 30)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(order, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = []
    for i, r in enumerate(order):
        own, after = r["text"], order[(i + 1) % len(order)]["text"]
        want.append((r["doc_id"], hashlib.sha256((own[: len(own) - len(own) // 3] + after[: len(own) // 3]).encode()).hexdigest()))
    got = [(r["doc_id"], r["edited_sha256"]) for r in rows(fingerprint.edit_fingerprints(df))]
    assert sorted(got, key=str) == sorted(want, key=str)
    ranges = {r["_range"] for r in fingerprint.with_next(df).collect()}
    assert len(ranges) > 5


def test_sharding_of_rows_alike(spark):
    """Rows that are alike in all columns have a place each; moves towards one more shard stay near their share."""
    df = spark.createDataFrame([(None, "x")] * 500 + [(1, "x")] * 500 + [(i, f"t{i}") for i in range(2000)], "doc_id long, text string").repartition(6)
    out = rows(sharding.shard_rows(df, 8))
    assert len(out) == 3000
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(375))


def test_pii_rows_without_terms_stay_as_they_are(spark):
    docs = [(i, prose(i, 40)) for i in range(30)] + [(None, "call ann@corp.org Falcon"), (99, "ann@corp.org Falcon"), (None, None)]
    clean = rows(pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted(str(r["text"]) for r in clean)[:2] != [] and len(clean) == len(docs)
    assert {r["text"] for r in clean if r["doc_id"] is not None and r["doc_id"] < 30} == {t for i, t in docs[:30]}
    assert all("Falcon" not in (r["text"] or "") and "@" not in (r["text"] or "") for r in clean)


def test_only_broadcasts_few_and_shuffles_many(spark, monkeypatch):
    df, ids = spark.range(100).selectExpr("id", "id % 7 AS v"), spark.range(0, 100, 3).toDF("id")
    for most in (1000, 5):
        monkeypatch.setattr(runtime, "IDS", most)
        assert {r["id"] for r in runtime.only(df, ids, "id").collect()} == set(range(0, 100, 3))
        assert {r["id"] for r in runtime.only(df, ids, "id", out=True).collect()} == set(range(100)) - set(range(0, 100, 3))


def test_heavy_join_equals_join(spark):
    left = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    right = spark.range(5000).selectExpr("id AS k", "id * 2 AS w")
    hot = runtime.heavy(left, "k", 0.1)
    assert [r["k"] for r in hot.collect()] == [0]
    got = sorted(map(tuple, runtime.heavy_join(left, right, "k", hot).select("k", "v", "w").collect()))
    assert got == sorted((0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else 2 * i) for i in range(5000))


def test_scratch_tables_are_deleted(spark):
    with runtime.Scratch(spark) as scratch:
        paths = [scratch.paths[id(scratch.stash(spark.range(3)))][1] for _ in range(2)]
        local = [p.removeprefix("file://") for p in paths]
        assert all(os.path.isdir(p) for p in local)
    assert not any(os.path.isdir(p) for p in local)


def test_sharding_equals_a_walk_row_by_row(spark):
    """Rows put one at a time: each round, what an arc still holds goes to the next node clockwise while that has room."""
    df = spark.range(2500).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('text ', id % 900)) AS text")
    arcs, owners = sharding.ring(5, 64)
    point = df.selectExpr("doc_id", f"CAST(pmod(xxhash64(text), {sharding.POINTS}) AS INT) AS p").collect()
    waiting, n = [0] * len(owners), len(owners)
    for r in point:
        waiting[arcs[r["p"]]] += 1
    room, want = [500] * 5, {}
    for step in range(n):
        for a in range(n):
            s = owners[(a + step) % n]
            while waiting[a] and room[s]:
                waiting[a], room[s] = waiting[a] - 1, room[s] - 1
                want[a, s] = want.get((a, s), 0) + 1
    arc = {r["doc_id"]: arcs[r["p"]] for r in point}
    got = {}
    for r in rows(sharding.shard_rows(df, 5)):
        key = arc[r["doc_id"]], r["shard"]
        got[key] = got.get(key, 0) + 1
    assert got == want


def test_sharding_moves_few_rows_for_one_more_shard(spark):
    """Without hot texts, 8 to 9 shards move little more than the ninth shard's share, 1/9, and what bounded loads push on."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    a, b = ({r["doc_id"]: r["shard"] for r in rows(sharding.shard_rows(df, n))} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


def test_very_many_languages(spark):
    """Each of 600 languages has its dictionary; none is an error."""
    from .conftest import prose

    words = [[f"{chr(97 + n % 26)}{chr(97 + n // 26)}{w}" for w in prose(1, 40).translate({c: None for c in range(48, 58)}).split()] for n in range(600)]
    df = spark.createDataFrame([(2 * n + i, " ".join(w[i::2] + w), f"l{n:03d}") for n, w in enumerate(words) for i in range(2)], "doc_id long, text string, lang string")
    learned = langid.learn(df)
    assert len(learned) == 600 and all(learned.values())
    asked = df.filter("doc_id % 40 = 0")
    right = langid.identify(asked, learned).join(asked.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").count()
    assert right == asked.count()


def test_a_rare_language_gives_all_of_its_text(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(8000))
    df = spark.createDataFrame([(0, long, "rare")] + [(i, "some common words here", "many") for i in range(1, 5)], "doc_id long, text string, lang string")
    assert len(langid.learn(df)["rare"]) == min(langid.DICTIONARY, len(langid.plain(long)))


def test_equal_texts_lie_together_whatever_the_partitions(spark):
    """A text is parted only where a shard is full, and places do not depend on the partitioning."""
    texts = [prose_of(n % 300) if n % 3 else "hot" for n in range(12_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = None
    for parts in (1, 7):
        out = sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows(sharding.shard_rows(df.repartition(parts), 16)))
        first = first or out
        assert out == first
    held = {}
    for d, s, _ in first:
        held.setdefault(texts[d], set()).add(s)
    # each border between shards parts one text at most, but for the hot one, which a third of all rows have
    assert sum(len(s) - 1 for t, s in held.items() if t != "hot") <= 2 * 16 and 5 <= len(held["hot"]) <= 8


def prose_of(n: int) -> str:
    return f"text number {n} of many"
