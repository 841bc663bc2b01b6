"""Each operator on hard rows and on an empty table, against brute force where there is one."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from glyphward.llm import bpe, fingerprint, langid, minhash, packing, pii, quality, sharding, topk

from .conftest import prose

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(texts, k):
    sets, up = {i: shingle_set(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_minhash_edge(edge, none):
    out = rows(minhash.near_duplicates(edge, k=4))
    assert len(out) == edge.count()
    texts = {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] is not None}
    want = brute_components(texts, 4)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(none).count() == 0
    kept = rows(minhash.one_of_each(edge, k=4))
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i in {None} | {i for i in want if want[i][1] == i})


def test_minhash_chain(spark):
    """A chain of edits whose ends are unlike is one component."""
    words, docs = prose(5, 120).split(), []
    for i in range(30):
        words = [f"new{i}-{j}" if j in (3 * i % 120, (3 * i + 1) % 120) else w for j, w in enumerate(words)]
        docs.append((i, " ".join(words)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=4))}
    assert out == brute_components(dict(docs), 4)


def test_fast_sketch_fills_and_estimates():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        assert (minhash.fast_sketch(r.integers(1, 1 << 62, n, dtype=np.uint64), 288) != np.iinfo(np.uint64).max).all()
    a = r.integers(1, 1 << 62, 900, dtype=np.uint64)
    x, y = minhash.fast_sketch(a[:800], 288), minhash.fast_sketch(a[100:], 288)
    assert abs((x == y).mean() - 7 / 9) < 0.1


def test_packing(edge, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    out = rows(packing.pack_documents(edge, JSON, keep_ids=True))
    parts = {}
    for r in out:
        parts.setdefault(r["doc_id"], set()).add((r["start"], tuple(r["ids"])))
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for d in edge.collect():
        ids = [x for _, p in sorted(parts[d["doc_id"]]) for x in p]
        assert ids == [*t.encode(d["text"] or "", add_special_tokens=False).ids, 1]
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none, JSON).count() == 0
    full = rows(packing.sequences(packing.pack_documents(edge, JSON, keep_ids=True)))
    assert all(len(r["input_ids"]) == 2048 or r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in full)


def test_cutting_stock_covers_demand():
    draw = random.Random(4)
    demand = {s: draw.randrange(40) for s in range(1, 65)}
    plan = packing.cutting_stock(demand, 64)
    got = {}
    for pattern, n in plan:
        assert sum(s * c for s, c in pattern.items()) <= 64
        for s, c in pattern.items():
            got[s] = got.get(s, 0) + n * c
    assert got == {s: n for s, n in demand.items() if n}
    assert sum(n for _, n in plan) <= 1.1 * sum(s * n for s, n in demand.items()) / 64 + 2


def test_sharding(spark, edge, none):
    out = rows(sharding.shard_rows(edge, 4))
    assert len(out) == edge.count()
    for s in range(4):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own))) and edge.count() // 4 <= len(own) <= edge.count() // 4 + 1
    assert sharding.shard_rows(none, 4).count() == 0
    many = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('text ', id)) AS text")
    a, b = ({r["doc_id"]: r["shard"] for r in rows(sharding.shard_rows(many, n))} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)


def test_ring_moves_only_into_a_new_shard():
    (a, x), (b, y) = sharding.ring(16, 64), sharding.ring(17, 64)
    assert all(x[i] == y[j] or y[j] == 16 for i, j in zip(a, b, strict=True))


def test_bpe(edge, none):
    enc, table = bpe.load(RANKS, P.PATTERN)
    want = {}
    for d in edge.collect():
        want[d["doc_id"]] = enc.encode_ordinary(d["text"] or "")
        assert bpe.decode(table, want[d["doc_id"]]) == (d["text"] or "").encode()
    for r in rows(bpe.bpe_digests(edge, RANKS, P.PATTERN, leaf=64)):
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.bpe_digests(none, RANKS, P.PATTERN).count() == 0
    assert {r["doc_id"]: r["ids"] for r in rows(bpe.bpe_round_trip(edge, RANKS, P.PATTERN))} == want


def test_bpe_tree_equals_whole():
    enc, table = bpe.load(RANKS, P.PATTERN)
    draw = random.Random(6)
    for _ in range(4000):
        t = "".join(draw.choice("ab'sltrve d  \n\t12.,!é　\xa0漢😀\x1c|") for _ in range(draw.randrange(60)))
        assert bpe.encode(enc, t, draw.choice([1, 2, 5, 9])) == enc.encode_ordinary(t)


def test_top_k(spark):
    draw = np.random.default_rng(8)
    data = [(i, draw.normal(size=4).tolist()) for i in range(600)] + [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan")] * 4), (603, []), (650, [0.5, 0.5])] + [(700 + i, [0.25, 0.5, -1.0, 1.0]) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = {}
    for r in rows(topk.top_k(df, "vec_id % 50 = 0", 5)):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in data if v and None not in v and np.isfinite(v).all()}
    for q in ok:
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:5]
            assert sorted(out.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), "true").count() == 0


def test_language(spark, edge, none):
    both = [(i, " ".join(random.Random(i).choices(["der", "die", "und", "nicht", "ein"] if i % 2 else ["the", "and", "not", "one", "with"], k=40)), "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame(both, "doc_id long, text string, lang string")
    d = langid.learn(df)
    assert set(d) == {"de", "en"}
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") and 0 <= r["score"] <= 1 for r in rows(langid.identify(df, d)))
    out = rows(langid.identify(edge, d))
    assert len(out) == edge.count() and all(r["lang_pred"] in ("de", "en", "und") for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {0, 1, 2}
    assert langid.learn(none) == {} and langid.identify(none, d).count() == 0
    assert langid.accepted(df, d).columns == df.columns and langid.accepted(edge, d).count() < edge.count()


def test_quality(spark, edge, none):
    data = [(i, prose(i, 60) if i % 2 else " ".join("!!###"[: 2 + j % 3] + "XY" for j in range(50)), i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality.learn(df.drop("quality"), df.select("doc_id", "quality"))
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows(quality.score_documents(df, model)))
    out = rows(quality.score_documents(edge, model))
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(none, model).count() == 0
    flat = quality.learn(none, df.select("doc_id", "quality"))
    assert {r["predicted"] for r in rows(quality.score_documents(edge, flat))} == {1}


def test_fingerprints(spark, edge, none):
    out = rows(fingerprint.edit_fingerprints(edge))
    assert len(out) == edge.count()
    order = sorted(edge.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    if len(order) == len({r["doc_id"] for r in order}) + 1:  # one repeated row
        for r in out:
            i = max(k for k, x in enumerate(order) if x["doc_id"] == r["doc_id"])
            own, after = order[i]["text"] or "", order[(i + 1) % len(order)]["text"] or ""
            c = len(own) // 3
            text = own[: len(own) - c] + after[:c]
            assert r["n_chars"] == len(own)
            if r["doc_id"] != 3:
                assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
                a, b = shingle_set(own, 5), shingle_set(text, 5)
                assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert fingerprint.edit_fingerprints(none).count() == 0
    plain = {r["doc_id"]: r["fingerprint"] for r in rows(fingerprint.fingerprints(edge))}
    assert plain[6] == plain[7] and plain[0] == plain[1] == fingerprint.EMPTY
    assert fingerprint.fingerprint_likeness(plain[4], plain[5]) > 0.9 and fingerprint.fingerprint_likeness(plain[0], plain[6]) == 0


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y z@q-.r", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.0004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1234567", "9" * 5000 + ".1.1.1", ""])
def test_base_spans_equal_plain_patterns(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii._luhn(digits(m))]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == want


def test_pii(spark, edge, none):
    docs = [(i, f"{prose(i, 30)} the Falcon lead is ann@corp.org since {prose(i + 99, 9)}") for i in range(8)] + [(50 + i, prose(500 + i, 60) + " lead the since") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows(pii.report(pii.find(df)))}
    t = docs[0][1]
    assert f"term:{t.index('Falcon')}:{t.index('Falcon') + 6}" in out[0]["spans"] and out[0]["n_email"] == 1
    assert all(out[i]["spans"] == "" for i in range(50, 110))
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(df))}
    assert "[email]" in clean[0] and "[term]" in clean[0] and "Falcon" not in clean[0] and clean[55] == docs[13][1]
    assert len(rows(pii.report(pii.find(edge)))) == edge.count() and pii.report(pii.find(none)).count() == 0
    again = rows(pii.sanitise(edge))
    assert len(again) == edge.count() and set(again[0]) == set(edge.columns) and all(r["terms"] == "x" for r in again)
