"""Rows that an operator once left out of its job."""

import math
import random
import re
from collections import Counter

import numpy as np

from glyphward.llm import langid, pii, topk

from .conftest import prose


def rows(df):
    return [r.asDict() for r in df.collect()]


def spans(df):
    """doc_id -> the texts of its term spans, in order."""
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    out = {}
    for r in rows(pii.report(pii.find(df))):
        cut = [x.split(":")[1:] for x in r["spans"].split(",") if x.startswith("term:")]
        out[r["doc_id"]] = [text[r["doc_id"]][int(s) : int(e)] for s, e in cut]
    return out


def test_pii_entity_of_one_text(spark):
    """A term that stands with an entity in one text alone discloses it."""
    docs = [(0, "alpha Falcon lead ann@corp.org beta")] + [(i, prose(i, 60) + " lead") for i in range(1, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = spans(df)
    assert out[0] == ["Falcon"] and not any(out[i] for i in range(1, 60))
    assert rows(pii.sanitise(df).filter("doc_id = 0"))[0]["text"] == "alpha [term] lead [email] beta"


def test_pii_terms_at_any_distance(spark):
    """A term goes with an entity anywhere in a document, and is marked wherever that stands."""
    gap = prose(7, 60)
    docs = [(0, f"Falcon {gap} ann@corp.org {gap} Falcon")] + [(i, prose(i, 60)) for i in range(1, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert spans(df)[0] == ["Falcon", "Falcon"]
    assert "Falcon" not in rows(pii.sanitise(df).filter("doc_id = 0"))[0]["text"]


def test_pii_equals_plain_counts(spark):
    """Against counts of whole documents, with copies, entities of many documents and of the same ones."""
    draw = random.Random(11)
    docs = []
    for i in range(120):
        words = ["".join("abcdefghij"[int(x)] for x in f"{int(draw.expovariate(0.005)):05}") for _ in range(draw.randrange(5, 60))]
        for _ in range(draw.choice([0, 0, 1, 3])):
            words.insert(draw.randrange(len(words)), f"user{int(draw.expovariate(0.1))}@corp.org")
        docs += [(i, " ".join(words))] * draw.choice([1, 1, 1, 2])
    docs.append((None, None))
    entities = [set(re.findall(r"user\d+@corp.org", t or "")) for _, t in docs]
    terms = [set(re.findall(r"[a-j]{5}", re.sub(r"user\d+@corp.org", "", t or ""))) for _, t in docs]
    n_c, n_t = (Counter(x for own in by for x in own) for by in (entities, terms))
    n_ct = Counter((c, t) for cs, ts in zip(entities, terms, strict=True) for c in cs for t in ts)
    n = len(docs)
    telling = {(c, t) for (c, t), k in n_ct.items() if math.log(n * k / (n_c[c] * n_t[t])) >= 0.8 * math.log(n / n_c[c])}
    want = {}
    for (i, text), cs in zip(docs, entities, strict=True):
        want[i] = [m[0] for m in re.finditer(r"\b[a-j]{5}\b", text or "") if any((c, m[0]) in telling for c in cs)]
    assert any(want.values()) and any(n_c[c] > 1 for c, _ in telling)
    out = spans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {i: x for i, x in out.items() if i is not None} == {i: x for i, x in want.items() if i is not None}


def test_top_k_of_repeated_queries(spark):
    """Each row of a query has its own k rows, whether its copies have the same vector, another or one of other length."""
    draw = np.random.default_rng(12)
    data = [(i, draw.normal(size=4).tolist()) for i in range(1, 200)] + [(200 + i, draw.normal(size=3).tolist()) for i in range(1, 50)]
    asks = [(50, data[49][1])] * 2 + [(0, draw.normal(size=4).tolist())] * 3 + [(0, draw.normal(size=4).tolist()), (0, draw.normal(size=3).tolist())]
    data += asks
    out = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), "vec_id % 50 = 0", 5)))
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in data]
    want = Counter()
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for i, x in whole if i != q and len(x) == len(v))[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert out == want


def test_language_dictionaries_draw_on_the_whole_sample(spark):
    """Each text of the sample is in its language's dictionary, and a language of one short row shortens no other's."""
    name = lambda i: "".join("abcdefghij"[int(x)] for x in f"{i:03}")
    docs = [(i, f"{name(i)} " + prose(i, 500), "en") for i in range(100)] + [(1000, "tere tulemast", "et")]
    d = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert d["et"] == b" tere tulemast " and 0.95 * langid.DICTIONARY < len(d["en"]) <= langid.DICTIONARY
    assert all(f" {name(i)} ".encode() in d["en"] for i in range(100))


def test_evenly():
    assert langid.evenly([b"aaaa", b"b", b"cccccc"], 20) == b"aaaabcccccc"
    assert langid.evenly([b"aaaa", b"b", b"cccccc"], 7) == b"aaabccc"
    assert langid.evenly([], 7) == b""


def test_top_k_over_many_groups(spark, monkeypatch):
    """Small shards and blocks, so that groups are many: clustered vectors, copies of one vector under one id, ties."""
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 7)
    draw = np.random.default_rng(13)
    centres = draw.normal(size=(12, 6)) * 3
    data = [(i, (centres[i % 12] + draw.normal(size=6) * 0.2).tolist()) for i in range(900)]
    data += [(5000, [0.25] * 6)] * 300 + [(6000 + i, [1.0] * 6) for i in range(50)] + [(100 + i, [0.5, 0.25]) for i in range(0, 200, 10)]
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in data]
    want = Counter()
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for i, x in whole if i != q and len(x) == len(v))[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, "vec_id % 50 = 0", 5)))
    assert out == want


def test_entities_times_terms(spark):
    """Texts that share many addresses and many words: work grows with both added, and the pairs that are counted hardly at all."""
    import time

    from glyphward.llm import pii

    def table(n):
        texts = [" ".join([f"user{i}@example.com" for i in range(n) if (i + t) % 3] + [f"{letters(t)}only{letters(i)}" for i in range(5 * n)] + [f"common{letters(i)}" for i in range(5 * n)]) for t in range(8)]
        return spark.createDataFrame(list(enumerate(texts)) + [(100 + i, f"filler{letters(i)} words") for i in range(500)], "doc_id long, text string")

    def letters(i):
        return "".join(chr(97 + int(c)) for c in f"{i:05d}")

    def took(n):
        docs, start = table(n), time.time()
        got = {r["doc_id"]: r["terms"] for r in pii.find(docs).collect()}
        # words of one text tell what stands there; all others are in too few texts beside, or without addresses
        assert all(len(got[t]) >= 5 * n for t in range(8)) and not any(got[100 + i] for i in range(500))
        return time.time() - start

    took(50)
    few, many = took(100), took(800)
    assert many < 8 * few + 10


def test_searched_blocks_are_never_broadcast(spark):
    """Blocks are copied for many groups, which no estimate of the optimizer knows: such a side must not go through the driver."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    out = topk.top_k(df, "vec_id % 50 = 0")
    assert out.count() == 8 * 5
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    points = np.array([[32767.0, -32767.0], [5.0, 0.0]])
    for p in (points, points * 3, points * 1e6):
        assert (topk._arrays(topk._blob(points=p))["points"] == p).all()
