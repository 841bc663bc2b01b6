"""Operators 11 to 13 against brute force, and on the rows that none may stumble over."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphward.llm import align, mixing, registry, whiten

from .conftest import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  x ", "a▁b", "日本語 😀 é\t\n <s> <|endoftext|> <unk>　x", "naïve  text \n\n", "\n", "x" * 3000, "a " * 2000, " ▁ ", "don't, can't... 12345 ß"]


def brute_alignment(rows):
    """The contract word by word: tokens of whole texts by the two libraries, merged with two pointers."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    spell_a = lambda i: bytes(byte[c] for c in first.id_to_token(i))

    def spell_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for key, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        x, y = [spell_a(i) for i in a], [spell_b(i) for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append((key, [], [], [], []))
            continue
        links, groups, i, j, x_end, y_end, mine, yours = [], [], 0, 0, len(x[0]), len(y[0]), [0], [0]
        while True:
            links.append((a[i], b[j]))
            both = x_end == y_end
            if both:
                groups.append(",".join(str(a[t]) for t in mine) + "|" + ",".join(str(b[t]) for t in yours))
                mine, yours = [], []
                if i + 1 == len(a):
                    break
            if both or x_end < y_end:
                step_a = True
            else:
                step_a = False
            if both or not step_a:
                j += 1
                yours.append(j)
                y_next = y_end + len(y[j])
            else:
                y_next = y_end
            if step_a:
                i += 1
                mine.append(i)
                x_end += len(x[i])
            y_end = y_next
        counts.update(links)
        out.append((key, a, b, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (-1 if key is None else key, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, a, b, groups, links in out
    )


def answer(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_alignment_of_a_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert answer(registry.op11_alignment(spark, "/root/testdata/sf0.001")) == brute_alignment(rows)


@pytest.mark.parametrize("broadcast", [align.PAIRS, 0])
def test_alignment_of_odd_rows(spark, edge, monkeypatch, broadcast):
    # with no pair broadcast, counts are shuffled, but those of pairs that many rows have
    monkeypatch.setattr(align, "PAIRS", broadcast)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)] + [(101, "again"), ((1 << 62) + 1, "large id")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(more).repartition(5).withColumn("pair", F.lit(1)).withColumn("row", F.lit("x"))
    assert answer(align.report(align.align(docs, A, B))) == brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_texts_in_parts(spark, monkeypatch):
    """Whatever the parts, a text's links and groups are its own."""
    monkeypatch.setattr(align, "LONG", 50)
    rows = [(i, prose(i, 5 + 40 * i)) for i in range(6)] + [(10 + i, (t + " and more, ") * 12) for i, t in enumerate(ODD)] + [(50, "x" * 300), (51, "a b  c\n\n d " * 30), (52, "plain " * 30 + "▁ " + "plain " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = align.align(docs, A, B, groups=True)
    assert answer(align.report(out)) == brute_alignment(rows)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in out.collect() if r["n_a"])


def test_alignment_gives_groups_and_links(spark, none):
    docs = spark.createDataFrame([(1, "unbelievable tokenizers")], "doc_id long, text string")
    (row,) = align.align(docs, A, B, groups=True).collect()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count(";") == row["n_groups"] - 1
    assert sum(x["times"] for x in row["links"]) == row["n_links"]
    assert align.report(align.align(none, A, B)).count() == 0


def test_links_are_all_overlaps():
    r = np.random.default_rng(3)
    for _ in range(50):
        cut = lambda: np.diff([0, *sorted(r.choice(np.arange(1, 60), r.integers(1, 30), replace=False)), 60])
        x, y = cut(), cut()
        a, b, last = align.merged(x, y)
        xe, ye = np.cumsum(x), np.cumsum(y)
        want = [(i, j) for i in range(len(x)) for j in range(len(y)) if max(xe[i] - x[i], ye[j] - y[j]) < min(xe[i], ye[j])]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == want
        assert len(last) == len(set(xe) & set(ye))


def exact_targets(sizes):
    """The contract word by word: shares by weight, what is above twice the size shared anew among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: Fraction(2 * sizes[s]) for s in above}
        left -= sum(2 * sizes[s] for s in above)


def held(rows):
    """Each source near its target, no row more than twice, targets as the contract has them."""
    sizes, largest, taken, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        s = r["source"]
        sizes[s] += r["size"]
        largest[s] = max(largest[s], r["size"])
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 2
    want = exact_targets(sizes)
    for s in sizes:
        assert abs(target[s] - float(want[s])) <= 1e-9 * max(1.0, float(want[s]))
        assert abs(taken[s] - target[s]) <= largest[s]
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)


def test_mix_holds_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    held(rows)


def test_mix_is_its_sql_and_runs_alike(spark):
    got = registry.op12_mixing(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    with duckdb.connect() as c:
        c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = c.execute(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = mixing.digest(mixing.mix(docs)).toPandas().sort_values("doc_id").reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.equals(got)


def test_mix_of_hot_null_and_empty_sources(spark, edge, none):
    r = random.Random(5)
    rows = [(i, prose(i, r.randrange(0, 40)), "hot" if i % 3 == 0 else None if i % 7 == 0 else r.choice(["", "a", "Z", "é", "😀", "wordless"])) for i in range(3000)]
    rows += [(5000, "same words here", "hot")] * 300 + [(6000 + i, None, "silent") for i in range(20)]
    rows = [(i, "" if s == "wordless" else t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).withColumn("copies", F.lit("mine")).withColumn("target", F.lit(None).cast("string"))
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows)
    held(got)
    assert mixing.emit(out).count() == sum(x["copies"] for x in got)
    # equal rows are drawn each for itself, so they cannot all be taken alike unless their source is
    same = Counter(x["copies"] for x in got if x["doc_id"] == 5000)
    share = got[0]["target"] / got[0]["source_size"]
    assert sum(same.values()) == 300 and len(same) <= 2 and share <= 2
    assert mixing.mix(edge).count() == edge.count() and {"rep", "terms", "key"} <= set(mixing.mix(edge).columns)
    assert mixing.mix(none).count() == 0
    assert [x["copies"] for x in mixing.mix(edge.filter("text is null")).collect()] == [0]


def test_mix_plan_has_no_python(spark):
    plan = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def dense(rows):
    x = (np.floor(1024 * np.array(rows, float)) + 100000).astype(object)
    n, s = len(x), x.sum(axis=0)
    c = (x - s / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), c, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("parts,rows", [(whiten.PARTS, whiten.ROWS), (1, 50), (5, 7), (64, 33)])
def test_whitening_is_the_dense_answer(spark, parts, rows):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source = {r["vec_id"]: r["embedding"] for r in table.collect()}
    keys = sorted(source)
    n, deviation, c, values, vectors = dense([source[k] for k in keys])
    got = whiten.whiten(table.repartition(3), parts=parts, rows=rows).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(keys) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    assert got["deviation"].tolist() == np.repeat(deviation, 8).tolist()
    z = got["whitened"].to_numpy().reshape(-1, 8)
    want = c @ vectors[:, :8] / np.sqrt(values[:8])
    assert np.abs(z - want * np.sign((z * want).sum(axis=0))).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:8], values[:8] / values.sum(), rtol=1e-9)
    assert np.abs(z.T @ z / n - np.outer(z.mean(axis=0), z.mean(axis=0)) - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=3).tolist()) for i in range(20)] + [(None, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0]), (54, [])]
    longer = [(60, [1.0, 5.0]), (61, [1.0, 7.0]), (62, [1.0, 6.0])]
    docs = spark.createDataFrame(good + bad + longer, "vec_id long, embedding array<double>").withColumn("n", F.lit("mine")).withColumn("component", F.lit(9)).repartition(4)
    got = whiten.whiten(docs).toPandas()
    own = got[~got["vec_id"].isin([60, 61, 62])]
    assert len(own) == 3 * len(good) and set(own["n"]) == {len(good)} and own["identity_error"].max() < 1e-9 and own["vec_id"].isna().sum() == 3
    two = got[got["vec_id"].isin([60, 61, 62])].sort_values(["vec_id", "component"])
    # the first dimension never changes, so the second component has no variance
    assert two["component"].tolist() == [1, 2] * 3 and two["whitened"].isna().tolist() == [False, True] * 3 and set(two["n"]) == {3}
    assert np.allclose(two["explained"][two["component"] == 1], 1)
    assert whiten.whiten(docs.filter("vec_id = 54")).count() == 0 and whiten.whiten(docs.limit(0)).count() == 0
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(x["deviation"], x["whitened"], x["explained"], x["identity_error"]) for x in one] == [(0, None, None, 0.0)] * 2


def test_whitening_stays_exact_where_longs_do_not_reach(spark):
    rows = [(0, [3e14, 1.0]), (1, [-2e14, 2.0]), (2, [1e3, 2.5])]
    got = {r["vec_id"]: r["deviation"] for r in whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: None, 1: None, 2: None}
    rows = [(0, [3e5, 1.0]), (1, [-2e5, 2.0]), (2, [1e3, 2.5])]
    got = {r["vec_id"]: r["deviation"] for r in whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == dict(enumerate(dense([v for _, v in rows])[1]))
    huge = whiten.whiten(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert huge.count() == 4
