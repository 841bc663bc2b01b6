"""Near-duplicates of hard tables against all pairs."""

import random

import numpy as np

from glyphward.llm import minhash

from .conftest import prose
from .test_operators import rows, shingle_set


def linked(docs, k=4):
    """doc_id -> the least doc_id reachable; rows of one doc_id are one document."""
    up = {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in docs]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return {i: top(i) for i in up}


def found(spark, docs, k=4):
    out = rows(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k))
    assert len(out) == len(docs) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return {r["doc_id"]: r["component_id"] for r in out}


def test_every_text_of_a_repeated_id_links(spark):
    a, b = prose(1, 100), prose(2, 100)
    docs = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (1, a), (9, prose(3, 100))]
    assert found(spark, docs) == linked(docs) == {1: 1, 2: 1, 3: 1, 9: 9}


def test_ids_that_only_a_repeated_id_joins(spark):
    """An id stands for all of its texts: what is like one of them joins what is like another."""
    texts = [prose(i, 80) for i in range(4)]
    docs = [(5, texts[0]), (5, texts[1]), (7, texts[1]), (7, texts[2]), (2, texts[2] + " x"), (8, texts[3]), (6, texts[0])]
    assert found(spark, docs) == linked(docs) == {5: 2, 7: 2, 2: 2, 8: 8, 6: 2}


def test_rows_without_id_take_no_keys(spark):
    """A row without an id in front of others with its set hides none of them."""
    t = prose(4, 90)
    docs = [(None, t), (4, t), (3, t + " y"), (None, t)]
    out = rows(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), k=4))
    assert sorted(r["component_id"] for r in out if r["doc_id"] is not None) == [3, 3]


def test_large_groups_and_shared_passages(spark, monkeypatch):
    """Copies, near copies around one text and in chains, and texts that share a passage, with bands that count as hot."""
    monkeypatch.setattr(minhash, "LOOK", 2)
    draw = random.Random(3)
    base, passage, docs = prose(10, 60).split(), prose(11, 60), []
    for i in range(260):
        own = base.copy()
        for at in draw.sample(range(60), draw.choice([1, 1, 2, 3])):
            own[at] = f"edit{draw.randrange(10_000)}"
        docs.append((1000 - i, " ".join(own)))
    docs += [(2000 + i, " ".join(base)) for i in range(60)]
    docs += [(3000 + i, f"{prose(100 + i, draw.choice([4, 8, 15, 60]))} {passage}") for i in range(150)]
    words = prose(12, 70).split()
    for i in range(60):
        words = [f"c{i}-{j}" if j == (3 * i) % 70 else w for j, w in enumerate(words)]
        docs.append((4000 + i, " ".join(words)))
    draw.shuffle(docs)
    got, want = found(spark, docs), linked(docs)
    assert got == want and len(set(want.values())) > 50


def test_sketch_floor_keeps_similar_pairs():
    """Sketches of sets at the threshold agree in more bins than the floor, whatever the size of the sets."""
    floor = minhash.least_bins(288, 80)
    assert 150 < floor < 0.7 * 288
    r = np.random.default_rng(5)
    for n in (9, 18, 90, 900):
        for _ in range(40):
            x = r.integers(1, 1 << 62, n, dtype=np.uint64)
            same = n * 8 // 9  # 8/9 of each set in both: similarity 0.8
            y = np.concatenate([x[:same], r.integers(1, 1 << 62, n - same, dtype=np.uint64)])
            a, b = (minhash.mix(minhash.fast_sketch(v, 288)).astype(np.uint8) for v in (x, y))
            assert (a == b).sum() >= floor


def test_all_links_of_a_given_table(spark):
    """As registered: every component and set size of the whole table, against all pairs."""
    from glyphward.llm import registry

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = rows(registry.op1_minhash(spark, "/root/testdata/sf0.01"))
    want = linked(docs)
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(set(want.values())) < len(want)
    sizes = {i: len(shingle_set(t, 4)) for i, t in docs}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"]) for r in out)


def test_the_row_that_stays_of_a_repeated_id(spark):
    t = prose(21, 80)
    docs = spark.createDataFrame([(1, t + " b", "x", {"k": 1}), (1, t + " a", "z", {"k": 2}), (1, t + " a", "y", None), (2, prose(22, 80), "w", None), (None, t, "v", None)], "doc_id long, text string, source string, more map<string,int>")
    for parts in (1, 4):
        got = minhash.one_of_each(docs.repartition(parts)).collect()
        assert sorted((r["doc_id"] or 0, r["source"]) for r in got) == [(0, "v"), (1, "y"), (2, "w")]
