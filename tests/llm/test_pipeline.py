"""The pipeline's stages keep their contracts on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    from glyphward.llm.runtime import stash

    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] and sizes[3] > 0.5 * sizes[0]
    assert docs.agg({"offset": "max"}).first()[0] < 2048


def test_stages_against_brute_force(spark):
    """Each stage on all that the stage before it kept: what it keeps, and what it makes of texts."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from glyphward.llm import langid, pii, quality
    from glyphward.llm.runtime import stash

    from .test_near_dedup import linked

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_rows = docs.collect()

    kept = stash(stage["language_id"](spark, docs, SF))
    judge = langid.Classifier(langid.learn(langid.training(docs)))
    told = {r["doc_id"]: judge.predict(r["text"]) for r in all_rows}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (lang, _, margin) in told.items() if lang != "und" and margin >= 0.002}

    good = stash(stage["quality_classifier"](spark, kept, SF))
    model = quality.learn(kept, quality.training(spark.read.parquet(f"{SF}/labels.parquet")))
    import pyarrow as pa

    rows = kept.collect()
    score = model.score(quality.features(pa.array([r["text"] for r in rows])))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, s in zip(rows, score, strict=True) if s >= quality.LEAST}
    assert {r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").join(good, "doc_id").collect()} >= {1}

    single = stash(stage["near_dedup"](spark, good, SF))
    rows = good.collect()
    least = linked([(r["doc_id"], r["text"]) for r in rows], k=5)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c in least.items() if i == c)

    clean = stash(stage["personal_data"](spark, single, SF))
    marks = {r["doc_id"]: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.report(pii.find(single)).collect()}
    want = {r["doc_id"]: pii.sanitised(r["text"], marks[r["doc_id"]]) for r in single.collect()}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts == want and any("[email]" in t for t in texts.values()) and not any(pii.base_spans(t) for t in texts.values())

    packed = stage["packing"](spark, clean, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}
    covered, places = {i: 0 for i in ids}, {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == covered[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {i: len(x) for i, x in ids.items()}
    for own in places.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_stages_of_empty_tables(spark, tmp_path):
    """Every stage takes a table without rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
