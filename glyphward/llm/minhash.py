"""Operator 1: near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Scratch, heavy, heavy_join, only, ship, stash
from .textvec import U, distinct, mix, pieces, shingles

#: Bands of rows: a pair of similarity 0.8 shares none of them with probability (1 - 0.8**ROWS)**BANDS < 1e-6.
BANDS, ROWS = 48, 6
#: A pair is not verified if its sketches agree in so few bins that a similar pair's would with this probability at most.
UNLIKELY = 1e-9
#: Hubs of a band beside its least class, and the share of all shingle rows from which the counts of a shingle are broadcast (so 1 / HEAVY at most).
STARS, HEAVY = 2, 0.001
#: One in so many classes is looked at to find the bands that hold a large share of all.
LOOK = 64
#: Fingerprints that a task keeps to see repeated sets.
SEEN = 1_000_000


def fast_sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes.

    In round i < size each item falls in one random bin with value (i, hash); in round size + i all items fall in
    bin i. A bin keeps its least value. Rounds stop when all bins are full, so each is filled, at the latest in
    round 2 * size - 1, and bins agree with probability J with the concentration of independent draws.
    """
    best = np.full(size, np.iinfo(np.uint64).max, U)
    n = len(items)
    step, i = max(1, min(size, 2 * size // n)), 0
    while i < size:
        rounds = np.arange(i, min(size, i + step), dtype=U)
        h = mix(items[None, :] ^ mix(rounds + U(0x51ED2701))[:, None])
        bins = ((h & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64)
        # the round leads, so a later round never replaces a value of an earlier one
        np.minimum.at(best, bins.ravel(), ((rounds << U(52))[:, None] | (h >> U(12))).ravel())
        i += step
        if (best != np.iinfo(np.uint64).max).all():
            return best
    for j in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[j] = (U(size + int(j)) << U(52)) | (mix(items ^ mix(np.array([size + j + 0x51ED2701], U))).min() >> U(12))
    return best


def bands(sketch: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    part = mix(sketch.reshape(n_bands, rows))
    key = np.arange(1, n_bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix(key * U(0x9FB21C651E98DF25) + part[:, j])
    return key.view(np.int64)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that do not depend on the order of its hashes."""
    return int(own.sum(dtype=U).view(np.int64)), int(mix(own ^ U(0xABCDEF)).sum(dtype=U).view(np.int64))


def _sketches(docs: DataFrame, k: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the whole set), keys (of bands).

    keys is null for empty sets, for rows without a doc_id and where the task has given those of an equal set.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in pieces(batches):
            hashes, offs = shingles(b.column("text"), k)
            known = b.column("doc_id").is_valid().to_pylist()
            n, f1, f2, keys = [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for d in range(len(offs) - 1):
                own = distinct(hashes[offs[d] : offs[d + 1]])
                me = _fingerprint(own)
                first = known[d] and len(own) > 0 and me not in seen
                if first:
                    seen.add(me)
                n.append(len(own))
                f1.append(me[0])
                f2.append(me[1])
                keys.append(bands(fast_sketch(own, n_bands * rows), n_bands, rows) if first else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def _sets(docs: DataFrame, members: DataFrame, k: int, size: int, scratch: Scratch) -> DataFrame:
    """id, items (the full set as sorted 64-bit hashes), sketch (a byte of each bin) of members (id, rep, f1, f2).

    The set of a class is that of the row of document rep which has its fingerprint.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            hashes, offs = shingles(b.column("text"), k)
            ids, items, sketch = [], [], []
            for d, (i, *f) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "f1", "f2")), strict=True)):
                own = distinct(hashes[offs[d] : offs[d + 1]])
                if i not in seen and tuple(f) == _fingerprint(own):
                    seen.add(i)
                    ids.append(i)
                    items.append(own.tobytes())
                    sketch.append(mix(fast_sketch(own, size)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary()), pa.array(sketch, pa.binary())], ["id", "items", "sketch"])

    # the texts of members alone are shuffled, if any
    picked = only(docs.select(F.col("doc_id").alias("rep"), "text"), scratch.stash(members.select("rep").distinct()), "rep")
    own = picked.join(members.select("id", "rep", "f1", "f2"), "rep")
    return own.select("text", "id", "f1", "f2").mapInArrow(work, "id long, items binary, sketch binary")


def _items(sets: DataFrame) -> DataFrame:
    """id, item: a row for each hash of a set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column("id").to_pylist(), b.column("items").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(part)], ["id", "item"])

    return sets.select("id", "items").mapInArrow(work, "id long, item long")


def _overlapping(left: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: the pairs of left (id, n, c, out) with one out at least and different c that prefix filtering cannot rule out.

    Shingles are ordered from rare to common, those of one set alone first. r counts a set's shingles from one on, so
    what two sets share is at most the lesser r of the first shingle that both hold: no pair of similarity percent / 100
    is lost, and sets that differ in more than their few rare shingles do not meet. Counts of the most common shingles
    are broadcast, so that no key of the join holds more than HEAVY of the rows.
    """
    rows = scratch.stash(_items(sets.join(left.select("id"), "id", "left_semi")))
    counts = scratch.stash(rows.groupBy("item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    bar = (counts.agg(F.sum("df")).first()[0] or 0) * HEAVY
    hot = F.broadcast(counts.filter(F.col("df") >= bar))
    light = rows.join(hot.select("item"), "item", "left_anti").join(counts.filter(F.col("df") < bar), "item")
    order = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("item"))
    prefix = rows.join(hot, "item").unionByName(light).withColumn("r", F.row_number().over(order).cast("long"))
    prefix = scratch.stash(prefix.join(left, "id").filter(100 * F.col("r") >= percent * F.col("n")).select("item", "id", "n", "c", "out", "r"))
    scratch.drop(rows, counts)
    wanted = prefix.groupBy("item").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("out").alias("any")).filter("lo <> hi and any").select("item")
    prefix = scratch.stash(prefix.join(wanted, "item", "left_semi"))
    one = prefix.filter("out").select("item", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc"), F.col("r").alias("xr"))
    two = prefix.select("item", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("c").alias("yc"), F.col("r").alias("yr"), F.col("out").alias("yout"))
    enough = (100 + percent) * F.least("xr", "yr") >= percent * (F.col("xn") + F.col("yn"))
    pairs = one.join(two, "item").filter((F.col("xc") != F.col("yc")) & (~F.col("yout") | (F.col("x") < F.col("y"))) & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def least_bins(size: int, percent: int) -> int:
    """The bins in which sketches of similarity percent / 100 agree at least, but for probability UNLIKELY (Hoeffding)."""
    return max(0, math.floor(size * (percent / 100 - math.sqrt(-math.log(UNLIKELY) / (2 * size)))))


def _alike(pairs: DataFrame, sets: DataFrame, bins: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sketches agree in so many bins at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("x", "y"))
            yield b.filter(pa.array((x == y).sum(axis=1) >= bins)).select(["a", "b"])

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    two = heavy_join(one, sets.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a", scratch.stash(heavy(pairs, "a", HEAVY)))
    return two.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, bins: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union; a may stand in many pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    near = scratch.stash(_alike(pairs, sets, bins, scratch))
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    own = sets.select("id", "items").join(ids, "id", "left_semi")
    one = near.join(own.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    two = heavy_join(one, own.select(F.col("id").alias("a"), F.col("items").alias("x")), "a", scratch.stash(heavy(near, "a", HEAVY)), "x")
    return two.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the least id reachable) of all ids in links (a, b), by alternating large and small stars.

    Each round rewrites the links around each id's least neighbour, until a round changes nothing.
    """
    links = scratch.stash(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    state = None
    while True:
        both = links.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionByName(links.select(F.col("hi").alias("v"), F.col("lo").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        before, links = links, scratch.stash(small.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct())
        scratch.drop(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        state = now


def _shared(sketched: DataFrame, classes: DataFrame, hot_bar: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, id, n, lead, lead_n, hub0, hub1 ... of bands that more than one class shares; the hot keys).

    lead: the least class of the band; each hub (id, n): another of its classes, drawn by a hash. Bands are grouped by one
    shuffle of their rows. Those that hold a large share of all classes are known from one class in LOOK, so at most
    LOOK * bands / hot_bar of them; their leads and hubs are pre-aggregated and broadcast, no task has all of such a band.
    """
    keyed = sketched.filter(F.col("keys").isNotNull())
    look = keyed.filter(F.pmod(F.xxhash64("f1"), F.lit(LOOK)) == 0).select(F.explode("keys").alias("key"))
    hot = scratch.stash(look.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= hot_bar).select("key"))
    ours = classes.select("n_shingles", "f1", "f2", "id")
    banded = keyed.join(ours, ["n_shingles", "f1", "f2"]).select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    least = F.min(F.struct("id", "n"))
    hubs = {f"hub{turn}": F.min(F.when(F.col("id") != F.col("first.id"), _drawn(turn, "n"))) for turn in range(STARS)}
    own = Window.partitionBy("key")
    light = banded.join(F.broadcast(hot), "key", "left_anti").select("key", "id", "n", least.over(own).alias("first"), F.max("id").over(own).alias("last"))
    found = light.filter("first.id <> last").select("key", "id", "n", "first", *[h.over(own).alias(n) for n, h in hubs.items()])
    if not hot.isEmpty():
        rows = scratch.stash(banded.join(F.broadcast(hot), "key", "left_semi").distinct())
        ends = scratch.stash(rows.groupBy("key").agg(least.alias("first"), F.max("id").alias("last")).filter("first.id <> last").drop("last"))
        led = rows.join(F.broadcast(ends), "key")
        found = found.unionByName(led.join(F.broadcast(led.groupBy("key").agg(*[h.alias(n) for n, h in hubs.items()])), "key"))
    # a set may have come from several tasks
    return scratch.stash(found.select("key", "id", "n", F.col("first.id").alias("lead"), F.col("first.n").alias("lead_n"), *hubs)), hot


def _drawn(turn: int, *more: str) -> Column:
    """What the hub of a band in that turn has least of all its classes: a hash of the class."""
    return F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", *more)


def _unsettled(own: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n, c, out: classes (key, id, n, c, hubs) of bands which, but for the hubs of all turns, are in different components.

    out: in another component than a drawn class of the band, so of two classes apart one is out at least. Hot bands
    are pre-aggregated, the others looked at where their rows meet.
    """
    open_rows = own.filter(reduce(operator.and_, [F.col("id") != F.col(f"hub{turn}.id") for turn in range(STARS)])).select("key", "id", "n", "c")
    ends = {"lo": F.min("c"), "hi": F.max("c"), "ref": F.min(_drawn(STARS, "c"))}
    band = Window.partitionBy("key")
    light = open_rows.join(F.broadcast(hot), "key", "left_anti")
    open_ = light.select("id", "n", "c", *[x.over(band).alias(n) for n, x in ends.items()]).filter("lo <> hi")
    if not hot.isEmpty():
        rows = scratch.stash(open_rows.join(F.broadcast(hot), "key", "left_semi"))
        apart = rows.groupBy("key").agg(*[x.alias(n) for n, x in ends.items()]).filter("lo <> hi")
        open_ = open_.unionByName(rows.join(F.broadcast(apart), "key").select("id", "n", "c", *ends))
    out = open_.withColumn("out", F.col("c") != F.col("ref.c"))
    return out.groupBy("id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.max("out").alias("out"))


def _classes(known: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(n_shingles, f1, f2, size, rep: the least doc_id, id; links between classes of one document, if any has several).

    id is rep, but where documents have rows with different sets it is a hash, as rep would not tell classes apart.
    """
    same = ["n_shingles", "f1", "f2"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    ends = known.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi"))
    several = scratch.stash(ends.filter("lo <> hi").select("doc_id"))
    if several.isEmpty():
        return scratch.stash(classes.withColumn("id", F.col("rep"))), None
    mixed = several.select(F.col("doc_id").alias("rep"), F.lit(True).alias("mixed"))
    named = classes.join(mixed, "rep", "left").withColumn("id", F.when(F.col("mixed"), F.xxhash64("rep", *same)).otherwise(F.col("rep"))).drop("mixed")
    named = scratch.stash(named.select(*same, "rep", "size", "id"))
    rows = known.select("doc_id", *same).join(several, "doc_id", "left_semi").distinct().join(named.select(*same, "id"), same).select("doc_id", "id")
    links = rows.join(rows.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))
    return named, scratch.stash(links)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Sets: distinct k-word shingles of whole texts (fewer words: the whole sequence). Links: Jaccard similarity of at
    least percent / 100, confirmed on full sets. component_id is the least doc_id reachable; kept marks that row.
    Null, empty and blank texts have empty sets and no links. Equal sets are one class, whose least doc_id stands
    for it. Rows of one doc_id count as one document, which has the links of all their texts; null doc_ids take no part:
    their component_id is null, they are kept. An empty table gives no rows; other columns are ignored.

    Candidates are classes that share a band. First each class is held against the least class of each of its bands and
    a few drawn hubs of it, all in one pass. Then the other classes of bands whose classes are in different components meet
    through the rare shingles of their sets, which loses no pair of them that is similar enough. So large groups cost a few tests a member, and classes that only share a passage rarely meet.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_near_duplicates(docs, k, percent, n_bands, rows, scratch))


def _near_duplicates(docs: DataFrame, k: int, percent: int, n_bands: int, rows: int, scratch: Scratch) -> DataFrame:
    sketched = scratch.stash(_sketches(docs, k, n_bands, rows))
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).drop("keys")
    classes, links = _classes(known, scratch)
    total, docs_total = classes.agg(F.count(F.lit(1)), F.sum("size")).first()
    shared, hot_keys = _shared(sketched, classes, max(8, int(HEAVY * total / LOOK)), scratch)
    members = scratch.stash(classes.join(shared.select("id").distinct(), "id", "left_semi"))
    sets = scratch.stash(_sets(docs, members, k, n_bands * rows, scratch))
    bins = least_bins(n_bands * rows, percent)
    alike = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    # classes that are no lead of the band, each against the lead and the hubs
    rest = scratch.stash(shared.filter(F.col("id") != F.col("lead")).drop("lead", "lead_n").distinct())
    ends = F.explode(F.array(F.struct(F.col("lead").alias("id"), F.col("lead_n").alias("n")), *[F.struct(F.col(f"hub{t}.id").alias("id"), F.col(f"hub{t}.n").alias("n")) for t in range(STARS)]))
    tests = shared.filter(F.col("id") != F.col("lead")).select("id", "n", ends.alias("hub")).filter((F.col("id") != F.col("hub.id")) & alike(F.col("n"), F.col("hub.n")))
    tests = scratch.stash(tests.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    verified = scratch.stash(_verified(tests, sets, percent, bins, scratch))
    links = scratch.stash(verified.unionByName(links)) if links is not None else verified
    found = scratch.stash(components(links, scratch))
    own = scratch.stash(rest.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))
    left = scratch.stash(_unsettled(own, hot_keys, scratch))
    if not left.isEmpty():
        backwards = tests.select(F.col("b").alias("a"), F.col("a").alias("b"))
        tries = scratch.stash(_overlapping(left, sets, percent, scratch).join(tests.unionByName(backwards), ["a", "b"], "left_anti"))
        if not tries.isEmpty():
            links = scratch.stash(links.unionByName(_verified(tries, sets, percent, bins, scratch)))
            found = scratch.stash(components(links, scratch))
    # the class of a row tells its component; a hot class is broadcast
    ours = classes.join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = ours.groupBy("c").agg(F.min("rep").alias("least"))
    ours = scratch.stash(ours.join(least, "c").select("n_shingles", "f1", "f2", "size", F.col("least").alias("component_id")))
    hot = ours.filter(F.col("size") >= HEAVY * (docs_total or 0)).select("n_shingles", "f1", "f2")
    same = ["n_shingles", "f1", "f2"]
    got = heavy_join(known, ours.drop("size"), same, hot).select("doc_id", "n_shingles", "component_id")
    none = sketched.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return got.unionByName(none).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that near_duplicates() keeps, with all their columns; of rows with one doc_id one stays: that with the least
    text, then the least JSON of all its columns.

    Rows with null doc_id, which take no part, all stay.
    """
    found = near_duplicates(docs, k, percent)
    gone = stash(found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"))
    stay = only(docs.filter("doc_id is not null"), gone, "doc_id", out=True)
    several = stash(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not several.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = only(stay, several, "doc_id").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row"))
        stay = only(stay, several, "doc_id", out=True).unionByName(one.select("row.*"))
    return stay.unionByName(docs.filter("doc_id is null"))
