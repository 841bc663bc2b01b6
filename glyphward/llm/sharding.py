"""Operator 5: shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import before, deal
from .runtime import Scratch

#: Points of the ring.
POINTS = 1 << 14


def ring(shards: int, nodes: int) -> tuple[list[int], list[int]]:
    """(the arc of each point, the shard of each arc). A virtual node owns the points up to its own, from the last node's on.

    A node's point depends on its shard and number alone; where two fall together the lower shard has it, so a
    further shard changes the owner of points only to itself.
    """
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            owner.setdefault(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % POINTS, s)
    at = sorted(owner)
    arcs, i = [], 0
    for p in range(POINTS):
        while i < len(at) and at[i] < p:
            i += 1
        arcs.append(i % len(at))
    return arcs, [owner[p] for p in at]


def spill(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, (shard, rows) runs in rank order: what a full shard cannot take goes on clockwise.

    Each round, what an arc still holds is offered to the next virtual node; within a round arcs come in ring order.
    """
    left, room = list(counts), list(capacity)
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    n = len(counts)
    for step in range(n):
        waiting = [a for a in range(n) if left[a]]
        if not waiting:
            break
        for a in waiting:
            s = owners[(a + step) % n]
            if take := min(left[a], room[s]):
                out[a].append((s, take))
                room[s] -= take
                left[a] -= take
    return out


def shard_rows(docs: DataFrame, shards: int = 16, nodes: int = 64, key: Column | None = None) -> DataFrame:
    """Every row with its shard and slot, under the law `rows`: counts of shards differ by one at most.

    A key (the text, so equal texts lie together) falls on an arc of the ring; the arc's virtual node names the
    shard. A shard holds N // shards rows, or one more; rows beyond that continue clockwise to the next node with
    room. Only the arcs' counts (shards * nodes numbers at most) go to the driver. slot counts a shard's rows from 0.
    An arc's rows are in the order of their texts' hashes, then of their doc_ids', so equal texts are parted only where a
    shard is full, and rows have the same places however the table is partitioned. A text that very many rows have is in many
    ranges of that order. Null texts count as empty; repeated rows each have a place, in either order; an empty table gives
    no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_sharded(docs, shards, nodes, key, scratch))


def _sharded(docs: DataFrame, shards: int, nodes: int, key: Column | None, scratch: Scratch) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    arcs, owners = ring(shards, nodes)
    table = F.split(F.lit(",".join(map(str, arcs))), ",").cast("array<int>")
    point = F.pmod(F.xxhash64(text if key is None else key), F.lit(POINTS)).cast("int")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.element_at(table, point + 1).alias("_arc"),
        F.xxhash64(text if key is None else key).alias("_text"),
        F.xxhash64("doc_id").alias("_drawn"),
        # tells equal rows apart, so that not all of them are in one range
        F.monotonically_increasing_id().alias("_at"),
    )
    order = [F.col(c) for c in ("_text", "text_crc32", "size", "_drawn", "doc_id", "_at")]
    rows = deal(rows, ["_arc"], order, scratch)
    counts = [0] * len(owners)
    for r in rows.groupBy("_arc").agg(F.count(F.lit(1)).alias("c")).collect():
        counts[r["_arc"]] = r["c"]
    total = sum(counts)
    runs = spill(counts, owners, [total // shards + (s < total % shards) for s in range(shards)])
    used, plan = [0] * shards, []
    for a, parts in enumerate(runs):
        start = 0
        for s, c in parts:
            plan.append((a, start, start + c, s, used[s] - start))
            used[s] += c
            start += c
    placed = before(rows, ["_arc"], order, {"_rank": F.lit(1)})
    # the plan has a row for each arc and overflow: bounded by the ring (arcs * shards), not by the data
    plan_df = docs.sparkSession.createDataFrame(plan, "_a int, _lo long, _hi long, shard int, _base long")
    hit = (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return placed.join(F.broadcast(plan_df), hit).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") + F.col("_base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
