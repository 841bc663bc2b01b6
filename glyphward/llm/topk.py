"""Operator 8: exact inner-product search with a ball tree for each shard and branch and bound."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import ship, stash

#: Rows of a shard, queries of a block, points of a leaf; groups of near rows at most, and sampled rows for each centre.
SHARD, BLOCK, LEAF = 4096, 2048, 128
GROUPS, DRAWN = 256, 4


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree: points in leaf order; for each node its range, children (0: leaf), centre and radius."""
    order, nodes, balls = np.arange(len(ids)), [], []

    def grow(lo: int, hi: int) -> int:
        own = points[order[lo:hi]]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        me = len(nodes)
        nodes.append([lo, hi, 0, 0])
        balls.append(np.append(centre, np.sqrt(away.max()) * (1 + 1e-9)))
        if hi - lo > leaf and away.max() > 0:
            a = own[int(away.argmax())]
            b = own[int(((own - a) ** 2).sum(axis=1).argmax())]
            rank = np.argsort((own * (b - a)).sum(axis=1), kind="stable")
            order[lo:hi] = order[lo:hi][rank]
            mid = (lo + hi) // 2
            nodes[me][2], nodes[me][3] = grow(lo, mid), grow(mid, hi)
        return me

    grow(0, len(ids))
    return {"ids": ids[order], "points": points[order], "nodes": np.array(nodes, np.int64), "balls": np.array(balls)}


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best points, but for its own; unfilled places score -inf.

    A node whose bound q.c + |q| r is below the query's current kth score, or below floor, the kth score known from
    other shards, is left out for that query. Ties go to the smaller id. Sums of integers are exact below 2**53.
    """
    n = len(queries)
    score, best = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.astype(float).copy()
    norm = np.sqrt((queries**2).sum(axis=1))
    nodes, balls, ids, points = tree["nodes"], tree["balls"], tree["ids"], tree["points"]

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        b = queries[active] @ balls[node, :-1] + norm[active] * balls[node, -1]
        return b + 1e-9 * np.abs(b) + 1e-6

    stack = [(0, np.arange(n), bound(0, np.arange(n)))]
    while stack:
        node, active, reach = stack.pop()
        active = active[reach >= kth[active]]
        if not len(active):
            continue
        lo, hi, left, right = nodes[node]
        if left:
            children = [(c, active, bound(c, active)) for c in (left, right)]
            stack += sorted(children, key=lambda x: x[2].mean())
            continue
        for at in range(lo, hi, 4 * LEAF):  # a leaf of equal points may be large
            part = slice(at, min(hi, at + 4 * LEAF))
            own = queries[active] @ points[part].T
            own[query_ids[active][:, None] == ids[part][None, :]] = -np.inf
            some = own.max(axis=1) >= kth[active]
            who = active[some]
            if not len(who):
                continue
            s = np.concatenate([score[who], own[some]], axis=1)
            i = np.concatenate([best[who], np.broadcast_to(ids[part], (len(who), part.stop - part.start))], axis=1)
            keep = np.lexsort((i, -s), axis=1)[:, :k]
            score[who], best[who] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            kth[who] = np.maximum(kth[who], score[who, -1])
    return score, best


def _blob(**arrays: np.ndarray) -> bytes:
    """The arrays, points (whole numbers) in the narrowest type that holds them: 16 bits for components up to 127 at scale 256."""
    points = arrays["points"]
    kind = next((t for t in (np.int16, np.int32) if not points.size or np.abs(points).max() <= np.iinfo(t).max), np.float64)
    arrays["points"] = points.astype(kind)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(blob: bytes) -> dict[str, np.ndarray]:
    out = dict(np.load(io.BytesIO(blob)))
    return out | {"points": out["points"].astype(np.float64)}


def _whole(vectors: list, scale: int) -> np.ndarray:
    return np.floor(scale * np.stack([np.asarray(x, np.float64) for x in vectors]))


def _centres(rows: DataFrame, sizes: dict[int, int], scale: int) -> dict[int, np.ndarray]:
    """For each vector length of more than one shard: the centres of its groups, rows drawn by a hash of vec_id.

    The sample is bounded (DRAWN * GROUPS rows of a length, about); any centres give right results.
    """
    share = {d: min(1.0, DRAWN * min(GROUPS, -(-n // SHARD)) / n) for d, n in sizes.items() if n > SHARD}
    if not share:
        return {}
    part = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) / 1e6
    few = rows.filter(F.col("dim").isin(*share)).filter(draw <= F.try_element_at(part, F.col("dim"))).select("dim", "embedding").distinct()
    most = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("embedding")))
    out: dict[int, list] = {}
    for r in few.withColumn("r", most).filter(F.col("r") <= GROUPS).collect():
        out.setdefault(r["dim"], []).append((r["r"], r["embedding"]))
    return {d: _whole([v for _, v in sorted(x)[: -(-sizes[d] // SHARD)]], scale) for d, x in out.items()}


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where the SQL condition is_query holds.

    Query rows that share a vec_id are separate queries, each with its own k rows.

    Components become floor(scale * x). Vectors that are null or empty, or hold null or non-finite components, take
    no part, nor do null vec_ids; vectors are compared with those of their own length. Rows that share a vec_id are
    separate candidates, none of them for a query of that id. An empty table gives no rows; other columns are ignored.

    Rows are dealt to the nearest of a bounded number of centres; a group's rows, however alike, go to shards of SHARD
    rows on average, its queries to blocks of BLOCK rows. A block first searches the shards of its own group. Its kth scores
    then rule out all groups whose ball holds nothing better for any query of the block, before any shard is sent to it;
    in the shards of the others they are the floor of branch and bound.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = _centres(rows, sizes, scale)
    own_centres = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's group, its distance from the centre, and a number that tells rows of the task apart."""
        count = 0
        for pdf in batches:
            group, away = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim in pdf["dim"].unique():
                at = np.flatnonzero(pdf["dim"].to_numpy() == dim)
                points = _whole(pdf["embedding"].iloc[at].to_list(), scale)
                c = own_centres.value.get(int(dim), np.zeros((1, int(dim))))
                near = (points @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
                group[at], away[at] = near, np.sqrt(((points - c[near]) ** 2).sum(axis=1))
            salt = count + np.arange(len(pdf))
            count += len(pdf)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "dim": pdf["dim"], "q": pdf["q"], "grp": group, "away": away, "salt": salt})

    dealt = stash(rows.mapInPandas(deal, "vec_id long, embedding array<double>, dim int, q boolean, grp int, away double, salt long"))
    groups = dealt.groupBy("dim", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max("away").alias("r")).collect()
    balls: dict[int, list] = {}
    for g in groups:
        c = centres.get(g["dim"], np.zeros((1, g["dim"])))[g["grp"]]
        balls.setdefault(g["dim"], []).append((g["grp"], c, g["r"] * (1 + 1e-9)))
    own_balls = spark.sparkContext.broadcast({d: (np.array([g for g, _, _ in x]), np.stack([c for _, c, _ in x]), np.array([r for _, _, r in x])) for d, x in balls.items()})
    schema = "dim int, grp int, shards int, blocks int"
    table = spark.createDataFrame([(g["dim"], g["grp"], -(-g["n"] // SHARD), -(-(g["nq"] or 0) // BLOCK)) for g in groups], schema)
    placed = dealt.drop("away").join(F.broadcast(table), ["dim", "grp"])

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["vec_id"].to_numpy(np.int64), _whole(pdf["embedding"].to_list(), scale))
        return pd.DataFrame({"dim": [pdf["dim"][0]], "grp": [pdf["grp"][0]], "tree": [_blob(**tree)]})

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = _blob(ids=pdf["vec_id"].to_numpy(np.int64), points=_whole(pdf["embedding"].to_list(), scale), floor=np.full(len(pdf), -np.inf))
        return pd.DataFrame({"dim": [pdf["dim"][0]], "grp": [pdf["grp"][0]], "block": [pdf["block"][0]], "asks": [asks]})

    spot = F.xxhash64("salt", "vec_id")
    trees = stash(placed.withColumn("shard", F.pmod(spot, F.col("shards")).cast("int")).groupBy("dim", "grp", "shard").applyInPandas(plant, "dim int, grp int, tree binary"))
    asks = placed.filter("q").withColumn("block", F.pmod(spot, F.col("blocks")).cast("int")).groupBy("dim", "grp", "block").applyInPandas(bundle, "dim int, grp int, block int, asks binary")
    asks = stash(asks.withColumnRenamed("grp", "home"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, home, block, tree, blob in zip(pdf["dim"], pdf["home"], pdf["block"], pdf["tree"], pdf["asks"], strict=True):
                a = _arrays(blob)
                score, ids = search(_arrays(tree), a["ids"], a["points"], a["floor"], k)
                hit = np.isfinite(score)
                n = hit.sum(axis=1)
                yield pd.DataFrame({"query_id": np.repeat(a["ids"], n), "dim": dim, "home": home, "block": block, "row": np.repeat(np.arange(len(n)), n), "vec_id": ids[hit], "score": score[hit].astype(np.int64)})

    def better(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks with their queries' kth scores as floors, once for each other group that may hold something as good."""
        for pdf in batches:
            for dim, home, block, blob, row, kth in zip(pdf["dim"], pdf["home"], pdf["block"], pdf["asks"], pdf["rows"], pdf["kths"], strict=True):
                a = _arrays(blob)
                if row is not None:
                    a["floor"][np.asarray(row, np.int64)] = kth
                group, centre, radius = own_balls.value[int(dim)]
                reach = a["points"] @ centre.T + np.sqrt((a["points"] ** 2).sum(axis=1))[:, None] * radius
                some = (reach + 1e-9 * np.abs(reach) + 1e-6 >= a["floor"][:, None]).any(axis=0) & (group != home)
                full = _blob(**a)
                for g in group[some]:
                    yield pd.DataFrame({"dim": [dim], "home": [home], "block": [block], "grp": [g], "asks": [full]})

    hits = "query_id long, dim int, home int, block int, row long, vec_id long, score long"
    query = Window.partitionBy("dim", "home", "block", "row").orderBy(F.desc("score"), "vec_id")
    # sizes of files say little of packed trees and of blocks that mapInPandas copies for many groups: neither is ever broadcast
    trees = trees.hint("merge")
    first = stash(asks.withColumn("grp", F.col("home")).join(trees, ["dim", "grp"]).mapInPandas(find, hits).withColumn("rank", F.row_number().over(query)).filter(F.col("rank") <= k))
    floors = first.filter(F.col("rank") == k).groupBy("dim", "home", "block").agg(F.collect_list(F.struct("row", "score")).alias("f"))
    floors = floors.select("dim", "home", "block", F.col("f.row").alias("rows"), F.col("f.score").alias("kths"))
    wanted = asks.join(floors.hint("merge"), ["dim", "home", "block"], "left").select("dim", "home", "block", "asks", "rows", "kths").mapInPandas(better, "dim int, home int, block int, grp int, asks binary")
    other = wanted.join(trees, ["dim", "grp"]).mapInPandas(find, hits)
    found = first.drop("rank").unionByName(other)
    return found.withColumn("rank", F.row_number().over(query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
