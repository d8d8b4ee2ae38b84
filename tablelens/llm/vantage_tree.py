"""Nearest neighbours by cosine: a vantage-point tree per shard of vectors, pruned by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import batched
from tablelens.session import cut_lineage

TOP = 5
#: Different vectors in a tree, and queries that walk through it together, about.
SHARD, QUERIES = 1 << 15, 1 << 12
#: Vectors in a leaf.
LEAF = 64
#: Different vectors from which every query gets a first bound; any number gives the same answer.
SAMPLE = 2_048
#: Distances are told apart from this on; what lies within is compared by exact scores.
SLACK = 1e-7

TREE = "size int, shard int, vectors binary, nodes binary, radii binary, ids binary, none binary, starts binary"
FOUND = "place long, query long, score double, none boolean, id long"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by a power of two near the largest component, which is exact: no square overflows, and no cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Row by row; a pair's value doesn't depend on where it stands, so equal vectors get equal scores."""
    return (a * b).sum(axis=1) / (length_a * length_b)


def grow(units: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, nodes ``(begin, end, vantage, near, far)`` and radii ``(near least, near most, far least, far most)``.

    A node's vantage point is its point farthest from their mean; half of the points are nearer to it than the rest. Leaves have no children (-1).
    """
    order, nodes, radii = np.arange(len(units)), [], []
    stack = [(0, len(units), -1, 0)]
    while stack:
        begin, end, above, side = stack.pop()
        if above >= 0:
            nodes[above][3 + side] = len(nodes)
        at = order[begin:end]
        nodes.append([begin, end, -1, -1, -1])
        radii.append([0.0] * 4)
        if end - begin <= leaf:
            continue
        vantage = at[np.argmin(units[at] @ units[at].mean(axis=0))]
        away = np.sqrt(np.maximum(0, 2 - 2 * (units[at] @ units[vantage])))
        by = np.argsort(away, kind="stable")
        order[begin:end], away, half = at[by], away[by], (end - begin) // 2
        nodes[-1][2] = vantage
        radii[-1] = [away[0], away[half - 1], away[half], away[-1]]
        stack += [(begin + half, end, len(nodes) - 1, 1), (begin, begin + half, len(nodes) - 1, 0)]
    return order, np.array(nodes, np.int64).reshape(-1, 5), np.array(radii).reshape(-1, 4)


class Search:
    """The best ``wanted`` points of a tree for each of several queries, by score and then by the points' ``rank``."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray, rank: np.ndarray) -> None:
        self.vectors, self.nodes, self.radii, self.rank = vectors, nodes, radii, rank
        self.lengths = lengths(vectors)
        self.units = vectors / self.lengths[:, None]
        self.judged = 0

    def find(self, queries: np.ndarray, floor: np.ndarray, wanted: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places, best first; -1 where there is none. ``floor``: scores that at least ``wanted`` vectors of the table reach."""
        length = lengths(queries)
        units = queries / length[:, None]
        score, place = np.full((len(queries), wanted), -np.inf), np.full((len(queries), wanted), -1)
        floor = floor.copy()
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, active, nearest = stack.pop()
            reach = np.sqrt(np.maximum(0, 2 - 2 * floor[active])) + SLACK
            active = active[factor * nearest <= reach]
            if not len(active):
                continue
            begin, end, vantage, near, far = self.nodes[node]
            if near < 0:
                self.judged += len(active) * (end - begin)
                rough = units[active] @ self.units[begin:end].T
                i, j = np.nonzero(rough >= floor[active, None] - SLACK * SLACK)
                self._keep(queries, length, active[i], j + begin, score, place, floor)
                continue
            away = np.sqrt(np.maximum(0, 2 - 2 * (units[active] @ self.units[vantage])))
            a, b, c, d = self.radii[node]
            inside, outside = np.maximum(0, np.maximum(a - away, away - b)), np.maximum(0, np.maximum(c - away, away - d))
            sides = [(far, active, outside), (near, active, inside)]
            stack += sides if 2 * np.count_nonzero(inside <= outside) >= len(active) else sides[::-1]  # the side that is nearer for most comes first
        return score, place

    def _keep(self, queries: np.ndarray, length: np.ndarray, who: np.ndarray, what: np.ndarray, score: np.ndarray, place: np.ndarray, floor: np.ndarray) -> None:
        if not len(who):
            return
        wanted = score.shape[1]
        exact = cosines(queries[who], self.vectors[what], length[who], self.lengths[what])
        some = np.unique(who)
        held = place[some] >= 0
        who = np.concatenate((who, np.repeat(some, held.sum(axis=1))))
        what, exact = np.concatenate((what, place[some][held])), np.concatenate((exact, score[some][held]))
        order = np.lexsort((self.rank[what], -exact, who))
        who, what, exact = who[order], what[order], exact[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        few = turn < wanted
        score[some], place[some] = -np.inf, -1
        score[who[few], turn[few]], place[who[few], turn[few]] = exact[few], what[few]
        floor[some] = np.maximum(floor[some], score[some, -1])


def nearest_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
    every: int = 50, top: int = TOP, factor: float = 1.0, shard: int = SHARD, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, id_col, score``: for each row whose id is divisible by ``every`` its ``top`` nearest other rows by cosine.

    Equal vectors are one point that carries its smallest ids, one more than are wanted. Points are dealt to shards by their hash; a shard's
    vantage-point tree is written once. Queries walk through every tree in blocks. On unit vectors the distance is a metric that falls
    with the cosine, so a subtree is left out if ``factor`` times its least possible distance exceeds the distance of the worst
    neighbour wanted so far: with 1.0 nothing is lost, above it a lost neighbour is farther than that distance divided by ``factor``.
    A bounded sample gives every query its first bound. Scores are cosines of the vectors as given, in double precision.

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, neither ask nor answer; vectors of other lengths are no
    candidates. Equal scores are ordered by id, null ids last. Repeated rows are candidates each, and each asks.
    """
    spark = batched(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    # the smallest ids of equal vectors: the limit is applied before rows move
    order = [F.col("id").isNull(), F.col("id")]
    few = rows.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy(*order))).filter(F.col("turn") <= top + 1)
    points = cut_lineage(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).cast("int").alias("n")))
    asked = cut_lineage(rows.filter(F.col("id") % every == 0).withColumn("place", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(points.count() / shard))
    blocks = max(1, math.ceil(asked.count() / queries))
    sizes = [r[0] for r in points.groupBy(F.size("v")).count().orderBy(F.desc("count"), F.size("v")).limit(1).collect()]
    common = sizes[0] if sizes else 0
    sample = [r[0] for r in points.filter(F.size("v") == common).select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
    seeds = scaled(np.array(sample)) if sample else np.zeros((0, common))
    seed_lengths = lengths(seeds)

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        held = scaled(np.stack(group["v"].to_numpy()))
        order, nodes, radii = grow(held / lengths(held)[:, None])
        nodes[:, 2] = np.where(nodes[:, 2] >= 0, np.argsort(order)[nodes[:, 2]], -1)
        ids = [[int(i) for i in x] for x in group["ids"].to_numpy()[order]]
        n = group["n"].to_numpy()[order]
        flat = np.array([i for x, m in zip(ids, n) for i in x + [0] * (m - len(x))], np.int64)
        none = np.array([k >= len(x) for x, m in zip(ids, n) for k in range(m)], bool)
        starts = np.concatenate(([0], np.cumsum(n)))
        blobs = (np.stack(group["v"].to_numpy())[order], nodes, radii, flat, none, starts.astype(np.int64))
        return pd.DataFrame([(group["size"].iloc[0], group["shard"].iloc[0], *(x.tobytes() for x in blobs))], columns=[c.split(" ")[0] for c in TREE.split(", ")])

    placed = points.select("v", "ids", "n", F.size("v").alias("size"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    trees = cut_lineage(placed.groupBy("size", "shard").applyInPandas(plant, TREE))
    block = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block")
    asking = asked.groupBy(F.size("v").alias("size"), block).agg(F.collect_list(F.struct("place", "id", "v")).alias("asked"))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def first_bounds(given: np.ndarray) -> np.ndarray:
        if given.shape[1] != common or len(seeds) <= top:
            return np.full(len(given), -1.0)
        likeness = (given / lengths(given)[:, None]) @ (seeds / seed_lengths[:, None]).T
        return np.partition(likeness, len(seeds) - top - 1, axis=1)[:, len(seeds) - top - 1] - SLACK * SLACK

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                originals = np.frombuffer(row.vectors).reshape(-1, row.size)
                ids, none, starts = (np.frombuffer(x, k) for x, k in ((row.ids, np.int64), (row.none, bool), (row.starts, np.int64)))
                least = np.argsort(np.lexsort((ids[starts[:-1]], none[starts[:-1]])))
                tree = Search(scaled(originals), np.frombuffer(row.nodes, np.int64).reshape(-1, 5), np.frombuffer(row.radii).reshape(-1, 4), least)
                asked_ = sorted(row.asked, key=lambda q: q["place"])
                own = np.array([q["v"] for q in asked_])
                given = scaled(own)
                score, place = tree.find(given, first_bounds(given), top + 1, factor)
                out = []
                for q, values, points_, vector in zip(asked_, score, place, own, strict=True):
                    some = []
                    for value, at in zip(values, points_, strict=True):
                        if at < 0:
                            break
                        mine = [(bool(none[k]), int(ids[k])) for k in range(starts[at], starts[at + 1])]
                        if (False, q["id"]) in mine and np.array_equal(originals[at], vector):
                            mine.remove((False, q["id"]))
                        some += [(-value, *x) for x in mine]
                    out += [(q["place"], q["id"], -v, x, i) for v, x, i in sorted(some)[:top]]
                yield pd.DataFrame(out, columns=["place", "query", "score", "none", "id"])

    found = trees.join(asking, ["size", "shard"]).mapInPandas(walk, FOUND)
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "none", "id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return found.select(F.col("query").cast(kind).alias("query_id"), "rank", F.when(~F.col("none"), F.col("id")).cast(kind).alias(id_col), "score")
