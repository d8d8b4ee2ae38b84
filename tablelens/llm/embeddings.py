"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched
from tablelens.llm.components import components
from tablelens.session import cut_lineage

COSINE = 0.9
#: A vector is described by this many nearest pivots; candidates share at least so many of them.
NEAREST = 16
SHARED = 5
#: Four times the root of the number of vectors, within these bounds: the sample that the index is fitted on.
LEAST_PIVOTS, MOST_PIVOTS = 64, 16_384
#: Pivots are less alike than this, so that a crowd of near copies does not use them up.
APART = 0.7
#: An inverted list with more vectors is dealt to pairs of cells of about this size.
CELL = 2_048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Length one in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spread(sample: np.ndarray, wanted: int, least: int, size: int) -> np.ndarray:
    """Up to ``wanted`` unit vectors of the sample that are pairwise apart, in its order; fixed directions up to ``least``."""
    kept = np.zeros((wanted, size))
    n = 0
    for x in sample:
        if n < wanted and (not n or (kept[:n] @ x).max() < APART):
            kept[n] = x
            n += 1
    more = unit(np.random.default_rng(size).standard_normal((max(0, least - n), size)))
    return np.concatenate((kept[:n], more))


def nearest(units: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` nearest pivots, nearest first, ties by number."""
    likeness = units @ pivots.T
    n = min(n, len(pivots))
    part = np.sort(np.argpartition(-likeness, n - 1, axis=1)[:, :n], axis=1)
    order = np.argsort(-np.take_along_axis(likeness, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _flags(rows: np.ndarray, columns: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """A row of 0 and 1 per description over the pivots in ``columns``."""
    at = np.searchsorted(columns, rows)
    hit = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == rows) if len(columns) else np.zeros(rows.shape, bool)
    if keep is not None:
        hit &= keep
    out = np.zeros((len(rows), len(columns)), np.float32)
    i, j = np.nonzero(hit)
    out[i, at[i, j]] = 1.0
    return out


def _connect(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a symmetric boolean matrix."""
    left = adjacent.any(axis=1)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        front = [int(start)]
        while front:
            i = front.pop()
            near = np.flatnonzero(adjacent[i] & left)
            left[near] = False
            out.extend((i, int(j)) for j in near)
            front.extend(near.tolist())
    return out


def close_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
    cosine: float = COSINE, near: int = NEAREST, shared: int = SHARED, cell: int = CELL, pivots: int | None = None,
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Equal vectors are one node with a number of copies. The pivots come from a bounded sample of the nodes of the
    most common length, without those too much alike; other lengths get fixed directions. Every node is described by its
    ``near`` nearest pivots in order. Nodes are candidates if they share ``shared`` pivots. As two such
    descriptions must meet within the ``near - shared + 1`` rarest pivots of each, only those lead to inverted
    lists, and a pair is judged in the list of its rarest common one. A list above ``cell`` nodes is dealt to cells
    that meet pairwise, each pair of cells as a task of its own. Only candidates are verified, by their cosine in
    double precision; a task returns the number of links of its nodes and spanning links, never all pairs.

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing; so do
    vectors of different lengths. ``n_links`` counts other rows, copies included. ``component_id`` is the smallest
    id reachable; null ids come last. Repeated rows are vectors of their own and link. ``kept``: the own id is that id.
    """
    batched(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce((F.size("_v") > 0) & finite & F.exists("_v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_v", F.when(good, F.col("_v")))
    nodes = rows.filter("_v is not null").groupBy("_v").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    nodes = cut_lineage(nodes.withColumn("_node", F.monotonically_increasing_id()))  # numbers hold once they are written
    total = nodes.count()
    wanted = pivots or int(np.clip(4 * np.sqrt(total), LEAST_PIVOTS, MOST_PIVOTS))
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("_v")).count().orderBy(F.desc("count")).limit(1).collect()}
    common = next(iter(sizes), 0)
    sample = [r[0] for r in nodes.filter(F.size("_v") == common).select("_v").orderBy(F.xxhash64("_v")).limit(2 * wanted).collect()]
    own = spread(unit(np.array(sample)), wanted, LEAST_PIVOTS, common) if sample else np.zeros((0, 0))

    def points(size: int) -> np.ndarray:
        return own if size == common else spread(np.zeros((0, size)), LEAST_PIVOTS, LEAST_PIVOTS, size)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for size, some in part.groupby(part["_v"].map(len)):
                places = nearest(unit(np.stack(some["_v"].to_numpy())), points(size), near)
                yield pd.DataFrame({"_node": some["_node"], "_copies": some["_copies"], "_v": some["_v"], "size": size, "near": list(places.astype(np.int32))})

    index = cut_lineage(nodes.mapInPandas(describe, "_node long, _copies long, _v array<double>, size int, near array<int>"))
    # one number per pivot: how common it is
    common_pivots = index.filter(F.col("size") == common).select(F.explode("near").alias("p")).groupBy("p").count().collect()
    rarity = np.zeros(max(wanted, LEAST_PIVOTS), np.int64)
    for p, n in common_pivots:
        rarity[p] = n
    place = np.empty(len(rarity), np.int64)
    place[np.lexsort((np.arange(len(rarity)), rarity))] = np.arange(len(rarity))

    def listed(near_pivots: np.ndarray) -> np.ndarray:
        """Which places of each description are among its rarest pivots."""
        rank = np.argsort(np.argsort(place[near_pivots], axis=1), axis=1)
        return rank < max(1, near_pivots.shape[1] - shared + 1)

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for size, some in part.groupby("size"):
                at = np.stack(some["near"].to_numpy())
                i, j = np.nonzero(listed(at))
                yield pd.DataFrame({"_node": some["_node"].to_numpy()[i], "size": size, "pivot": at[i, j]})

    placed = index.select("_node", "size", "near").mapInPandas(lists, "_node long, size int, pivot int")
    lengths = placed.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cells = F.ceil(F.col("n") / cell).cast("int")
    dealt = placed.join(lengths, ["size", "pivot"]).withColumn("mine", F.pmod(F.xxhash64("_node"), cells).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    dealt = dealt.select("_node", "size", "pivot", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    dealt = dealt.join(index.drop("size"), "_node")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        pivot, x, y = (int(group[c].iloc[0]) for c in ("pivot", "x", "y"))
        group = group.sort_values("_node")
        one = group[group["mine"] == x]
        two = one if x == y else group[group["mine"] == y]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        parts = []
        for side in (one, two):
            at = np.stack(side["near"].to_numpy())
            parts.append((at, listed(at), unit(np.stack(side["_v"].to_numpy())), side["_node"].to_numpy(), side["_copies"].to_numpy()))
        (at1, in1, u1, id1, n1), (at2, in2, u2, id2, n2) = parts
        both = np.intersect1d(at1, at2)
        candidates = _flags(at1, both) @ _flags(at2, both).T >= min(shared, at1.shape[1])
        rarer = both[place[both] < place[pivot]]  # a rarer common pivot judges the pair in its own list
        candidates &= _flags(at1, rarer, in1) @ _flags(at2, rarer, in2).T == 0
        if x == y:
            np.fill_diagonal(candidates, False)
        links = np.zeros(candidates.shape, bool)
        some = np.flatnonzero(candidates.any(axis=1))
        links[some] = candidates[some] & (u1[some] @ u2.T >= cosine)
        if x == y:
            nodes_, counts, joined = id1, links @ n1, _connect(links)
        else:
            nodes_, counts = np.concatenate((id1, id2)), np.concatenate((links @ n2, n1 @ links))
            square = np.zeros((len(nodes_),) * 2, bool)
            square[: len(id1), len(id1) :], square[len(id1) :, : len(id1)] = links, links.T
            joined = _connect(square)
        has = counts > 0
        a = np.concatenate((nodes_[has], nodes_[[i for i, _ in joined]] if joined else nodes_[:0]))
        b = pd.array([None] * int(has.sum()) + [int(nodes_[j]) for _, j in joined], dtype="Int64")
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate((counts[has], np.zeros(len(joined), np.int64)))})

    judged = cut_lineage(dealt.groupBy("size", "pivot", "x", "y").applyInPandas(judge, "a long, b long, links long"))
    links = judged.groupBy(F.col("a").alias("_lnode")).agg(F.sum("links").alias("links"))
    joined = components(judged.filter("b is not null").select("a", "b")).select(F.col("node").alias("_cnode"), "component")
    full = nodes.join(links, F.col("_node") == F.col("_lnode"), "left").join(joined, F.col("_node") == F.col("_cnode"), "left")
    full = full.select("_v", "_least", (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("component", "_node").alias("_root"))
    roots = full.groupBy(F.col("_root").alias("_group")).agg(F.min("_least").alias("component_id"))
    full = full.join(roots, F.col("_root") == F.col("_group")).select(F.col("_v").alias("_nv"), "n_links", "component_id")
    out = rows.filter("_v is not null").join(full, F.col("_v") == F.col("_nv")).select("_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("_v is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
