"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched, packed

#: Features are dealt to this many coordinates, which bounds the weights: 2^20 numbers at most.
BITS = 20
#: At most about this many labelled documents are learned from; a hash of the id picks them.
MOST_LABELLED = 20_000
#: Besides whole words, their first letters are features, so that inflected forms share what is learned.
STEMS = (4, 6)
#: The sample is learned from in so many orders and the weights are averaged.
ORDERS = 3
TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal constants: step size, its offset, L1 (how much evidence a weight needs) and L2."""

    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 2


def coordinates(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct coordinates of a text's words, stems, word pairs and pairs that skip one word. Coordinate 0 is the bias and never among them."""
    words = TOKEN.findall((text or "").lower())
    digest = xxhash.xxh3_64_intdigest

    def hashes(parts: list[str]) -> np.ndarray:
        return np.fromiter((digest(p.encode("utf-8", "surrogatepass")) for p in parts), np.uint64, len(parts))

    h = hashes(words)
    left = h * np.uint64(0x9E3779B97F4A7C15)
    kinds = [h, left[:-1] ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)), left[:-2] ^ (h[2:] * np.uint64(0x165667B19E3779F9))] if len(h) else [h]
    different = set(words)  # only the longer ones have a stem of their own
    kinds += [hashes(list({w[:n] + "*" for w in different if len(w) > n})) for n in STEMS]
    mixed = np.concatenate(kinds) * np.uint64(0xD6E8FEB86659FD93)
    found = (mixed >> np.uint64(64 - bits)).astype(np.int32)
    return np.unique(np.maximum(found, 1))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def learn(rows: list[np.ndarray], labels: np.ndarray, prior: float, rates: Rates = Rates(), bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and summed squared gradients per coordinate after going through the rows in order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * rates.l1) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)
        return np.where(np.abs(zi) <= rates.l1, 0.0, w)

    for _ in range(rates.passes):
        for x, y in zip(rows, labels):
            i = np.concatenate(([0], x))
            w = weights(i)
            g = float(sigmoid(prior + w.sum())) - y
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / rates.alpha * w
            n[i] = grown
    return weights(slice(None)), n


@dataclass(frozen=True)
class Model:
    """A prior and the weights that are not zero."""

    prior: float
    index: np.ndarray
    weight: np.ndarray
    bits: int = BITS

    def scorer(self):
        dense = np.zeros(1 << self.bits)
        dense[self.index] = self.weight
        base = self.prior + dense[0]
        return lambda text: float(sigmoid(base + dense[coordinates(text, self.bits)].sum()))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
    rates: Rates = Rates(), bits: int = BITS, most: int = MOST_LABELLED,
) -> Model:
    """Learn from labelled documents that are not held out.

    About ``most`` of them at most, picked by a hash of the id, so the picked labels may be broadcast. Tasks
    turn their texts into coordinates; FTRL takes one row after the other, so one task learns from the
    bounded sample, in ``ORDERS`` seeded orders, and returns the mean weights that L1 left, ``2^bits`` at most.
    Several labels of one document count as toxic if one is; null ids and labels are left out. Without any
    label the model is its prior, below one half.
    """
    batched(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    count, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = float(np.log((toxic + 0.5) / (count - toxic + 1.5)))
    if not count:
        return Model(prior, np.zeros(0, np.int64), np.zeros(0), bits)
    place = F.pmod(F.xxhash64("_id", F.lit("picked")), F.lit(1_000_000))
    picked = known.filter(place < int(np.ceil(1_000_000 * min(1.0, most / count))))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            order = [xxhash.xxh3_64_intdigest(str(i)) >> 1 for i in part["_id"]]
            yield pd.DataFrame({"place": order, "y": part["_y"], "x": [coordinates(t, bits).tobytes() for t in part["_text"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, ys = [], []
        for part in batches:
            sizes = part["x"].map(len).to_numpy() // 4
            xs += np.split(np.frombuffer(b"".join(part["x"]), np.int32), np.cumsum(sizes)[:-1])  # one block of memory per batch
            ys += part["y"].tolist()
        if xs:
            y = np.array(ys, np.float64)
            orders = [np.random.default_rng(k).permutation(len(xs)) for k in range(ORDERS)]
            # what one order happens to teach evens out over several
            w = sum(learn([xs[i] for i in o], y[o], prior, rates, bits)[0] for o in orders) / ORDERS
            at = np.flatnonzero(w)
            yield pd.DataFrame({"coordinate": at, "w": w[at]})

    sample = rows.mapInPandas(featured, "place long, y int, x binary").repartition(1).sortWithinPartitions("place", "x")
    found = sample.mapInPandas(run, "coordinate long, w double").toPandas()
    return Model(prior, found["coordinate"].to_numpy(np.int64), found["w"].to_numpy(np.float64), bits)


def score_with(model: Model, text: Column) -> Column:
    """The probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in batches:
            yield pd.Series([own(t) for t in texts], dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Only the text is scored, whole; null and empty texts get the score of a text without words. A null id is
    not held out. Repeated rows get the same score. Without labels every score is the prior.
    """
    batched(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, **options)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_with(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows whose score stays below ``threshold``, with all their columns."""
    batched(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(packed(docs), score_with(model, F.col(text_col)).alias("_score"))
    return rows.filter(F.col("_score") < threshold).select("_row.*")
