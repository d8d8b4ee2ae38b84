"""Substring deduplication: Rabin-Karp hashes of all word windows, and maximal intervals to remove."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched, parts

WINDOW = 13
GROUP_DOCS = 512
MOST_GROUPS = 65_536
#: Odd multipliers of the two rolling hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; bytes split on exactly those six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(base)
        out += words[k : k + n]
    return out


class Windows:
    """All windows of one group of documents, and its distinct windows in a reproducible order.

    Documents come in ascending id. ``run`` numbers each window's distinct sequence in the order of
    (bucket, hash); ``first`` says whether the window's document has the smallest id of the group with it.
    """

    def __init__(self, ids: np.ndarray, words: list[list[bytes]], width: int, buckets: int):
        digest = xxhash.xxh3_64_intdigest
        lengths = np.array([len(w) for w in words], np.int64)
        hashes = np.empty(int(lengths.sum()), np.uint64)
        at = 0
        for w in words:
            hashes[at : at + len(w)] = np.fromiter(map(digest, w), np.uint64, len(w))
            at += len(w)
        doc = np.repeat(np.arange(len(words)), lengths)
        h = rolling(hashes, width, BASES[0])
        n = len(h)
        self.at = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, np.int64)
        h = h[self.at]
        bucket = ((rolling(hashes, width, BASES[1])[self.at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        sh, sb = h[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sb[1:] != sb[:-1])
        starts = np.flatnonzero(new)
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.cumsum(new) - 1
        self.hashes, self.buckets = sh[starts], sb[starts]
        owner = ids[doc[self.at]]
        self.first = owner == owner[order[starts]][self.run] if len(order) else np.zeros(0, bool)
        self.lengths, self.total, self.width = lengths, int(lengths.sum()), width

    def per_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        edges = np.flatnonzero(np.diff(self.buckets, prepend=-1, append=-1)) if len(self.buckets) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(self.buckets[a]), self.hashes[a:b]

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Which words to remove, given which distinct windows start in an earlier group."""
        hit = self.at[~self.first | earlier[self.run]]
        step = np.zeros(self.total + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + self.width, -1)
        return np.cumsum(step[:-1]) > 0


def _sorted_group(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[list[bytes]]]:
    """A group's documents in ascending id, ties by text; null ids (a group has no others then) count as one id."""
    rows = rows.assign(_text=rows["_text"].fillna("")).sort_values(["_id", "_text"], kind="stable").reset_index(drop=True)
    ids = rows["_id"].fillna(0).to_numpy(np.int64)
    return rows, ids, [split_words(t) for t in rows["_text"]]


def id_groups(docs: DataFrame, id_col: str, group_docs: int) -> tuple[Column, int]:
    """A column that numbers ranges of ids of about ``group_docs`` rows in ascending order, and where null ids begin.

    Ranges end at approximate percentiles: at most ``MOST_GROUPS`` numbers come to the driver.
    """
    wanted = max(1, min(MOST_GROUPS, -(-docs.count() // group_docs)))
    marks = [i / wanted for i in range(1, wanted)]
    bounds = np.array([], np.int64)
    if marks:
        found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), marks, max(10_000, 20 * wanted))).first()[0]
        bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="left")
        return pd.Series(out)

    beyond = len(bounds) + 1
    spread = (F.lit(beyond) + F.pmod(F.xxhash64("_text"), F.lit(wanted))).cast("int")
    return F.when(F.col("_id").isNull(), spread).otherwise(place(F.coalesce(F.col("_id"), F.lit(0)))), beyond


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, removed, kept_text``.

    A word goes if a window of ``window`` consecutive words over it has a word sequence that also starts in a
    document with a smaller id. ``removed`` lists the maximal intervals (first word, word behind the last);
    ``kept_text`` holds the other words joined by one space.

    Documents are grouped by ranges of ids. A group settles its own repeats and sends each distinct window
    once, eight bytes without id or place, to the window's bucket, so a passage in a third of all documents
    arrives once per group. Buckets count windows over the groups; as groups are ranges of ids, a window is a
    repeat in all groups but its first. One bit per distinct window goes back. The identity of a window is 64
    bits plus its bucket number from a second hash; of N windows about N^2 / 2^65 / buckets are taken for
    another one: 0.003 at 10^10 windows and 800 buckets.

    Null and blank texts have no words. A null id is larger than all ids and as large as another null.
    Rows that repeat an id are not smaller than each other. Shorter texts have no window and lose nothing.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    place, beyond = id_groups(docs, id_col, group_docs)
    rows = rows.withColumn("_g", place)
    n_parts = parts(docs.sparkSession)
    buckets = 4 * n_parts

    def send(group: pd.DataFrame) -> pd.DataFrame:
        _, ids, words = _sorted_group(group)
        g = int(group["_g"].iloc[0])
        found = [(b, g, h.tobytes()) for b, h in Windows(ids, words, window, buckets).per_bucket()]
        return pd.DataFrame(found, columns=["bucket", "g", "data"])

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(d) // 8 for d in bucket["data"]])
        rank = np.repeat(np.minimum(bucket["g"].to_numpy(), beyond), sizes)
        h = np.frombuffer(b"".join(bucket["data"]), np.uint64)
        order = np.lexsort((rank, h))
        sh, sr = h[order], rank[order]
        new = np.ones(len(h), bool)
        new[1:] = sh[1:] != sh[:-1]
        earlier = np.empty(len(h), bool)
        earlier[order] = sr > sr[np.flatnonzero(new)][np.cumsum(new) - 1]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"_g": bucket["g"], "bucket": bucket["bucket"], "bits": bits})

    def remove(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group, ids, words = _sorted_group(group)
        own = Windows(ids, words, window, buckets)
        earlier = np.zeros(len(own.hashes), bool)
        told = dict(zip(answers["bucket"], answers["bits"]))
        at = 0
        for b, h in own.per_bucket():
            earlier[at : at + len(h)] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(h))
            at += len(h)
        gone = own.covered(earlier)
        edges = np.concatenate(([0], np.cumsum(own.lengths)))
        out = []
        for i, w in enumerate(words):
            mask = gone[edges[i] : edges[i + 1]]
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            kept = w if not len(turns) else [x for x, m in zip(w, mask) if not m]
            out.append((len(w), int(mask.sum()), turns.tolist(), b" ".join(kept).decode("utf-8", "surrogatepass")))
        made = pd.DataFrame(out, columns=["n_words", "n_removed", "removed", "kept_text"])
        made.insert(0, "_id", group["_id"])
        return made

    sent = rows.groupBy("_g").applyInPandas(send, "bucket int, g int, data binary")
    told = sent.groupBy("bucket").applyInPandas(count, "_g int, bucket int, bits binary")
    out = rows.groupBy("_g").cogroup(told.groupBy("_g")).applyInPandas(remove, "_id long, n_words long, n_removed long, removed array<array<long>>, kept_text string")
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_words", "n_removed", F.transform("removed", lambda x: F.struct(x[0].alias("start"), x[1].alias("end"))).alias("removed"), "kept_text")
