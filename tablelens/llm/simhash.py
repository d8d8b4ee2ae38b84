"""SimHash near-duplicates: fingerprints meet on equal blocks, then by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched, packed, parts
from tablelens.llm.components import components
from tablelens.session import cut_lineage

BITS = 64
DISTANCE = 4
SHINGLE = 4
#: 64 bits in blocks of these widths; a pair that differs in 4 bits leaves at least 3 of 7 blocks untouched.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
#: A block key with more fingerprints is dealt to pairs of cells of about this size.
CELL = 8_192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text; null and texts without words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        set_bits += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, mark, fp``: the 64 bits as a signed long, one row per input row; ``mark`` tells texts of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = np.array([fingerprint(t, shingle) for t in rows["_text"]], dtype=np.uint64)
            yield pd.DataFrame({"_id": rows["_id"], "mark": rows["_mark"], "fp": fps.view(np.int64)})

    batched(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_mark(F.col(text_col)).alias("_mark"))
    return rows.mapInPandas(run, f"_id {kind}, mark long, fp long").withColumnRenamed("_id", id_col)


def block_keys(fp, widths: tuple[int, ...], distance: int):
    """For every choice of blocks that ``distance`` changed bits must leave equal: (choice, the bits of those blocks)."""
    masks, at = [], 0
    for width in widths:
        masks.append(((1 << width) - 1) << at)
        at += width
    keys = []
    for n, chosen in enumerate(combinations(range(len(widths)), len(widths) - distance)):
        mask = sum(masks[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def spanning_links(fps: np.ndarray, sides: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly what Hamming distance connects among these fingerprints: fewer links than fingerprints.

    Each fingerprint is compared with those not reached yet, so a dense group costs little more than one pass.
    """
    left = np.ones(len(fps), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return out
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= distance]
            left[near] = False
            out.extend((int(fps[i]), int(fps[j])) for j in near)
            front.extend(near.tolist())
    return out


def close_links(prints: DataFrame, distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS, cell: int = CELL) -> DataFrame:
    """``a, b``: enough links to connect distinct fingerprints (``fp``) within ``distance`` bits, all of them verified.

    Fingerprints meet on every choice of ``len(widths) - distance`` equal blocks. A key with more than ``cell``
    fingerprints is dealt to cells, and every pair of its cells meets as a key of its own: no task takes
    more than about two cells of it, and no close pair is missed. Within a key only spanning links leave a task.
    """
    if sum(widths) != BITS or len(widths) <= distance:
        raise ValueError("widths must add up to 64 and be more than distance")
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), widths, distance)).alias("key")).select("fp", "key.choice", "key.bits")
    counts = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = keyed.join(counts, ["choice", "bits"])
    cells = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("fp"), cells).cast("int")
    shared = shared.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    dealt = shared.select("choice", "bits", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")
    order = ["choice", "bits", "x", "y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[order].to_numpy(np.int64)
            fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
            new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            edges = np.concatenate(([0], new, [len(rows)]))
            sizes = np.diff(edges)
            a, b = [], []
            pairs = edges[:-1][sizes == 2]
            near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance]
            a.append(fps[near])
            b.append(fps[near + 1])
            for at, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
                if found := spanning_links(fps[at : at + size], None, distance):
                    some = np.array(found, dtype=np.uint64)
                    a.append(some[:, 0])
                    b.append(some[:, 1])
            return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        held = None  # rows of a key may go on in the next batch
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows[order] == rows[order].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = rows.iloc[cut:]
            if cut:
                yield links(rows.iloc[:cut])
        if held is not None and len(held):
            yield links(held)

    return dealt.repartition(parts(prints.sparkSession), *order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    shingle: int = SHINGLE, distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS, cell: int = CELL,
) -> DataFrame:
    """One row per input row: ``id_col, mark, fp, component_id`` (the smallest id reachable over links of ``distance`` bits or fewer).

    Documents with one fingerprint are one node, so copies cost nothing. Null, empty and blank texts have
    fingerprint 0 and link like any other. Null ids take part and are never the smallest unless a component
    has no other. Repeated rows get the same answer. An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("_least")))
    joined = components(close_links(nodes.select("fp"), distance, widths, cell))
    placed = nodes.join(joined, F.col("fp") == F.col("node"), "left").withColumn("_root", F.coalesce("component", "fp"))
    least = placed.groupBy(F.col("_root").alias("_group")).agg(F.min("_least").alias("component_id"))
    placed = placed.join(least, F.col("_root") == F.col("_group")).select(F.col("fp").alias("_node"), "component_id")
    return prints.join(placed, F.col("fp") == F.col("_node")).select(id_col, "mark", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns. Rows with a null id stay where no id is known."""
    known = near_duplicates(docs, id_col, text_col, **options)
    stay = known.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stay"), F.col("mark").alias("_mark")).distinct()
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), text_mark(F.col(text_col)).alias("_own"))
    return rows.join(stay.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_own") == F.col("_mark")), "left_semi").select("_row.*")
