"""Near-duplicates by shingle similarity: long SimHash fingerprints connect most, prefixes of ordered shingles find the rest, and shingles decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched, packed, parts
from tablelens.llm.components import components
from tablelens.llm.simhash import text_mark
from tablelens.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint. Two texts of similarity s differ in about acos(2 s / (1 + s)) / pi of them.
BITS = 512
#: So many of the pairs at the least similarity share a block; more similar ones do so more often.
CAUGHT = 0.94
#: Bits of a block beyond those that number all texts: of chance meetings a text has about 2^-SPARE for every block.
SPARE = 3
#: Standard deviations of the distance that a pair at the least similarity is allowed.
ALLOWED = 3
#: Steps of distance in which links are sought, so that closer texts are linked first.
LEVELS = 4
#: Rounds that judge only the closest link of each component; the one after them judges all that is left.
ROUNDS = 1
#: A block with more texts is dealt to pairs of cells of about this size.
CELL = 8_192
#: Bits of a parity map; two maps differ in no more places than their sets have elements that the other lacks.
PARITY = 1_024
#: Frequent shingles are counted in chunks of about this many.
CHUNK = 2_000_000
#: A shingle that a chunk has so often is counted, and one counted so often in all comes late in the order; the order holds without.
OFTEN = 8, 64
#: At most so many shingles, the most frequent ones, are placed by their count; all others are placed by their hash.
RANKED = 131_072
#: Groups up to this size are compared together, larger ones text by text.
SMALL = 64
#: Words of a map of marks with 64 bits each, which tells before a shuffle most texts that no pair names.
WORDS = 262_144
#: Slack for sums of doubles; a bound is never too strict.
EPS = 1e-6


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64))


def _mixed(values: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = values + np.uint64((turn * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bits, 0 and 1, that are set in more than half of the shingles' hashes."""
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 8_192):
        some = hashes[at : at + 8_192]
        wide = np.stack([_mixed(some, turn) for turn in range(1, bits // 64 + 1)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * counts > len(hashes)).astype(np.uint8)


def plan_blocks(texts: int, similarity: float, bits: int = BITS) -> tuple[np.ndarray, int]:
    """``(places of the bits of each block, allowed distance)``.

    The bits are put in several seeded orders, and each order is cut into blocks of equal width, as many as are needed for ``CAUGHT``.
    Within one order the pigeonhole holds: fewer differing bits than blocks leave a block equal.
    """
    away = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = int(min(48, max(8, math.ceil(math.log2(max(texts, 2))) + SPARE)))
    blocks = math.ceil(math.log(1 - CAUGHT) / math.log1p(-((1 - away) ** width)))
    each, pick = bits // width, np.random.default_rng(bits)
    orders = [pick.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-blocks // each))]
    return np.concatenate(orders)[:blocks], math.floor(bits * away + ALLOWED * math.sqrt(bits * away * (1 - away)))


def levelled_links(fps: np.ndarray, most: int, levels: int = LEVELS) -> list[tuple[int, int, int]]:
    """Links ``(i, j, distance)`` that connect, at each of several distances up to ``most``, exactly what lies within that distance.

    Each text is compared with those not reached yet, so a dense group costs little more than one pass. Links within what closer ones connect are left out: there are fewer links than texts.
    """
    out = []
    above = list(range(len(fps)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for level in range(1, levels + 1):
        within, left = most * level // levels, np.ones(len(fps), bool)
        reached = 0
        for start in range(len(fps)):
            if not left[start]:
                continue
            left[start] = False
            reached += 1
            front = [start]
            while front and reached < len(fps):
                i = front.pop()
                rest = np.flatnonzero(left)
                distance = np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1, dtype=np.int64)
                near = distance <= within
                left[rest[near]] = False
                reached += int(near.sum())
                for j, d in zip(rest[near].tolist(), distance[near].tolist()):
                    if (x := top(i)) != (y := top(j)):
                        above[y] = x
                        out.append((i, j, d))
                front.extend(rest[near].tolist())
    return out


def _groups(batches: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of sorted rows, several at a time, and where they begin; a group may go on in the next batch."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        keys = rows[order].to_numpy(np.int64)
        begins = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1))
        held = rows.iloc[begins[-1] :]
        if begins[-1]:
            yield rows.iloc[: begins[-1]], begins
    if held is not None and len(held):
        keys = held[order].to_numpy(np.int64)
        yield held, np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(held)]))


def candidate_links(prints: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``a, b, distance``: enough links to connect, distance by distance, the texts (``node``, ``fp``) that share a block."""
    spark = prints.sparkSession
    places, most = plan_blocks(prints.count(), similarity)
    weights = np.uint64(1) << np.arange(places.shape[1], dtype=np.uint64)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(part["fp"]), np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            for number, at in enumerate(places):
                own = (bits[:, at] * weights).sum(axis=1, dtype=np.uint64)
                yield pd.DataFrame({"node": part["node"], "block": (own + np.uint64(number << len(at))).view(np.int64)})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in _groups(batches, ["block"]):
            sizes = np.diff(begins)
            if (sizes > 1).any():
                yield rows.assign(n=np.repeat(sizes, sizes).astype(np.int32))[np.repeat(sizes > 1, sizes)]

    met = prints.mapInPandas(keyed, "node long, block long").repartition(parts(spark), "block").sortWithinPartitions("block")
    met = met.mapInPandas(shared, "node long, block long, n int")
    cells = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("node"), cells).cast("int")
    dealt = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    dealt = dealt.select(F.col("node").alias("_node"), "block", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    dealt = dealt.join(prints, F.col("_node") == F.col("node")).drop("_node")
    order = ["block", "x", "y"]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in _groups(batches, order):
            fps = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(len(rows), -1)
            nodes = rows["node"].to_numpy()
            sizes = np.diff(begins)
            two = begins[:-1][sizes == 2]
            distance = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1, dtype=np.int64)
            near = distance <= most
            found = [np.stack((nodes[two[near]], nodes[two[near] + 1], distance[near]), axis=1)]
            for at, size in zip(begins[:-1][sizes > 2], sizes[sizes > 2]):
                by_node = at + np.argsort(nodes[at : at + size], kind="stable")
                if some := levelled_links(fps[by_node], most):
                    i, j, d = np.array(some).T
                    found.append(np.stack((nodes[by_node[i]], nodes[by_node[j]], d), axis=1))
            whole = np.concatenate(found)
            yield pd.DataFrame({"a": whole[:, :2].min(axis=1), "b": whole[:, :2].max(axis=1), "distance": whole[:, 2]})

    found = dealt.repartition(parts(spark), *order).sortWithinPartitions(*order).mapInPandas(links, "a long, b long, distance long")
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def frequent(hashes: list[np.ndarray]) -> bytes:
    """Hashes that these texts have often, and how often, as two rows of 64-bit numbers."""
    keys, counts = np.unique(np.concatenate(hashes), return_counts=True)
    often = counts >= OFTEN[0]
    return np.stack((keys[often].view(np.int64), counts[often])).tobytes()


def ranked(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and the place of each in the order, by count."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for pack in part["often"]:
                keys, counts = np.frombuffer(pack, np.int64).reshape(2, -1)
                yield pd.DataFrame({"key": keys, "n": counts})

    total = counted.mapInPandas(unpack, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN[1])
    top = np.array(total.orderBy(F.desc("n"), "key").limit(RANKED).collect(), np.int64).reshape(-1, 2)
    keys = top[::-1, 0].copy().view(np.uint64)  # the least frequent first
    by_key = np.argsort(keys)
    return keys[by_key], (by_key + 1).astype(np.int64)


def prefix(hashes: np.ndarray, similarity: float, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of the hashes in an order all texts share; of two sets that are similar enough, these share one.

    An overlap of a share ``similarity`` of a set leaves out fewer elements than its prefix has. Frequent shingles come last, so few texts meet on them.
    """
    keys, places = late
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hashes = hashes[np.argsort(np.where(keys[at] == hashes, places[at], 0), kind="stable")]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - EPS) + 1]


def parity(hashes: np.ndarray, bits: int = PARITY) -> bytes:
    """For each of ``bits`` places whether an odd number of the hashes falls there."""
    odd = np.bincount((_mixed(hashes, 9) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _possible(rows: dict[str, np.ndarray], i: np.ndarray | int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows can be similar enough and are not connected yet; no similar pair fails at the first shingle that both prefixes have."""
    n, at, mine, cross = rows["n"], rows["at"], rows["mine"], rows["cross"]
    both = n[i] + n[j]
    ok = (rows["label"][i] != rows["label"][j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - EPS)
    ok &= np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * both - EPS
    ok &= ~cross[i] | (mine[i] != mine[j])
    left = np.flatnonzero(ok)
    one = i if np.ndim(i) == 0 else i[left]
    differ = np.bitwise_count(rows["bits"][one] ^ rows["bits"][j[left]]).sum(axis=1, dtype=np.int64)
    ok[left] = differ <= (1 - similarity) / (1 + similarity) * both[left] + EPS
    return ok


def possible_pairs(sketches: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``a, b, la, lb``: every pair of texts of different ``label`` that may be similar enough.

    ``sketches``: ``node, label, n, bits, keys``. Texts meet on each shingle of their prefixes, so no pair at ``similarity`` or more
    between two labels is missing. Groups of one label are dropped before anything is compared; a group with more than ``cell`` texts is dealt to pairs of cells.
    """
    spark = sketches.sparkSession

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            keys = [np.frombuffer(k, np.int64) for k in part["keys"]]
            if not keys:
                continue
            sizes = np.array([len(k) for k in keys])
            at = np.concatenate([np.arange(size) for size in sizes])
            # the place and the size in one number: shorter rows
            yield pd.DataFrame({"key": np.concatenate(keys), "node": np.repeat(part["node"].to_numpy(), sizes), "label": np.repeat(part["label"].to_numpy(), sizes), "sized": np.repeat(part["n"].to_numpy(np.int64), sizes) << 32 | at})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in _groups(batches, ["key"]):
            sizes, label = np.diff(begins), rows["label"].to_numpy()
            mixed = np.minimum.reduceat(label, begins[:-1]) != np.maximum.reduceat(label, begins[:-1])
            if mixed.any():
                yield rows.assign(m=np.repeat(sizes, sizes).astype(np.int32))[np.repeat(mixed, sizes)]

    met = sketches.select("node", "label", "n", "keys").mapInPandas(keyed, "key long, node long, label long, sized long")
    met = met.repartition(parts(spark), "key").sortWithinPartitions("key").mapInPandas(shared, "key long, node long, label long, sized long, m int")
    cells = F.ceil(F.col("m") / cell).cast("int")
    dealt = met.withColumn("mine", F.pmod(F.xxhash64("node"), cells).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    dealt = dealt.select(F.col("node").alias("_node"), "label", "sized", "mine", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    dealt = dealt.join(sketches.select("node", "bits"), F.col("_node") == F.col("node")).drop("_node")
    order = ["key", "x", "y"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, begins in _groups(batches, order):
            rows = {c: part[c].to_numpy() for c in ("node", "label", "mine")}
            sized = part["sized"].to_numpy()
            rows |= {"n": sized >> 32, "at": sized & 0xFFFFFFFF, "cross": (part["x"] != part["y"]).to_numpy()}
            rows["bits"] = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), -1)

            def made(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
                swap = rows["node"][i] > rows["node"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                return pd.DataFrame({"a": rows["node"][i], "b": rows["node"][j], "la": rows["label"][i], "lb": rows["label"][j]})

            sizes = np.diff(begins)
            small = sizes <= SMALL
            ends = np.repeat(np.where(small, begins[1:], begins[:-1]), sizes)  # a large group has no pairs here
            for step in range(1, int(sizes[small].max(initial=0))):
                i = np.flatnonzero(np.arange(len(part)) + step < ends)
                i = i[_possible(rows, i, i + step, similarity)]
                if len(i):
                    yield made(i, i + step)
            for start, end in zip(begins[:-1][~small].tolist(), begins[1:][~small].tolist()):
                found, many = [], 0
                for i in range(start, end - 1):
                    j = np.arange(i + 1, end)
                    j = j[_possible(rows, i, j, similarity)]
                    if len(j):
                        found.append(np.stack((np.full(len(j), i), j)))
                        many += len(j)
                    if many > 100_000 or (many and i == end - 2):
                        yield made(*np.concatenate(found, axis=1))
                        found, many = [], 0

    found = dealt.repartition(parts(spark), *order).sortWithinPartitions(*order).mapInPandas(pairs, "a long, b long, la long, lb long")
    return found.distinct()


def wide_parity(hashes: np.ndarray) -> bytes:
    """A parity map with a place or more for each hash, for sets too large for ``PARITY`` places; none for others."""
    return parity(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > PARITY else b""


def wide_apart(one: bytes, two: bytes) -> int:
    """The places in which two wide maps differ, the larger one folded to the places of the smaller; 0 where one is missing."""
    if not one or not two:
        return 0
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def closer(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of the ``pairs`` those whose wide maps allow the similarity; all that are similar enough are among them."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            apart = np.fromiter(map(wide_apart, part["wa"], part["wb"]), np.int64, len(part))
            yield part.loc[apart <= (1 - similarity) / (1 + similarity) * part["n"].to_numpy() + EPS, ["a", "b", "la", "lb"]]

    of_a, of_b = (sketches.select(F.col("node").alias(f"n{x}"), F.col("n").alias(f"s{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")
    joined = pairs.join(of_a, F.col("a") == F.col("na")).join(of_b, F.col("b") == F.col("nb"))
    return joined.select("a", "b", "la", "lb", "wa", "wb", (F.col("sa") + F.col("sb")).cast("long").alias("n")).mapInPandas(judge, "a long, b long, la long, lb long")


def marked_by(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose ``_mark`` may be a ``node`` of ``wanted``, none of these missing: a map of bounded size goes to all tasks, so other texts are not shuffled."""
    def place(mark: str) -> tuple[Column, Column]:
        return F.expr(f"{mark} & {WORDS - 1}"), F.expr(f"shiftleft(1L, cast(shiftright({mark}, 32) & 63 as int))")

    word, bit = place("node")
    known = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    word, bit = place("_mark")
    return rows.join(F.broadcast(known), word == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs ``a, b`` those whose shingles (``sets``: ``node, hashes``) have at least that Jaccard similarity."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            keep = []
            for one, two in zip(part["one"], part["two"], strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield part.loc[keep, ["a", "b"]]

    one, two = (sets.select(F.col("node").alias(f"{n}_node"), F.col("hashes").alias(n)) for n in ("one", "two"))
    joined = pairs.join(one, F.col("a") == F.col("one_node")).join(two, F.col("b") == F.col("two_node"))
    return joined.select("a", "b", "one", "two").mapInPandas(judge, "a long, b long")


def connected(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, component`` over the links that hold by their shingles.

    A first round judges the closest link of each text, as a smallest value with partial aggregation; links within the components that come of it
    are forgotten, and a last round judges all that is left. Links are fewer than texts in each block, so no round judges all pairs of a group.
    """
    links, done = cut_lineage(links.withColumns({"ca": F.col("a"), "cb": F.col("b")})), 0
    true = joined = None
    while links.limit(1).count():
        ends = links.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("distance", "a", "b").alias("link"))
        closest = ends.groupBy("c").agg(F.min("link").alias("link")).select("link.a", "link.b")
        chosen = cut_lineage(closest.distinct() if done < ROUNDS else links.select("a", "b"))
        done += 1
        held = similar(chosen, sets, similarity)
        true = cut_lineage(held if true is None else true.unionByName(held))
        joined = cut_lineage(components(true))
        rest = links.select("a", "b", "distance").join(chosen, ["a", "b"], "left_anti")
        of_a, of_b = (joined.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"k{x}")) for x in "ab")
        rest = rest.join(of_a, F.col("a") == F.col("na"), "left").join(of_b, F.col("b") == F.col("nb"), "left")
        rest = rest.select("a", "b", "distance", F.coalesce("ka", "a").alias("ca"), F.coalesce("kb", "b").alias("cb")).filter("ca <> cb")
        links = cut_lineage(rest)
    if joined is None:
        return sets.sparkSession.createDataFrame([], "node long, component long")
    return joined


def similar_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, shingle: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns.

    Groups are connected by pairs whose distinct shingles of ``shingle`` words (A-Z lower-cased) have a Jaccard similarity of ``similarity`` or more.
    Equal blocks of long fingerprints connect most of them: of the pairs at just that similarity about ``CAUGHT`` meet, the width and number of
    blocks follow from the number of texts. Then every pair between the groups found meets on prefixes of ordered shingles, which miss none.
    Shingles decide about each link, so no fingerprint makes documents alike, and none keeps them apart.

    Texts without words, null ones too, are like no other and all stay. Rows of equal id and text stay or go together; ids are compared with nulls
    last. Repeated texts under other ids are near-duplicates. Extra columns pass through; an empty table gives an empty result.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, many = [], 0
        for rows in batches:
            fps, often = [], [None] * len(rows)
            for row, text in enumerate(rows["_text"]):
                hashes = shingle_hashes(text, shingle)
                fps.append(np.packbits(long_fingerprint(hashes), bitorder="little").tobytes() if len(hashes) else None)
                seen.append(hashes)
                many += len(hashes)
                if many >= CHUNK:
                    often[row], seen, many = frequent(seen), [], 0
            yield pd.DataFrame({"_id": rows["_id"], "_mark": rows["_mark"], "fp": pd.Series(fps, dtype=object), "often": pd.Series(often, dtype=object)})
        if many:
            yield pd.DataFrame({"_id": [None], "_mark": [None], "fp": [None], "often": [frequent(seen)]}, dtype=object)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"node": rows["node"], "hashes": [shingle_hashes(text, shingle).tobytes() for text in rows["_text"]]})

    def texts(own: Column) -> DataFrame:
        return docs.select(F.col(id_col).alias("_id"), own.alias("_text"), text_mark(own).alias("_mark"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        linked = marked_by(wanted, texts(F.col(text_col).cast("string"))).join(wanted, F.col("_mark") == F.col("node")).dropDuplicates(["node"]).select("node", "_text")
        return cut_lineage(linked.mapInPandas(hashed, "node long, hashes binary"))

    described = cut_lineage(texts(F.col(text_col).cast("string")).mapInPandas(describe, f"_id {kind}, _mark long, fp binary, often binary").filter("fp is not null or often is not null"))
    late = ranked(described.select("often").filter("often is not null"))
    # texts of one mark are equal: a node
    marked = described.filter("fp is not null").groupBy(F.col("_mark").alias("node"))
    prints = cut_lineage(marked.agg(F.min("_id").alias("_least"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("_n")))
    links = cut_lineage(candidate_links(prints.select("node", "fp"), similarity, cell))
    joined = connected(links, sets_of(links), similarity)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for mark, text in zip(rows["_mark"], rows["_text"], strict=True):
                hashes = shingle_hashes(text, shingle)
                if len(hashes):
                    out.append((mark, len(hashes), parity(hashes), wide_parity(hashes), prefix(hashes, similarity, late).tobytes()))
            yield pd.DataFrame(out, columns=["node", "n", "bits", "wide", "keys"])

    # what the fingerprints did not connect meets on prefixes of ordered shingles
    sketches = texts(F.col(text_col).cast("string")).select("_mark", "_text").mapInPandas(sketch, "node long, n int, bits binary, wide binary, keys binary")
    sketches = sketches.groupBy("node").agg(F.first(F.struct("n", "bits", "wide", "keys")).alias("s")).select("node", "s.*")
    sketches = sketches.join(joined.withColumnRenamed("node", "_joined"), F.col("node") == F.col("_joined"), "left").drop("_joined")
    sketches = cut_lineage(sketches.withColumn("label", F.coalesce("component", "node")).drop("component"))
    possible = cut_lineage(closer(possible_pairs(sketches, similarity, cell), sketches, similarity))
    true = similar(possible.select("a", "b"), sets_of(possible), similarity).join(possible, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(cut_lineage(true)).select(F.col("node").alias("_label"), F.col("component").alias("_merged"))
    joined = sketches.select("node", "label").join(merged, F.col("label") == F.col("_label"), "left").select("node", F.coalesce("_merged", "label").alias("component"))
    placed = prints.select("node", "_least", "_n").join(joined.withColumnRenamed("node", "_joined"), F.col("node") == F.col("_joined"), "left").withColumn("_root", F.coalesce("component", "node"))
    # the first of a group is one document: the smallest id, and among rows of that id the smallest mark
    first = placed.groupBy("_root").agg(F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("node").alias("mark"))).alias("first"), F.count(F.lit(1)).alias("_many"), F.sum("_n").alias("_rows"))
    alone = first.filter("_rows = 1").select(F.col("_root").alias("_stay"))
    many = first.filter("_rows > 1").select(F.col("first.id").alias("_first"), F.col("first.mark").alias("_stay"))
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), text_mark(F.col(text_col).cast("string")).alias("_own"), F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]").alias("_some"))
    stay = alone.select(F.lit(None).cast(kind).alias("_first"), "_stay", F.lit(False).alias("_by_id")).unionByName(many.select("_first", "_stay", F.lit(True).alias("_by_id")))
    kept = rows.filter("_some").join(stay, (F.col("_own") == F.col("_stay")) & (~F.col("_by_id") | F.col("_id").eqNullSafe(F.col("_first"))), "left_semi")
    return kept.select("_row.*").unionByName(rows.filter("not coalesce(_some, false)").select("_row.*"))
