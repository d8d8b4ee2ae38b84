"""The trie of conversation prefixes, built as adaptive radix trees over ranges of sorted keys."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import batched, parts
from tablelens.llm.radix_tree import RadixTree, common
from tablelens.session import cut_lineage

#: Bytes of a turn's id: the first of the SHA-256 of its role and text. Among n different turns two agree with odds of n^2 / 2^129.
WIDTH = 16
#: Turns, at most about so many, whose keys one tree holds; a single longer conversation is one key.
RANGE = 200_000
#: Rows of the result that are handed over at a time.
HANDED = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
MADE = "range int, depth long, owner int, above int, conv long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def turn_id(role: Column, text: Column) -> Column:
    """Fixed-width, in hex; big-endian as bytes."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turns``: per conversation its turns ``(turn, id, points)`` in order, without their texts.

    Null role and text become empty, null turns come first, and rows with equal turn are ordered by their id.
    Repeated rows are turns of their own. Rows without a conversation are in none. A conversation is one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), turn_id(role, text).alias("id"), F.char_length(text).cast("long").alias("points")).alias("t"))
    return turns.filter("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """Every conversation ``c`` begins with the first ``h`` turns of ``c - c % family`` in place of its own first ``h``; ``h`` is the CRC-32 of ``c`` in decimal modulo ``most + 1``."""
    heads = turns.filter(F.col("conv") % family == 0).select(F.col("conv").alias("head"), F.slice("turns", 1, most).alias("first"))
    both = turns.join(heads, F.col("conv") - F.col("conv") % family == F.col("head"), "left")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    first = F.coalesce(F.slice("first", F.lit(1), h.cast("int")), F.slice("turns", 1, 0))
    own = F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns") - h, F.lit(0)).cast("int"))
    return both.select("conv", F.concat(first, own).alias("turns"))


def _owners(number: int, shared: dict[int, int], spans: dict[int, int]) -> list[int]:
    """For the first path of a range: the earliest range that holds the node at each depth shared with the range before."""
    out = [number] * (shared[number] + 1)
    left, at = shared[number], number - 1
    while left >= 0:
        through = min(spans[at], shared[at], left)  # so deep the path also runs through all of that range, and before
        out[through + 1 : left + 1] = [at] * (left - through)
        left, at = through, at - 1
    return out


def range_nodes(entries: list[tuple[bytes, list[int], list[int]]], number: int, shared: dict[int, int], spans: dict[int, int], width: int = WIDTH) -> Iterator[tuple]:
    """Rows of ``MADE`` for one range of keys: ``entries`` are key, code points by turn and ids of each distinct key, in order.

    ``shared``: by range the depth of the prefix that its first key has in common with the range before (-1: none); ``spans``: that its
    first and last key have. Nodes on those prefixes are open: they get an owner, the earliest range that holds them, and what this range knows
    of them. All that adds up over ranges: conversations and saved tokens are summed, a child counts where it is owned, a leaf where it is seen last.
    """
    tree = RadixTree()
    for place, (key, _, _) in enumerate(entries):
        tree.put(key, place)
    before, after = shared[number], shared.get(number + 1, -1)
    owners, last = _owners(number, shared, spans), len(entries) - 1
    rows: list[list] = []
    # by inner node what is known from below: conversations, least id, own children, leaves, saved, first and last key, nodes that wait for their parent
    known: dict[int, list] = {}
    for node, above, begin, end in tree.bottom_up():
        n, least, children, leaves, saved, low, high, waiting = known.pop(id(node), None) or [0, None, 0, 0, 0, last, 0, []]
        ids = None
        if node.value is not None:
            ids = entries[node.value][2]
            n, least = n + len(ids), ids[0] if least is None else min(least, ids[0])
            low, high = min(low, node.value), max(high, node.value)
        points = entries[low][1]
        for depth in range(end // width, -1 if above is None else begin // width, -1):
            early, late = low == 0 and depth <= before, high == last and depth <= after
            owner = owners[depth] if early else number if late else None
            leaves += not waiting and not late
            if depth:
                saved += (n - (not early)) * points[depth - 1]
            ends = (",".join(map(str, ids)) if owner is not None else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) if ids else None if owner is not None else EMPTY
            for child in waiting:
                rows[child][3 if owner is not None else 5] = owner if owner is not None else least
            rows.append([number, depth, owner, None, least, None, n, children, leaves, saved, ends])
            ids, children, waiting = None, int(not early), [len(rows) - 1]
        if above is not None:
            up = known.setdefault(id(above), [0, None, 0, 0, 0, last, 0, []])
            up[0], up[1] = up[0] + n, least if up[1] is None else min(up[1], least)
            up[2], up[3], up[4] = up[2] + children, up[3] + leaves, up[4] + saved
            up[5], up[6] = min(up[5], low), max(up[6], high)
            up[7].extend(waiting)
    yield from rows


def prefix_trie(sequences: DataFrame, *, turns: int = RANGE) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sequences`` has ``conv`` (a number, once each) and ``turns`` (``id`` in hex, ``points``), as ``rebuilt`` gives them. A key
    is the turns' ids one after the other. Keys are sorted over ranges by key and conversation, so that neither copies of a
    conversation nor conversations with the same first turns need to meet in one task. Every range is a radix tree of its own.
    Nodes at the edges of ranges are known in parts, which are added up: at most one part per range and depth. The list of
    conversations that end in such a node goes through its digest as a stream, in the order of ranges: only that digest is serial.

    A node is told by its least conversation and its depth. No conversation gives no row, not even the root.
    """
    spark = batched(sequences.sparkSession)
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    keys = cut_lineage(sequences.select("conv", F.unhex(ids).alias("key"), F.transform("turns", lambda t: t["points"]).alias("points")))
    size = keys.agg(F.coalesce(F.sum(F.size("points") + 1), F.lit(0))).first()[0]
    ranges = max(parts(spark), math.ceil(size / turns))
    laid = keys.repartitionByRange(ranges, "key", "conv").sortWithinPartitions("key", "conv").withColumn("laid", F.spark_partition_id())
    laid = cut_lineage(laid)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = final = None
        for part in batches:
            if len(part):
                first = part.iloc[0] if first is None else first
                final = part.iloc[-1]
        if first is not None:
            yield pd.DataFrame({"laid": [first["laid"]], "first": [first["key"]], "last": [final["key"]]})

    edge = cut_lineage(laid.select("laid", "key").mapInPandas(edges, "laid int, first binary, last binary"))
    numbers = {r[0]: i for i, r in enumerate(edge.select("laid").orderBy("laid").collect())}  # one whole number per range
    chain = spark.createDataFrame([(i, laid_, i + 1) for laid_, i in numbers.items()], "number int, of int, next int")
    edge = edge.join(chain, F.col("laid") == F.col("of"))
    previous = edge.select(F.col("next").alias("number"), F.col("last").alias("before"))

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            deep = [-1 if a is None else common(a, b) // WIDTH for a, b in zip(part["before"], part["first"], strict=True)]
            yield pd.DataFrame({"number": part["number"], "shared": deep, "span": [common(a, b) // WIDTH for a, b in zip(part["first"], part["last"], strict=True)]})

    measured = edge.select("number", "first", "last").join(previous, "number", "left").mapInPandas(alike, "number int, shared long, span long").collect()
    shared, spans = {r["number"]: r["shared"] for r in measured}, {r["number"]: r["span"] for r in measured}

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: list[tuple[bytes, list[int], list[int]]] = []
        number = None
        for part in batches:
            for conv, key, points, at in zip(part["conv"], part["key"], part["points"], part["laid"], strict=True):
                number = numbers[at]
                if entries and entries[-1][0] == key:
                    entries[-1][2].append(conv)
                else:
                    entries.append((bytes(key), points.tolist(), [conv]))
        if number is None:
            return
        names = [c.split(" ")[0] for c in MADE.split(", ")]
        rows = list(range_nodes(entries, number, shared, spans))
        for at in range(0, len(rows), HANDED):
            yield pd.DataFrame(rows[at : at + HANDED], columns=names).astype({c: "Int64" for c in names[:-1]})

    made = cut_lineage(laid.mapInPandas(grow, MADE))
    counted = ["n_convs", "n_children", "n_leaves", "saved"]
    pieces = made.filter("owner is not null")
    summed = pieces.groupBy("owner", "depth").agg(F.max("above").alias("above"), F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in counted])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in batches:
            out = []
            for owner, depth, text in zip(part["owner"], part["depth"], part["ends"], strict=True):
                if (owner, depth) != now:
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (owner, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=["of", "deep", "digest"])
        if state is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["of", "deep", "digest"])

    listed = pieces.filter("ends is not null").select("owner", "depth", "range", "ends").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "range")
    listed = listed.mapInPandas(digests, "of int, deep long, digest string")
    whole = summed.join(listed, (F.col("owner") == F.col("of")) & (F.col("depth") == F.col("deep")), "left")
    whole = cut_lineage(whole.select("owner", "depth", "above", "conv", *counted, F.coalesce("digest", F.lit(EMPTY)).alias("ends")))
    named = whole.select(F.col("owner").alias("of"), F.col("depth").alias("deep"), F.col("conv").alias("top"))
    upper = whole.join(named, (F.col("above") == F.col("of")) & (F.col("depth") == F.col("deep") + 1), "left").select("conv", "depth", F.col("top").alias("parent"), *counted, "ends")
    # nodes below an open one find it by their own range, so that the root with all its children is no single key
    inner = made.filter("owner is null")
    local = pieces.select("range", F.col("owner").alias("of"), F.col("depth").alias("deep")).join(named.withColumnsRenamed({"of": "of2", "deep": "deep2"}), (F.col("of") == F.col("of2")) & (F.col("deep") == F.col("deep2")))
    local = local.select(F.col("range").alias("within"), "of", "deep", "top")
    below = inner.filter("above is not null").join(local, (F.col("range") == F.col("within")) & (F.col("above") == F.col("of")) & (F.col("depth") == F.col("deep") + 1))
    below = below.select("conv", "depth", F.col("top").alias("parent"), *counted, "ends")
    rest = inner.filter("above is null").select("conv", "depth", "parent", *counted, "ends")
    out = upper.unionByName(below).unionByName(rest)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
