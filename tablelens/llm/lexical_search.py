"""Ranked lexical search: term-at-a-time over shards of documents, with a limit on accumulators that loses nothing."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import batched
from tablelens.session import cut_lineage

TOP = 50
#: Terms and wanted results of the items that one pass over the documents serves; more items are served in further passes.
BLOCK = 1 << 19
#: Postings that a shard holds in a task's memory; a task walks through its shards one after the other.
SHARD = 1 << 20
#: Whole texts are cut into words in pieces of about so many bytes, always between two words.
PIECE = 1 << 20
#: Rankings of the tasks meet in this many groups an item before they meet in one.
FOLD = 64

#: Letters, digits and everything outside ASCII stay, A-Z become a-z, the rest parts terms.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    data = (text or "").encode().translate(_FOLDED)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2.0 * documents + 2) / (2 * holding + 1)))


def _norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    if 50 * int(n.max(initial=0)) * documents < 2**63:
        return 50 + 50 * n * documents // total
    return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)


def best(scores: np.ndarray, missing: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by id, rows without an id last."""
    at = np.arange(len(scores))
    if len(at) > top:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    return at[np.lexsort((ids[at], missing[at], -scores[at]))][:top]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that can be among the ``top``, and their exact scores.

    ``lists`` holds documents and contributions of an item's terms, rarest first. Once the terms that are left cannot lift a
    new document to the ``top``-th partial score (or to ``floor``, which earlier shards have reached), no
    accumulator is made any more; those there are get all further contributions. Equality keeps a document, as its id may be smaller.
    """
    left = np.cumsum([int(v.max()) for _, v in lists][::-1])[::-1].tolist() + [0]
    scores, live, creating = np.zeros(size, np.int64), np.zeros(size, bool), True
    for (at, value), rest in zip(lists, left[1:], strict=True):
        if not creating:
            known = live[at]
            at, value = at[known], value[known]
        scores[at] += value
        if creating:
            live[at] = True
            bound = floor
            if rest >= bound and rest < scores.max():
                some = scores[live]
                if len(some) >= top:
                    bound = max(bound, int(np.partition(some, len(some) - top)[len(some) - top]))
            creating = rest >= bound
    found = np.flatnonzero(live & (scores > 0) & (scores >= floor))
    return found, scores[found]


def lexical_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    top: int = TOP, block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """``item_col, rank, id_col, score``: for every item its ``top`` documents with a score above 0, best first.

    A first pass over the documents keeps for each its length and the places' numbers of those terms that an item has; from it
    come the numbers of documents, terms and documents per term, over all rows. Then every task walks through its
    documents in shards: inverted lists of the shard, and per item one term after the other, rarest in the whole table first (``accumulate``).
    What a task has ranked bounds its next shards. The tasks' rankings, ``top`` rows an item, meet in two steps.
    Items are served in blocks of bounded size, a pass over the documents each.

    Ids are whole numbers. Null and empty texts have no term: such documents are not counted or ranked, such items get no row. Rows that share an
    item id are one item with the terms of all of them; a null item id is an item too. Repeated documents
    are ranked each; equal scores are ordered by id, null ids last.
    """
    spark = batched(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for key, text in zip(part["item"], part["text"], strict=True):
                found = sorted({t for piece in terms(text) for t in piece})
                yield pd.DataFrame({"item": [key] * len(found), "term": found}, dtype=object)

    wanted = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    wanted = cut_lineage(wanted.mapInPandas(item_terms, "item string, term binary").distinct())
    size = wanted.agg(F.count(F.lit(1)) + top * (F.count_distinct("item") + 1)).first()[0]
    blocks = max(1, math.ceil(size / block))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for number in range(blocks):
        pairs = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        ranked = _pass(texts, [(r["item"], bytes(r["term"])) for r in pairs], top, shard)
        out = ranked if out is None else out.unionByName(ranked)
    rows = out.select(F.col("item").cast(kinds[1]).alias(item_col), "rank", F.col("id").cast(kinds[0]).alias(id_col), "score")
    return rows


def _pass(texts: DataFrame, pairs: list[tuple[str | None, bytes]], top: int, shard: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    names = sorted({k for k, _ in pairs}, key=lambda k: (k is None, k))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for key, none, text in zip(part["id"], part["none"], part["text"], strict=True):
                n, held = 0, Counter()
                for piece in terms(text):
                    n += len(piece)
                    held.update(filter(vocabulary.__contains__, piece))
                if n:
                    found = sorted((vocabulary[t], c) for t, c in held.items())
                    rows.append((key, none, n, *(np.array(x, np.int32).tobytes() for x in (zip(*found) if found else ((), ())))))
            yield pd.DataFrame(rows, columns=["id", "none", "n", "terms", "counts"])

    keyed = texts.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "text")
    postings = cut_lineage(keyed.mapInPandas(posted, "id long, none boolean, n long, terms binary, counts binary"))

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(vocabulary), np.int64)
        for part in batches:
            seen += np.bincount(np.frombuffer(b"".join(part["terms"]), np.int32), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": at, "df": seen[at]})

    documents, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in postings.select("terms").mapInPandas(holding, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.array([weight(documents, int(n)) if n else 0 for n in df], np.int64)
    number = {k: i for i, k in enumerate(names)}
    queries: list[list[int]] = [[] for _ in names]
    for k, t in pairs:
        queries[number[k]].append(vocabulary[t])
    queries = [sorted(q, key=lambda t: (df[t], t)) for q in queries]  # rarest first

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in batches:
            held.append(part)
            n += sum(map(len, part["terms"])) // 4
            if n >= shard:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = np.zeros(0, np.int64)
        kept = [(empty, empty.astype(bool), empty)] * len(names)
        for part in shards(batches):
            if not len(part):
                continue
            term = np.frombuffer(b"".join(part["terms"]), np.int32)
            count = np.frombuffer(b"".join(part["counts"]), np.int32).astype(np.int64)
            doc = np.repeat(np.arange(len(part)), part["terms"].map(len).to_numpy() // 4)
            order = np.argsort(term, kind="stable")
            term, count, doc = term[order], count[order], doc[order]
            norm = _norms(part["n"].to_numpy(), documents, total)
            value = weights[term] * (1_000_000_000 * count // (1000 * count + 20 * norm[doc]))
            starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            ids, none = part["id"].to_numpy(), part["none"].to_numpy(bool)
            for i, query in enumerate(queries):
                lists = [(doc[starts[t] : starts[t + 1]], value[starts[t] : starts[t + 1]]) for t in query if starts[t] < starts[t + 1]]
                scores, missing, known = kept[i]
                found, own = accumulate(lists, len(part), top, int(scores[-1]) if len(scores) >= top else 0)
                if len(found):
                    scores, missing, known = np.append(scores, own), np.append(missing, none[found]), np.append(known, ids[found])
                    at = best(scores, missing, known, top)
                    kept[i] = scores[at], missing[at], known[at]
        for i, (scores, missing, known) in enumerate(kept):
            if len(scores):
                yield pd.DataFrame({"item": pd.Series([names[i]] * len(scores), dtype=object), "id": known, "none": missing, "score": scores})

    ranked = postings.mapInPandas(search, "item string, id long, none boolean, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FOLD)))
    order = [F.desc("score"), F.col("none"), F.col("id")]
    few = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return few.select("item", "rank", F.when(~F.col("none"), F.col("id")).alias("id"), "score")
