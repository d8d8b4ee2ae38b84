"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.bpe_arrays import MergeTable, merge_all, take_ragged
from tablelens.llm.common import batched

MARK = "▁"
#: A chunk: white-space marks and the characters up to the next mark. Pieces have marks in front only, so none goes over a chunk's end.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks that a worker remembers, and chunks of one call that are looked up together.
REMEMBERED = 150_000
TOGETHER = 60_000


class PieceModel:
    """The pieces of a BPE model with byte fallback, as arrays, and the chunks segmented so far."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if library.is_byte(i)}
        self.begin, self.end = library.bos_id(), library.eos_id()
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes over a white-space mark: chunks cannot be segmented alone")
        if len(self.bytes) != 256 or library.encode("x  y ") and library.decode(library.encode("x  y ")) != "x  y ":
            raise ValueError("only models with byte fallback that keep white space are supported")
        self.symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            self.symbols[c] = len(self.symbols) + size  # a character that only occurs inside pieces
        self.surface = {i: p for p, i in self.symbols.items()}
        score = {p: library.get_score(i) for p, i in normal.items()}
        order = {p: n for n, p in enumerate(sorted(normal, key=lambda p: (-score[p], normal[p])))}
        found = [
            (self.symbols[p[:k]], self.symbols[p[k:]], order[p], normal[p])
            for p in normal for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols
        ]
        self.table = MergeTable(*(np.array(x, np.int64) for x in zip(*found)))
        self.size = size
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        #: What an id stands for: marks as spaces, byte pieces as their byte.
        self.raw = [spelled.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.flat, self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Segment chunks that are new, each once, and add them to the table."""
        if not chunks:
            return
        symbol = self.symbols.get
        start = np.array([symbol(c, -1 - ord(c)) for chunk in chunks for c in chunk], np.int64)
        merged, counts = merge_all(start, np.array([len(c) for c in chunks]), self.table)
        rough = np.flatnonzero((merged < 0) | (merged >= self.size))
        if len(rough):  # characters without a piece become their UTF-8 bytes
            spelled = [[self.bytes[b] for b in (chr(-1 - s) if s < 0 else self.surface[s]).encode("utf-8")] for s in merged[rough].tolist()]
            sizes = np.ones(len(merged), np.int64)
            sizes[rough] = [len(x) for x in spelled]
            owner = np.repeat(np.arange(len(counts)), counts)
            merged = np.repeat(merged, sizes)
            begin = (np.cumsum(sizes) - sizes)[rough]
            for at, x in zip(begin, spelled):
                merged[at : at + len(x)] = x
            counts = np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)
        base = len(self.text)
        self.place.update(zip(chunks, range(base, base + len(chunks))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, merged))
        edges = np.concatenate(([0], np.cumsum(counts))).tolist()
        ids, raw = merged.tolist(), self.raw
        self.text.extend(b"".join([raw[i] for i in ids[a:b]]).decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:]))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """Ids with begin and end, and the decoded text, of each text."""
        ids, decoded = [], []
        at = 0
        while at < len(texts):
            cut, n = [], 0
            while at < len(texts) and n < TOGETHER:
                text = texts[at]
                cut.append(CHUNK.findall(MARK + text.replace(" ", MARK)) if text else [])
                n += len(cut[-1])
                at += 1
            if len(self.place) > REMEMBERED:
                self.forget()
            self.learn(list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.place)))
            for chunks in cut:
                picks = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
                body = take_ragged(self.flat, self.starts, self.counts, picks)
                ids.append(np.concatenate(([self.begin], body, [self.end])).astype("<u4"))
                decoded.append("".join([self.text[i] for i in picks.tolist()])[1:])  # without the mark put before the text
        return ids, decoded


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, ids`` (32-bit little-endian, with begin and end) ``, n_tokens, decoded``.

    Tasks cut texts at white-space marks. Each worker keeps a table of distinct chunks, segments a chunk once
    when it first comes, with all new chunks of a batch in one go, and joins ids and texts back by position.
    The table starts anew at ``REMEMBERED`` chunks, so memory is bounded and results do not depend on it.
    No shuffle: a table for the whole corpus would send every word's position over the network.

    A null or empty text has the begin and end ids only and decodes to an empty text. Null ids and repeated
    rows pass through. ``model_path`` must be readable where tasks run.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(model_path)
        for rows in batches:
            ids, decoded = own.encode(rows["_text"].tolist())
            yield pd.DataFrame({"_id": rows["_id"], "ids": [x.tobytes() for x in ids], "n_tokens": [len(x) for x in ids], "decoded": decoded})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind}, ids binary, n_tokens long, decoded string").withColumnRenamed("_id", id_col)
