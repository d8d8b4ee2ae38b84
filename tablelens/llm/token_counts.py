"""Token counts of a lower-casing byte-level BPE by merging arrays of pre-tokens in step."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tablelens.llm.bpe_arrays import MergeTable, merge_all
from tablelens.llm.common import batched

REMEMBERED = 150_000
TOGETHER = 60_000
#: Texts of these code points are their own NFC form, and every version of Unicode cuts and lower-cases them alike.
LATIN = regex.compile("[\\x00-\u024f]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordCounter:
    """Counts tokens as the tokenizer file says: special strings, NFC, lower case, pre-tokens, merges with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or not (splitter["type"] == "Split" and splitter["invert"] and splitter["behavior"] == "Removed"):
            raise ValueError("this file has other normalising or splitting steps")
        # other texts are normalised and cut by the library's own steps, whose tables may be of another version of Unicode than Python's
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.cut = pre_tokenizers.Split(Regex(splitter["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        # white space by its Unicode property; the replacing step only changes what is dropped here
        self.tokens = regex.compile(splitter["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges)))
        self.table = MergeTable(left, right, np.arange(len(merges)), made)
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int64)
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Count the surviving symbols of new pre-tokens, all merged together."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(r) for r in raw])
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        _, counts = merge_all(symbols, lengths, self.table)
        self.known.update(zip(words, counts.tolist()))

    def words(self, text: str) -> list[str]:
        if LATIN.fullmatch(text):
            return self.tokens.findall(text.lower())
        return [word for word, _ in self.cut(self.normalise(text))]

    def count(self, texts: list[str | None]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            cut, n = [], 0
            while at < len(texts) and n < TOGETHER:
                text, extra, words = texts[at] or "", 0, []
                if self.specials is not None and "<" in text:
                    parts = self.specials.split(text)
                    extra = len(parts) - 1
                    for part in parts:
                        words += self.words(part)
                else:
                    words = self.words(text)
                cut.append((extra, words))
                n += len(words)
                at += 1
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            self.learn(list(dict.fromkeys(w for _, words in cut for w in words if w not in known)))
            out += [extra + sum(map(known.__getitem__, words)) for extra, words in cut]
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Begin and end tokens are not added; special strings inside a text count as one token each, as is the
    library's default. New pre-tokens of a batch are merged in step; a worker remembers the counts of up to
    ``REMEMBERED`` pre-tokens and then starts anew, so memory is bounded. There is no shuffle. A null text
    counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows pass through.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer_path)
        for rows in batches:
            yield pd.DataFrame({"_id": rows["_id"], "n_bytes": rows["_bytes"], "n_tokens": own.count(rows["_text"].tolist())})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    out = rows.mapInPandas(run, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
