"""Byte-pair merging of many short sequences at once, held as ragged numpy arrays."""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int64).max


class MergeTable:
    """Which adjacent pair of symbols becomes which symbol, and how early."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], rank.astype(np.int64)[order], made.astype(np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], NEVER), np.where(known, self.made[at], -1)


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end; the surviving symbols, in order, and their number per sequence.

    In each step every sequence applies its own lowest-rank pair at all its places, from the left where they
    overlap, and sequences without a pair leave. A pair made by a merge ranks behind it, so this gives what
    merging one place at a time gives. Sequences have one symbol at least. Steps: as many as the sequence
    with most distinct merges needs; later steps only hold the sequences that are still being merged.
    """
    symbols = symbols.astype(np.int64)
    which = np.arange(len(lengths))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(s), NEVER), np.full(len(s), -1, np.int64)
        if len(s) > 1:
            rank[:-1], made[:-1] = table.look_up(s[:-1], s[1:])
        rank[np.cumsum(n) - 1] = NEVER  # the last symbol of a sequence has no right neighbour
        return rank, made

    rank, made = pairs(symbols, lengths)
    while len(which):
        best = np.minimum.reduceat(rank, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        going = best < NEVER
        if not going.all():
            keep = np.repeat(going, lengths)
            done.append((which[~going], lengths[~going], symbols[~keep]))
            which, lengths, best = which[going], lengths[going], best[going]
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            if not len(which):
                break
        hits = np.flatnonzero(rank == np.repeat(best, lengths))
        run_start = np.ones(len(hits), bool)
        run_start[1:] = np.diff(hits) > 1
        place = np.arange(len(hits)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hits)), 0))
        hits = hits[place % 2 == 0]
        symbols[hits] = made[hits]
        stay = np.ones(len(symbols), bool)
        stay[hits + 1] = False
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lengths) - 1] = True
        ends[hits] |= ends[hits + 1]
        lengths = lengths - np.bincount(owner[hits], minlength=len(lengths))
        moved = np.cumsum(stay) - 1
        symbols, rank, made, ends = symbols[stay], rank[stay], made[stay], ends[stay]
        new = moved[hits]
        for at in (new, new[new > 0] - 1):  # only pairs next to a merge change
            inside = at[~ends[at]]
            rank[at], made[at] = NEVER, -1
            rank[inside], made[inside] = table.look_up(symbols[inside], symbols[inside + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, counts, flat = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(ids)
    return take_ragged(flat, np.cumsum(counts) - counts, counts, order), counts[order]


def take_ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` named by ``picks``, one after another."""
    n = counts[picks]
    total = int(n.sum())
    if not total:
        return flat[:0]
    step = np.repeat(starts[picks] - (np.cumsum(n) - n), n)
    return flat[step + np.arange(total)]
