"""Counts and moments of all pairs of numeric columns as matrices: one scan for any number of columns.

With n columns there are n^2 pairs, too many for as many aggregate columns. Here a task turns its batches of rows into products of
matrices with null masks and hands over one row per pair; those rows are summed. No row of the table moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triples that are tested together on a batch of rows.
TOGETHER = 64


def _floats(part):
    import numpy as np

    return np.stack([part[c].to_numpy(dtype=float, na_value=np.nan) for c in part.columns], axis=1)


def pair_moments(nums: DataFrame) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for every pair of columns i < j, over the rows with both values.

    Values are taken relative to the first known one of their column among the first rows, which keeps the sums exact for constant columns.
    """
    first = nums.limit(1_000).agg(*[F.first(c, ignorenulls=True).alias(c) for c in nums.columns]).first()
    shift, floats = [float(first[c] or 0.0) for c in nums.columns], _plain(_floats)

    def gram(batches):
        import numpy as np
        import pandas as pd

        size, moved = len(shift), np.array(shift)
        n, sx, sxx, sxy = (np.zeros((size, size)) for _ in range(4))
        for part in batches:
            x = floats(part)
            known = ~np.isnan(x)
            x, mask = np.where(known, x - moved, 0.0), known.astype(float)
            n += mask.T @ mask
            sx += x.T @ mask
            sxx += (x * x).T @ mask
            sxy += x.T @ x
        i, j = np.triu_indices(size, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j].astype(np.int64), "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]})

    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    return nums.mapInPandas(gram, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double").groupBy("i", "j").agg(*sums)


def pair_fits(nums: DataFrame) -> DataFrame:
    """``(a, b, both, fits)``: rows in which both columns are known and b is not 0, and those of them with a <= b."""
    floats = _plain(_floats)

    def count(batches):
        import numpy as np
        import pandas as pd

        both = fits = 0
        for part in batches:
            x = floats(part)
            known = ~np.isnan(x)
            usable = known & (x != 0)
            both = both + known.T.astype(np.int64) @ usable.astype(np.int64)
            fits = fits + np.stack([((x[:, [a]] <= x) & usable).sum(axis=0) for a in range(x.shape[1])])
        if np.ndim(both):
            a, b = np.nonzero(~np.eye(len(both), dtype=bool))
            yield pd.DataFrame({"a": a, "b": b, "both": both[a, b], "fits": fits[a, b]})

    return nums.mapInPandas(count, "a int, b int, both long, fits long").groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("fits").alias("fits"))


def triple_misses(nums: DataFrame, triples: list[tuple[int, int, int]], least: float, relative: float) -> DataFrame:
    """``(t, n, bad)`` by place of the triple (p, a, b): rows with all three values and b not 0, and those in which p is not a / b x 100 or a > b."""
    floats, together = _plain(_floats), TOGETHER

    def test(batches):
        import numpy as np
        import pandas as pd

        places = np.array(triples)
        n, bad = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for part in batches:
            x = floats(part)
            for at in range(0, len(places), together):
                p, a, b = (x[:, places[at : at + together, k]] for k in range(3))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    counted = ~np.isnan(p) & ~np.isnan(a) & ~np.isnan(b) & (b != 0)
                    off = (a > b) | (np.abs(a / b * 100 - p) > np.maximum(least, np.abs(p) * relative))
                n[at : at + together] += counted.sum(axis=0)
                bad[at : at + together] += (counted & off).sum(axis=0)
        yield pd.DataFrame({"t": np.arange(len(places)), "n": n, "bad": bad})

    return nums.mapInPandas(test, "t int, n long, bad long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _plain(function):
    """The function by value, so that executors need not have this package."""
    from types import FunctionType

    return FunctionType(function.__code__, {"__builtins__": __builtins__}, function.__name__)
