"""String similarities Spark has no built-in for, as Arrow UDFs.

Each batch is reduced to its distinct unequal value pairs first. Pairs are then taken in groups of like length and worked on
as whole arrays of code points, so a stray long text costs its own length and no other pair's; very long ones go one by one.
"""
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

# Ship these functions with the job, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _distinct_pairs(left, right):
    present = left.notna() & right.notna()
    pairs = pd.DataFrame({"a": left[present], "b": right[present]})
    slot = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy()
    unique = pairs.drop_duplicates()
    return present.to_numpy(), slot, unique["a"].to_numpy(), unique["b"].to_numpy()


def _code_points(values):
    text = np.asarray(list(values), dtype=str)
    width = max(text.dtype.itemsize // 4, 1)
    return text.astype(f"<U{width}").view(np.uint32).reshape(len(text), width), np.char.str_len(text)


#: Characters beyond which a pair is worked on alone, and cells of a group that are held at once.
LONG, CELLS = 64, 2_000_000


def jaro_of_long(a, b):
    """Jaro of one pair in time linear in its length: the window only moves right, so a passed place never comes back."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    following = dict.fromkeys(places, 0)
    of_a, used = [], []
    for i, x in enumerate(a):
        own = places.get(x)
        if own is None:
            continue
        k = following[x]
        while k < len(own) and own[k] < i - reach:
            k += 1
        if k < len(own) and own[k] <= i + reach:
            of_a.append(x)
            used.append(own[k])
            k += 1
        following[x] = k
    hits = len(used)
    if not hits:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(of_a, sorted(used))) // 2
    return (hits / len(a) + hits / len(b) + (hits - swaps) / hits) / 3.0


def by_length(function, single=None):
    """`function` over groups of pairs of like length, each of bounded size; `single` takes pairs with a long value."""
    def run(left, right):
        out = np.zeros(len(left))
        sizes = np.fromiter((max(len(a), len(b), 1) for a, b in zip(left, right)), dtype=np.int64, count=len(left))
        groups = np.ceil(np.log2(sizes)).astype(np.int64)
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            if single is not None and 2 ** g > LONG:
                out[at] = [single(left[i], right[i]) for i in at]
                continue
            step = max(1, CELLS // (4 ** int(g)))
            for k in range(0, len(at), step):
                some = at[k:k + step]
                out[some] = function(left[some], right[some])
        return out
    return run


def jaro_array(left, right):
    a, len_a = _code_points(left)
    b, len_b = _code_points(right)
    rows = np.arange(len(a))
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    place = np.arange(b.shape[1])[None, :]
    taken = place >= len_b[:, None]
    found = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        near = np.abs(place - i) <= reach[:, None]
        options = (b == a[:, i:i + 1]) & ~taken & near & (i < len_a)[:, None]
        some = options.any(axis=1)
        taken[rows[some], options.argmax(axis=1)[some]] = True
        found[some, i] = True
    hits = found.sum(axis=1)
    used = taken & (place < len_b[:, None])
    in_a = np.take_along_axis(a, np.argsort(~found, axis=1, kind="stable"), axis=1)
    in_b = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), axis=1)
    width = min(a.shape[1], b.shape[1])
    differ = (in_a[:, :width] != in_b[:, :width]) & (np.arange(width)[None, :] < hits[:, None])
    swaps = differ.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (hits / len_a + hits / len_b + (hits - swaps) / hits) / 3.0
    return np.where(hits == 0, 0.0, score)


def _winkler(base, left, right):
    prefix = np.fromiter((next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
                          for a, b in zip(left, right)), dtype=np.int64, count=len(left))
    return np.where(base > 0.7, base + 0.1 * prefix * (1.0 - base), base)


def jaro_winkler_array(left, right):
    return _winkler(jaro_array(left, right), left, right)


def damerau_array(left, right):
    """Edit distance with insertions, deletions, substitutions and (unrestricted) transpositions, of many pairs at once: one
    step for each cell of the table, over all pairs."""
    a, len_a = _code_points(left)
    b, len_b = _code_points(right)
    rows = np.arange(len(a))
    grid = np.zeros((a.shape[1] + 2, b.shape[1] + 2, len(a)), dtype=np.int32)
    grid[0, :], grid[:, 0] = (far := a.shape[1] + b.shape[1]), far
    grid[1:, 1] = np.arange(a.shape[1] + 1)[:, None]
    grid[1, 1:] = np.arange(b.shape[1] + 1)[:, None]
    last_row = np.zeros((b.shape[1], len(a)), dtype=np.int64)  # by place of b: the last row before this one with its character
    for i in range(1, a.shape[1] + 1):
        last_col = np.zeros(len(a), dtype=np.int64)
        for j in range(1, b.shape[1] + 1):
            same = a[:, i - 1] == b[:, j - 1]
            row = last_row[j - 1]
            swapped = grid[row, last_col, rows] + (i - row - 1) + 1 + (j - last_col - 1)
            grid[i + 1, j + 1] = np.minimum(np.minimum(grid[i, j] + ~same, swapped), np.minimum(grid[i + 1, j], grid[i, j + 1]) + 1)
            last_col[same] = j
        last_row[(b == a[:, i - 1:i]).T] = i
    return grid[len_a + 1, len_b + 1, rows].astype(float)


def _batched(function, left, right, equal):
    """`function` over the distinct pairs of a batch; pairs of one non-empty value score `equal`."""
    out = np.full(len(left), np.nan)
    same = ((left == right) & (left != "")).fillna(False).to_numpy(dtype=bool)
    out[same] = equal
    rest = ~same
    present, slot, a, b = _distinct_pairs(left[rest], right[rest])
    if len(a):
        out[np.flatnonzero(rest)[present]] = function(a, b)[slot]
    return pd.Series(out)


def _jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batched(by_length(jaro_array, jaro_of_long), left, right, 1.0)


def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batched(by_length(jaro_winkler_array, lambda a, b: float(_winkler(np.array([jaro_of_long(a, b)]), [a], [b])[0])), left, right, 1.0)


def _damerau(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batched(by_length(damerau_array), left, right, 0.0).astype("Int32")


# Declared nondeterministic so that the optimizer evaluates each call once, in its own column, instead
# of copying it into every filter and projection above.
jaro_similarity = F.pandas_udf(_jaro, DoubleType()).asNondeterministic()
jaro_winkler_similarity = F.pandas_udf(_jaro_winkler, DoubleType()).asNondeterministic()
damerau_levenshtein = F.pandas_udf(_damerau, IntegerType()).asNondeterministic()


def register(spark):
    """Make the similarities callable by name in SQL conditions of a model."""
    spark.udf.register("jaro_similarity", jaro_similarity)
    spark.udf.register("jaro_winkler_similarity", jaro_winkler_similarity)
    spark.udf.register("damerau_levenshtein", damerau_levenshtein)
