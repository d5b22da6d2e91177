"""How many pairs of two lists of texts are in order, as an Arrow UDF."""
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Ship these functions with the job, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _flat(lists):
    """The texts of all lists after each other, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _ordered_pairs(left: pa.Array, right: pa.Array) -> pa.Array:
    """For each row, the pairs of a text on the left and a later one on the right, by their bytes; texts that are equal or null are none."""
    texts_l, row_l = _flat(left)
    texts_r, row_r = _flat(right)
    known = pa.concat_arrays([texts_l.cast(pa.large_string()), texts_r.cast(pa.large_string())]).dictionary_encode()
    places = np.empty(max(len(known.dictionary), 1), dtype=np.int64)
    places[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(known.dictionary))
    there, slots = known.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(known.indices, 0).to_numpy(zero_copy_only=False)
    # A row's texts are numbers in a range of their own, so one search serves all rows.
    keys = places[slots] + np.concatenate([row_l, row_r]) * len(places)
    l, r = np.sort(keys[:len(row_l)][there[:len(row_l)]]), np.sort(keys[len(row_l):][there[len(row_l):]])
    at = r // len(places)
    before = np.searchsorted(l, r) - np.searchsorted(l, np.arange(len(left)) * len(places))[at]
    out = np.zeros(len(left), dtype=np.int64)
    np.add.at(out, at, before)
    return pa.array(out)


ordered_pairs = F.arrow_udf(_ordered_pairs, LongType()).asNondeterministic()
