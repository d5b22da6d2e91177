"""Pairs of rows that agree on sets of fields, counted by cutting groups field by field, as Arrow tables go by.

A group of rows that share the values of some fields is cut by one more field at a time. A group of one row makes no pair under any further
field, so it goes no deeper.
"""
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship these functions with the job, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dense(values):
    """Numbers from 0 without gaps for whole numbers from 0, and how many there are."""
    span = int(values.max()) + 1 if len(values) else 0
    if span <= 8 * len(values) + 1024:
        seen = np.zeros(span, dtype=np.int64)
        seen[values] = 1
        return (np.cumsum(seen) - 1)[values], int(seen.sum())
    known, slot = np.unique(values, return_inverse=True)
    return slot, len(known)


def _pairs(groups, n_groups, n, na, link):
    """Pairs of different rows inside the groups, each row standing for n records, of which na are in the first table."""
    total = np.zeros(n_groups, dtype=np.int64)
    np.add.at(total, groups, n)
    if not link:
        return int((total * total).sum() - (n * n).sum()) // 2
    of_a = np.zeros(n_groups, dtype=np.int64)
    np.add.at(of_a, groups, na)
    return int((of_a * (total - of_a)).sum() - (na * (n - na)).sum())


def _shared(rows, groups, n_groups):
    """Rows whose group has another row, and their groups."""
    many = np.bincount(groups, minlength=n_groups)[groups] > 1
    return rows[many], groups[many]


def cut(start, codes, n, na, lead, wanted, link):
    """{mask: pairs of rows that share their group and all fields of the mask}: `start` has the group of each row under the field `lead`, `codes` the values of each
    field after it as numbers, -1 for none, and `wanted` the masks to count. Bits are places of fields; a mask's lowest is `lead`."""
    prefixes = {mask & ((2 << q) - 1) for mask in wanted for q in range(lead, mask.bit_length()) if mask >> q & 1}
    out, (groups, n_groups) = {}, _dense(start)
    todo = [(1 << lead, lead, *_shared(np.arange(len(start)), groups, n_groups))] if 1 << lead in prefixes else []
    while todo:
        mask, last, rows, groups = todo.pop()
        if not len(rows):
            continue
        groups, n_groups = _dense(groups)
        if mask in wanted:
            out[mask] = _pairs(groups, n_groups, n[rows], na[rows], link)
        for q in range(last + 1, max(codes, default=-1) + 1):
            if mask | 1 << q in prefixes:
                own = codes[q][rows]
                there = own >= 0
                # Values of the field are numbered from 0, so that group and value make one number.
                finer, n_finer = _dense(groups[there] * (int(own.max(initial=0)) + 1) + own[there])
                todo.append((mask | 1 << q, q, *_shared(rows[there], finer, n_finer)))
    return out


def cutter(n_fields, masks, link):
    """For mapInArrow over (lead, group, n, na, after: the hashes of the fields after the lead), all rows of a lead and group in one partition: (mask, c),
    pairs of different rows by mask."""
    by_lead = {}
    for mask in masks:
        by_lead.setdefault((mask & -mask).bit_length() - 1, set()).add(mask)

    def run(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        leads, found = table["lead"].to_numpy(), {}
        for lead in np.unique(leads):
            some = table.filter(pa.array(leads == lead))
            whole = lambda c: some[c].to_numpy()
            after = some["after"].combine_chunks().flatten()
            shape = (some.num_rows, n_fields - 1 - int(lead))
            hashes, missing = after.fill_null(0).to_numpy(zero_copy_only=False).reshape(shape), after.is_null().to_numpy(zero_copy_only=False).reshape(shape)
            start = np.unique(whole("group"), return_inverse=True)[1]
            codes = {int(lead) + 1 + k: np.where(missing[:, k], -1, np.unique(hashes[:, k], return_inverse=True)[1]) for k in range(shape[1])}
            for mask, c in cut(start, codes, whole("n"), whole("na"), int(lead), by_lead[int(lead)], link).items():
                found[mask] = found.get(mask, 0) + c
        yield pa.RecordBatch.from_pydict({"mask": pa.array(list(found), pa.int64()), "c": pa.array(list(found.values()), pa.int64())})

    return run
