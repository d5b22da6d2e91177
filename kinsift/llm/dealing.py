"""Which of the 64-bit numbers of a corpus occur more than once, told to the places they come from.

A task gathers the numbers of a piece of the corpus with the owner of each (a number in the piece), and deals them, sorted and packed, to
blocks of the range of numbers. A block counts, and sends back to every piece those of its numbers that occur elsewhere too. So a
number costs some eight bytes of shuffle, and only repeated ones travel twice; nothing is broadcast. The number of
blocks follows the counted input. A head goes from the task to whoever reads the piece afterwards.
"""
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa

#: Numbers that a block holds, on average, and numbers of a piece at most, in a corpus of up to some ten billion numbers: 50 MB of arrays in
#: a task. Owners are told in 16 bits.
BLOCK_NUMBERS, PIECE_NUMBERS, OWNERS = 500_000, 1_000_000, 65_000
#: Numbers that one piece deals to one block, on average, at least, and how large pieces and blocks may become for it. Fewer
#: would make a row of each number.
ROW_NUMBERS, LARGEST = 32, 16_000_000
#: Counts are told apart up to here; a block does not hold the places of more frequent numbers.
FREQUENT = 65_535

DEALT = "block int, piece string, head boolean, first long, width int, data binary, owners binary"
SHARED = "piece string, head boolean, data binary, owners binary, counts binary"


def sizes(total, block=None, piece=None):
    """(blocks, numbers a block, numbers a piece) for a counted total."""
    side = min(math.isqrt(ROW_NUMBERS * total), LARGEST)
    block, piece = max(block or BLOCK_NUMBERS, side), max(piece or PIECE_NUMBERS, side)
    return max(1, -(-total // block)), block, piece


def _names(schema):
    return [x.split(" ")[0] for x in schema.split(", ")]


def pack(values):
    """(first value, bytes a difference, differences) of ascending 64-bit numbers."""
    steps = np.diff(values)
    width = max((int(steps.max()).bit_length() + 7) // 8, 1) if len(steps) else 1
    return int(values[0]), width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(first, width, data):
    steps = np.zeros((len(data) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)])


def deal(piece, head, values, owners, n_blocks):
    """A batch of DEALT rows: the head (two byte strings) and the numbers of a piece. `owners` are numbers under 65536."""
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order].astype("<u2")
    block = (((values >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
    rows = [(crc32(piece.encode()) % n_blocks, piece, True, None, None, *head)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        first, width, data = pack(values[a:b])
        rows.append((int(block[a]), piece, False, int(np.uint64(first).view(np.int64)), width, data, owners[a:b].tobytes()))
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _names(DEALT))


def _sent(rows):
    kinds = [pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _names(SHARED))


def _by_piece(at, values, owners, counts, names):
    """A row for each piece with the repeated numbers of one block that come from it."""
    order = np.argsort(at, kind="stable")
    at, values, owners, counts = at[order], values[order], owners[order], counts[order].astype("<u2")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    return _sent([(names[at[a]], False, values[a:b].tobytes(), owners[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])])


def repeated(most, frequent):
    """Function of a block's DEALT rows that yields SHARED rows: the numbers that occur more than once, with their counts up to `frequent`.

    When `most` places are held, those of numbers seen `frequent` times are sent on at once, so a number that a third of all
    documents have takes no more room than another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hot = [], np.empty(0, np.uint64)
        held, n_held, limit = [], 0, most

        def settled(last):
            """What can be sent, and what has to wait, of all that is held."""
            nonlocal hot
            values, owners, at = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(values, kind="stable")
            values, owners, at = values[order], owners[order], at[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
            count = np.diff(starts)
            often = count >= frequent
            hot = np.union1d(hot, values[starts[:-1]][often])
            counts = np.repeat(np.minimum(count, frequent), count)
            out = counts > 1 if last else np.repeat(often, count)
            return (at[out], values[out], owners[out], counts[out]), [(values[~out], owners[~out], at[~out])]

        for batch in batches:
            passed = []
            for row in batch.to_pylist():
                if row["head"]:
                    passed.append((row["piece"], True, row["data"], row["owners"], None))
                    continue
                values = unpack(np.int64(row["first"]).view(np.uint64), row["width"], row["data"])
                owners = np.frombuffer(row["owners"], np.uint16)
                names.append(row["piece"])
                known = np.isin(values, hot) if len(hot) else None
                if known is not None and known.any():
                    passed.append((row["piece"], False, values[known].tobytes(), owners[known].tobytes(), np.full(known.sum(), frequent, "<u2").tobytes()))
                    values, owners = values[~known], owners[~known]
                held.append((values, owners, np.full(len(values), len(names) - 1, np.int64)))
                n_held += len(values)
            if passed:
                yield _sent(passed)
            if n_held > limit:
                out, held = settled(False)
                n_held = len(held[0][0])
                limit = max(limit, 2 * n_held)
                if len(out[0]):
                    yield _by_piece(*out, names)
        if n_held:
            out, _ = settled(True)
            if len(out[0]):
                yield _by_piece(*out, names)

    return run


def sent_back(dealt, most, frequent):
    """SHARED rows of a table of DEALT rows."""
    return dealt.groupBy("block").applyInArrow(repeated(most, frequent), SHARED)


def of_piece(table):
    """(head, numbers, owners, counts) of the SHARED rows of one piece."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["head"])
    rest = [r for r in rows if not r["head"]]
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rest]) if rest else np.empty(0, kind)
    return (head["data"], head["owners"]), join("data", np.uint64), join("owners", "<u2"), join("counts", "<u2")
