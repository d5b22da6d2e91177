"""Merkle manifest against a plain recursion over the whole tree."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinsift.llm import merkle
from kinsift.llm.common import lower_ascii

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        start = at - at % fanout
        run = nodes[start:start + fanout]
        out.append((run[:at - start], run[at - start + 1:]))
        at //= fanout
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, fanout=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        members.append(own)
        trees.append(tree([leaf(r) for r in own], fanout))
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for k, own in enumerate(members):
        for i, row in enumerate(own):
            siblings = path(trees[k], i, fanout) + path(top, k, fanout)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            now = leaf((*row[:4], lowered(row[4]))) if tampered else leaf(row)
            for before, after in siblings:
                now = h(*before, now, *after)
            out.append((row[0], row[1], leaf(row), trees[k][-1][0], top[-1][0],
                        h(*[x for before, after in siblings for x in before + after]), now, now == top[-1][0]))
    return out


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS + ", leaf string, rank int").repartition(3)
    found = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(F.col("text")))}
    return merkle.manifest(df, found=found, **kwargs)


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("fanout, inner", [(2, 1), (3, 1), (2, 2), (16, 3)])
def test_manifest_is_the_plain_tree(spark, fanout, inner):
    draw = random.Random(fanout * 10 + inner)
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "Abc"), (1, "", "en", 0, ""), (2, "é", "de", 9, "ß🙂 Ü X"), (2, "é", "de", 9, "ß🙂 Ü X"),
            (2, "é", "de", 8, "other"), (3, "lone", None, 1, "Z" * 200_000)]
    rows += [(draw.randrange(-50, 5000), "hot", "en", n, f"Text {n}") for n in range(60)]
    rows += [(n, f"s{n % 5}", "fr", n, f"A {n}") for n in range(23)]
    out = run(spark, rows, fanout=fanout, inner_levels=inner)
    assert key(tuple(r) for r in out.collect()) == key(plain(rows, fanout))
    changed = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] and lowered(r[4]) != r[4]]
    assert changed and out.where("not verified").count() == len(changed)


def test_one_row_and_none(spark):
    row = (7, "s", "en", 2, "ab")
    only = run(spark, [row]).collect()[0]
    assert only.leaf == only.subroot == only.root == leaf(row) and only.proof_sha256 == h() and only.verified
    assert run(spark, [row]).limit(0).count() == 0
    assert merkle.manifest(spark.createDataFrame([], FIELDS)).collect() == []


def test_found_is_optional_and_any_change_shows(spark):
    rows = [(n, "s", "en", n, f"t{n}") for n in range(40)]
    df = spark.createDataFrame(rows, FIELDS)
    assert {r.verified for r in merkle.manifest(df).collect()} == {True}
    out = merkle.manifest(df, found={"n_chars": F.when(F.col("doc_id") == 17, F.lit(18).cast("long"))})
    assert [r.doc_id for r in out.where("not verified").collect()] == [17]
