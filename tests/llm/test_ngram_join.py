"""Near copies against brute force over all pairs."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsift.llm import arrays, dealing, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    found = words(text)
    return {tuple(found[i:i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def brute(rows, percent=75):
    """component of each row by union of all linked pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted(((doc, len(sets[i]), smallest.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, size=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=14)
    texts = []
    for _ in range(size):
        kind = rng.random()
        if kind < 0.35 or not texts:
            body = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 20, 60])) + (passage if rng.random() < 0.4 else [])
        else:
            body = rng.choice(texts[:12] if kind < 0.7 else texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                i = rng.randrange(len(body) + 1)
                body[i:i + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        texts.append(" ".join(body))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n\t"), (None, texts[0]), (None, "lone words of nobody at all"), (7, texts[7]), (7, "other text"), (903, texts[3].upper())]


def got(spark, rows, **options):
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, class string").repartition(3)
    out = ngram_join.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_supplied_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile", [2, 2_000])
def test_every_link_between_classes_is_returned(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(300)], k=80)
    rows = [(10_000 + i, " ".join(base[:i + 60] + [f"own{i}"])) for i in range(12)] + [r for r in corpus(3, 90) if r[0] is not None and r[0] != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named = {r.doc_id: r["class"] for r in ngram_join.near_duplicates(docs).collect()}
    sets = {named[doc]: shingles(text) for doc, text in rows if words(text)}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    found = [tuple(r) for r in ngram_join.class_links(docs).collect()]
    assert sorted(found) == sorted(wanted) and len({c for c in wanted if set(c) <= {named[10_000 + i] for i in range(12)}}) > 12
    counts = {r["class"]: r.n_links for r in ngram_join.link_counts(docs).collect()}
    assert counts == {c: sum(c in pair for pair in wanted) for pair in wanted for c in pair}
    assert ngram_join.class_links(docs.limit(0)).collect() == []


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for values in ([5], [0, 1 << 63], [7, 7, 7], sorted(rng.integers(0, 1 << 63, 200).tolist()), [(1 << 64) - 1]):
        values = np.array(values, np.uint64)
        first, width, data = dealing.pack(values)
        assert (dealing.unpack(np.uint64(first), width, data) == values).all()


def test_a_block_sends_back_what_occurs_twice():
    rng = np.random.default_rng(2)
    pieces, batches = {}, []
    for k in range(9):
        values = np.sort(np.concatenate([rng.integers(0, 60, 40), np.full(12, 99)]).astype(np.uint64))
        owners = rng.integers(0, 50, len(values)).astype(np.uint16)
        pieces[f"p{k}"] = list(zip(values.tolist(), owners.tolist()))
        first, width, data = dealing.pack(values)
        rows = [(0, f"p{k}", True, None, None, b"head", b"sizes"), (0, f"p{k}", False, first, width, data, owners.tobytes())]
        names = [x.split(" ")[0] for x in dealing.DEALT.split(", ")]
        batches.append(pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows]))
    every = [v for rows in pieces.values() for v, _ in rows]
    for most in (30, 10_000):
        got, heads = {}, 0
        for batch in dealing.repeated(most, 20)(iter(batches)):
            for row in batch.to_pylist():
                heads += row["head"]
                if not row["head"]:
                    got.setdefault(row["piece"], []).extend(zip(np.frombuffer(row["data"], np.uint64).tolist(), np.frombuffer(row["owners"], np.uint16).tolist(),
                                                                np.frombuffer(row["counts"], "<u2").tolist()))
        assert heads == 9
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted((v, o, min(every.count(v), 20)) for v, o in rows if every.count(v) > 1) for k, rows in pieces.items()}


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 40)
    monkeypatch.setattr(ngram_join, "PIECE_SHINGLES", 150)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(dealing, "LARGEST", 1)
    rows = corpus(6, 120)
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 5)
    assert got(spark, rows) == brute(rows)


def test_blocks_and_pieces_grow_so_that_rows_stay_full():
    for total in (0, 10, 10 ** 6, 10 ** 9, 10 ** 12):
        blocks, block, piece = dealing.sizes(total)
        assert blocks * block >= total and piece * block >= 31 * total
    assert dealing.sizes(10 ** 14)[1:] == (dealing.LARGEST, dealing.LARGEST)


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = rng.choices([f"w{i}" for i in range(4000)], k=120_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[:100_000] + ["end"])), (3, " ".join(long[:40_000])), (4, "a " * 90_000), (5, "x" * 300_000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_one_row_of_each_group_stays(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(a, b, a, "x") for a, b in rows], "doc_id long, text string, place long, component string")
    kept = ngram_join.keep_one(docs).collect()
    assert ngram_join.keep_one(docs).columns == docs.columns
    groups = {}
    for (doc, n, group), in zip(brute(rows)):
        groups.setdefault((n > 0, group if n else None), []).append(doc)
    wordless = sum(1 for _, t in rows if not words(t))
    ids = [r.doc_id for r in kept if words(r.text)]
    assert len(kept) - len(ids) == wordless
    heads = {g for (has, g) in groups if has and g is not None}
    assert set(i for i in ids if i is not None) == heads


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, 1 << 10)
    rare_first = lambda found: found[np.lexsort((found, counts[found & np.uint64(1023)]))]
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 5)).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if not len(b) or 100 * same < 75 * (len(a) + len(b) - same):
            continue
        x, y = rare_first(a), rare_first(b)
        p, q = (ngram_join.prefix_length(len(s), 75) for s in (x, y))
        common = np.intersect1d(x[:p], y[:q])
        assert len(common)
        sx, sy = ngram_join.suffix_counts(x, p).view(np.uint64), ngram_join.suffix_counts(y, q).view(np.uint64)
        for s in common:
            i, j = int(np.flatnonzero(x == s)[0]), int(np.flatnonzero(y == s)[0])
            most = min(i, j) + 1 + min(len(x) - i, len(y) - j) - 1
            parts = sum(min(int(sx[i]) >> (16 * k) & 0xFFFF, int(sy[j]) >> (16 * k) & 0xFFFF) for k in range(4))
            assert same <= most and same <= min(i, j) + 1 + parts


def test_outlines_never_drop_a_link(spark):
    rng = np.random.default_rng(5)
    rows, same = [], {}
    for k in range(120):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.5, 0.85, 0.95])], rng.integers(0, 1 << 63, rng.integers(1, 30)).astype(np.uint64)]))
        taken = [len(s) - len(np.unique(s >> np.uint64(20) & np.uint64(1023))) for s in (a, b)]
        both = len(np.intersect1d(a, b))
        same[k] = 175 * both >= 75 * (len(a) + len(b))
        rows.append((k, *[(ngram_join.outline(s).tolist(), t, len(s)) for s, t in zip((a, b), taken)]))
    side = "struct<marks:array<long>,taken:int,size:int>"
    kept = {r.k for r in spark.createDataFrame(rows, f"k int, a {side}, b {side}").where(ngram_join.outlines_pass(75)).collect()}
    assert {k for k, link in same.items() if link} <= kept and len(kept) < len(rows) - 20
