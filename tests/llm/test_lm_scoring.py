"""Scores against a plain model with the same weights, and what the weights are worth on held-out text."""
import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import lm_scoring

END = "\n"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def plain(rows, weights):
    trained = [(fold(i), tokens(t)) for i, t in rows]
    words, pairs = collections.Counter(), collections.Counter()
    for f, found in trained:
        if f != 2:
            words.update(found)
            pairs.update(zip([END] + found[:-1], found))
    n, v = sum(words.values()), len(words)
    out = []
    for (i, _), (f, found) in zip(rows, trained):
        total = 0.0
        for context, word in zip([END] + found[:-1], found):
            c = words[context]
            a = weights[min(int(math.log2(c + 1)), lm_scoring.OCTAVES)]
            total += math.log10(a[0] * pairs[context, word] / max(1, c) + a[1] * words[word] / max(1, n) + a[2] / (v + 1))
        out.append((i, f == 2, len(found), sum(words[w] > 0 for w in found), n,
                    sum(math.log10((words[w] + 1) / (n + v + 1)) for w in found), total))
    return out


def same(got, wanted):
    def key(r):
        return (str(r[0]), r[2], round(r[5], 4))

    got, wanted = sorted(got, key=key), sorted(wanted, key=key)
    assert [tuple(r[:5]) for r in got] == [tuple(r[:5]) for r in wanted]
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in wanted], rtol=1e-9)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    model, _ = lm_scoring.train(docs.select(lm_scoring._folds(F.col("doc_id")).cast("int").alias("fold"), F.col("text").alias("body")))
    return [tuple(r) for r in lm_scoring.score(docs).collect()], model


@pytest.mark.parametrize("hot,heavy", [(1 << 20, 1 << 16), (40, 50), (0, 10)])
def test_scores_match_a_plain_model(spark, monkeypatch, hot, heavy):
    for name, value in (("HOT", hot), ("HEAVY", heavy), ("BLOCK_TOKENS", 20_000), ("FOLD_BYTES", 40_000)):
        monkeypatch.setattr(lm_scoring, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(80).collect()]
    rows += [(500, None), (501, ""), (None, "of the"), (3, rows[3][1]), (3, rows[3][1]), (3, "another text"), (502, "once " * 5000)]
    got, model = run(spark, rows)
    same(got, plain(rows, model.weights))


def test_empty_and_untrained_tables(spark):
    assert run(spark, [])[0] == []
    held = [i for i in range(100) if fold(i) == 2][:2]
    got, model = run(spark, [(held[0], "a b"), (held[1], None)])
    same(got, plain([(held[0], "a b"), (held[1], None)], model.weights))


def test_context_helps_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    row = lm_scoring.score(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert row[0] > row[1] + 0.3


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(0)
    cells = lm_scoring._cells(np.array([0.5, 0.001]))
    n = rng.multinomial(100_000, [0.7 * 0.5 + 0.3 * 0.001, 0.65])
    table = {"bucket": np.array([4, 4]), "cell2": np.array([cells[0], 0]), "cell1": np.array([cells[1], cells[1]]), "n": n}
    weights = lm_scoring.learn(table, 10 ** 6)
    assert np.allclose(weights.sum(axis=1), 1) and weights[4, 0] > 0.3 and np.allclose(weights[7], 1 / 3)
