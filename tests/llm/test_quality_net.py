"""Quality network: units, contexts and pooling against plain loops, accuracy on held-out documents, defined results at the edges."""
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import quality_net as q

TEXTS = ["The cat, THE dog!! 42 $$$ üé", "a a  a\n\tb", "", None, "x" * 50_000, "one two three four five six " * 40]


def plain_units(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode() for w in words]

    def shape(word):
        out = []
        for c in word.encode():
            kind = "a" if 97 <= c <= 122 or c > 127 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
            if not out or out[-1] != kind:
                out.append(kind)
        return "".join(out).encode()

    return [crc32(w) % q.WORD_ROWS for w in lower], [crc32(shape(w)) % q.SHAPE_ROWS + q.WORD_ROWS for w in words]


def plain_sums(texts):
    axes, signs = q.random_vectors()
    total = np.zeros((q.ROWS, q.AXES))
    for text in texts:
        words, shapes = plain_units(text)
        for i in range(len(words)):
            for j in range(max(0, i - q.WINDOW), min(len(words), i + q.WINDOW + 1)):
                if i != j:
                    for near in (words[j], shapes[j]):
                        for target in (words[i], shapes[i]):
                            total[target][axes[near]] += signs[near]
    return total


@pytest.mark.parametrize("text", TEXTS)
def test_units(text):
    words, shapes = q.unit_rows(text)
    assert (list(words), list(shapes)) == plain_units(text)


def test_slices_change_nothing(monkeypatch):
    units = [q.unit_rows(t) for t in TEXTS]
    gap = np.full(q.WINDOW, -1, np.int64)
    words, shapes = (np.concatenate([x for u in units for x in (u[k], gap)]) for k in (0, 1))
    for size in (7, 1 << 15):
        monkeypatch.setattr(q, "SLICE", size)
        total = np.zeros((q.ROWS, q.AXES), np.int64)
        q.add_contexts(total, words, shapes, q.dense_vectors())
        assert (total == plain_sums(TEXTS)).all()


def test_vectors_are_those_of_plain_loops(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    got = q.word_vectors(df)
    sums, n = plain_sums(TEXTS), np.zeros(q.ROWS)
    for text in TEXTS:
        for row in sum(plain_units(text), []):
            n[row] += 1
    wanted = np.zeros((q.ROWS, q.AXES))
    wanted[n > 0] = sums[n > 0] / np.maximum(np.linalg.norm(sums[n > 0], axis=1, keepdims=True), 1e-9)
    wanted[n > 0] -= n @ wanted / n.sum()
    assert np.allclose(got, wanted, atol=1e-6)
    x = q.pooled(TEXTS[0], got, got * got)
    words, _ = plain_units(TEXTS[0])
    assert np.allclose(x[:q.AXES], got[words].mean(0), atol=1e-6) and np.allclose(x[q.AXES:2 * q.AXES], got[words].std(0), atol=1e-4)


def test_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = q.score_quality(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    seen = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in seen if r.quality == 1], [r.score for r in seen if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9 and np.mean([r.predicted == r.quality for r in seen]) > 0.9
    loss = np.mean([-np.log(np.clip(r.score if r.quality else 1 - r.score, 1e-9, 1)) for r in seen])
    assert loss < 0.35
    # Labels of held-out documents change nothing, nor do the other columns.
    other = q.score_quality(docs.select("doc_id", "text", F.lit("de").alias("lang"), F.lit(1.0).alias("score")),
                            labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert out.join(other.withColumnRenamed("score", "again"), "doc_id").where("abs(score - again) > 1e-9").count() == 0


def test_edges(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "word " * 30_000), (4, "x y"), (4, "x y"), (5, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")
    out = q.score_quality(docs, labels).collect()
    assert len(out) == len(rows) and {round(r.score, 9) for r in out} == {0.5}
    assert {(r.doc_id, r.held_out) for r in out} == {(d, d is not None and crc32(str(d).encode()) % 5 == 0) for d, _ in rows}
    one = q.score_quality(docs, spark.createDataFrame([(n, 1) for n in (1, 2, 3, 4, 5)], "doc_id long, quality int")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5 and {r.predicted for r in one} == {1}
    assert q.score_quality(docs.limit(0), labels).collect() == []
