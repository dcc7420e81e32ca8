import zlib

import numpy as np
import pytest
from test_toxicity import auc

from cytomix.llm import quality as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = Q.fit(docs, labels)
    got = Q.score(docs.select("doc_id", "text", Q.held_out().alias("out")), model).join(labels, "doc_id").collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, r.quality) for r in got if r.out]
    assert auc(held) > 0.98
    assert sum((s >= Q.KEEP) == y for s, y in held) / len(held) > 0.98
    assert sum(s >= Q.KEEP for s, y in held if y) > 0.99 * sum(y for _, y in held)
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.015
    again = Q.fit(docs.repartition(7), labels)
    assert np.array_equal(model.vectors, again.vectors)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "so so " * 300_000, "c"), (4, "plain words", "d"), (4, "plain words", "d"), (5, "x" * 2_000_000, "e")], "doc_id long, text string, score string")
    for labels in ([], [(1, 1), (4, None), (4, 0), (2, 0), (None, 1), (5, 1)]):
        model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = Q.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert Q.score(docs.limit(0), model).count() == 0 and Q.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).vectors.any() == 0


def test_vectors_against_plain_sums(spark):
    texts = ["a b c, a b", "c c 12 a_b", None, ""]
    got = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    sums, n = np.zeros((Q.ROWS, Q.WIDTH)), np.zeros(Q.ROWS)
    sides = [Q._index_vectors(1), Q._index_vectors(2)]
    vector = lambda side, row: sum(s * np.eye(Q.WIDTH)[p] for p, s in zip(sides[side][0][row], sides[side][1][row], strict=True))
    for t in texts:
        rows = [zlib.crc32(w.encode()) % Q.ROWS for w in Q._TOKEN.findall(t or "")]
        for left, right in zip(rows, rows[1:]):
            sums[right] += vector(0, left)
            sums[left] += vector(1, right)
        for r in rows:
            n[r] += 1
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    want = np.where(n[:, None] > 0, unit - n @ unit / n.sum(), 0)
    assert np.allclose(got, want, atol=1e-6) and (n > 0).sum() >= 6


def test_pooling_of_long_texts_equals_that_of_all_tokens(monkeypatch):
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(Q.ROWS, Q.WIDTH)).astype(np.float32)
    text = " ".join(f"w{chr(97 + i)}" for i in rnd.integers(0, 26, 5000)).encode()
    whole = Q.pooled([text], vectors, Q.Rows())
    monkeypatch.setattr(Q, "TOKENS", 100)
    assert np.allclose(Q.pooled([text], vectors, Q.Rows()), whole, atol=1e-9)
    ids = np.concatenate(list(Q.token_rows(text, Q.Rows())))
    assert np.allclose(whole[0, : Q.WIDTH], vectors[ids].mean(0), atol=1e-5) and np.allclose(whole[0, Q.WIDTH : 2 * Q.WIDTH], vectors[ids].std(0), atol=1e-5)


@pytest.mark.parametrize("temperature", [0.5, 1.0, 3.0])
def test_calibration_finds_the_temperature(temperature):
    rnd = np.random.default_rng(4)
    logits = rnd.normal(0, 3, 200_000)
    y = (rnd.random(len(logits)) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(Q.calibrate(logits * temperature, y) - temperature) < 0.05 * temperature
