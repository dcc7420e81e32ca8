import zlib

from cytomix.llm import toxicity as T


def auc(rows):
    good, bad = [s for s, y in rows if not y], [s for s, y in rows if y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(docs, labels)
    got = T.score(docs.select("doc_id", "text", T.held_out().alias("out")), model).join(labels, "doc_id").collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, r.toxic) for r in got if r.out]
    assert auc(held) > 0.97
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "you idiot" * 30000, "c"), (4, "plain words", "d")], "doc_id long, text string, score string")
    for labels in ([], [(1, 1), (4, None), (4, 0), (2, 0), (None, 1)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 for r in T.score(docs, model).collect())
    assert T.score(docs.limit(0), model).count() == 0
