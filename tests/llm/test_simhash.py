import hashlib
import random

from cytomix.llm import simhash
from cytomix.llm.simhash import edited_fingerprints, fingerprint, likeness, near_counts, within_radius


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"wörd{i}" for i in range(3000)]
    rows = [(i * 3, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 300)))) for i in range(5000)]
    rows += [(7, None), (8, ""), (10, "x" * 200_000), (11, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, id string").repartition(7)
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    near = []
    for (i, text), (_, follow) in zip(order, order[1:] + order[:1], strict=True):
        text, follow = text or "", follow or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text).tobytes().hex())
        assert r.near_edited == likeness(fingerprint(text), fingerprint(edited)) and r.near_next == likeness(fingerprint(text), fingerprint(follow))
        near.append(r.near_edited > r.near_next or len(text) < 100)
    assert sum(near) > 0.99 * len(near)


def test_small_tables(spark):
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert edited_fingerprints(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).head().near_next == 1.0
    assert edited_fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")).count() == 3


def test_radius_search_finds_all(spark, monkeypatch):
    rnd = random.Random(1)
    marks = []
    for i in range(40):
        base = rnd.getrandbits(256)
        for j in range(4):
            for k in range(rnd.randint(0, 9)):
                base ^= 1 << rnd.randrange(256)
            marks.append((100 * i + j, f"{base:064x}"))
    marks += [(9000, marks[0][1]), (9001, None)]
    pairs, members = within_radius(spark.createDataFrame(marks, "doc_id long, fingerprint string"))
    heads = {}
    for i, m in sorted(x for x in marks if x[1]):
        heads.setdefault(m, i)
    want = {(a, b) for x, a in heads.items() for y, b in heads.items() if a < b and (int(x, 16) ^ int(y, 16)).bit_count() <= 6}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert dict(map(tuple, members.collect()))[9000] == marks[0][0]
    bits = [int(m, 16) for _, m in marks if m]
    want = {m: sum((int(m, 16) ^ x).bit_count() <= 6 for x in bits) - 1 for _, m in marks if m}
    for part in (1000, 3):
        monkeypatch.setattr(simhash, "PART", part)
        assert dict(map(tuple, near_counts(spark.createDataFrame(marks, "doc_id long, fingerprint string"), 6).collect())) == want
    assert near_counts(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0
