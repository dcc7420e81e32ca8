import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cytomix.llm import suffixes
from cytomix.llm.suffixes import remove_repeats, repeated, sorted_suffixes


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_order(data):
    text = np.frombuffer(data, np.uint8)
    order = sorted_suffixes(text, np.arange(len(text)), 128)
    padded = data + bytes(400)
    assert sorted(order.tolist()) == list(range(len(data)))
    keys = [padded[i : i + 128] for i in order]
    assert keys == sorted(keys)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=20, max_size=200).map(lambda b: bytes(x % 2 for x in b)))
def test_repeated(data):
    text = np.frombuffer(data, np.uint8)
    starts = np.arange(len(text) - 11)
    seen = [data[i : i + 12] for i in starts]
    assert repeated(text, starts, 12)[: len(starts)].tolist() == [seen.count(s) > 1 for s in seen]


def brute(texts, length):
    from collections import Counter

    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)
        yield len(d), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)

    def prose(n):
        return "".join(rnd.choice("abcdé \n") for _ in range(n))

    shared = [prose(rnd.randint(150, 600)) for _ in range(8)]
    texts = [None, "", prose(199), "a" * 3000, "ab" * 150 + "c", prose(60000)]
    for _ in range(60):
        texts.append(prose(rnd.randint(0, 400)) + rnd.choice(shared)[rnd.randint(0, 40) :] + prose(rnd.randint(0, 300)) + rnd.choice(shared) + prose(rnd.randint(0, 99)))
    texts += [texts[10]] * 5 + [texts[11][:-1] + "x", texts[12] + texts[12]]
    docs = spark.createDataFrame([(i, t, b"k") for i, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(6)
    want = list(brute(texts, 200))
    for most, keys in ((256, 2048), (3, 2048), (3, 2)):
        monkeypatch.setattr(suffixes, "CHUNK_PASSAGES", most)
        monkeypatch.setattr(suffixes, "KEYS_MOST", keys)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert remove_repeats(docs.limit(0)).count() == 0
