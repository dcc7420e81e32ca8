import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytomix.llm import divergence as D
from cytomix.llm.common import runs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least):
    docs = [(lang or "", source or "", found(text)) for lang, source, text in rows]
    n, own = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        n.update((lang, w) for w in set(words))
        own[lang, source].update(words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((w for (x, w), c in n.items() if x == lang and c >= least), key=str.encode)
        groups = {s: c for (x, s), c in own.items() if x == lang}

        def rate(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: rate(c) for s, c in groups.items()}, rate(sum(groups.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s]
            words = [(-gap(p[s][w], q[w]), w.encode()) for w in kept if groups[s][w] > 0 and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:10])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["ÄRGER", "Ärger", "日本", "naïve", "𝒳𝒴"]
    rows = [(("en", "de", None, "xx")[i % 7 % 4], ("a", "b", "ü", None)[i % 5 % 4], " ".join(rnd.choice(words, 40)) + f" THE The the{i % 3} a_b x-y") for i in range(400)]
    rows += [("en", "none", None), ("en", "none", ""), ("en", "blank", "12 34 \x00 _ -"), ("zz", "p", "rare words here"), ("zz", "q", None), (None, None, None), ("fr", "x", "tie " * 3)]
    return rows + [("en", "a", "again and again and more")] * 12 + [("en", "long", "word other " * 200_000)]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], "lang string, source string, text string, rank int, term int").repartition(6)
    got = [tuple(r) for r in D.audit(docs).collect()]
    want = brute(rows, 10)
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert {r[3] for r in want if r[:3] == ("zz", "p", "pair")} == {"q"} and ("zz", "p", "pair", "q", 0, 1) in want


def test_counts_that_travel_give_the_same(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert {tuple(r) for r in D.audit(docs, index_bytes=0).collect()} == brute(rows, 10)


def test_tasks_that_hand_counts_on_early_give_the_same(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    monkeypatch.setattr(D, "HELD_TERMS", 50)
    monkeypatch.setattr(D, "HELD_SLOTS", 60)
    assert {tuple(r) for r in D.audit(docs).collect()} == brute(rows, 10)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 257, 900])
def test_perfect_hash_is_minimal_and_tells_strangers(n):
    keys = [f"key{i}".encode() for i in range(n)]
    moves, slot = D.perfect_hash("en", keys)
    assert sorted(slot) == list(range(n))
    stored = [k.decode() for k in np.asarray(keys, object)[np.argsort(slot)]]
    look = D.Lookup("en", 1, [(0, list(moves), stored)])
    assert list(look(keys)) == list(slot) and set(look([b"stranger", b"", b"key" + b"9" * 9])) == {-1}


def test_rates_are_exact_for_large_counts():
    counts = np.array([[0, 1, 7, 10**15, 8 * 10**15]], np.int64)
    total = int(counts.sum())
    assert D.rates(counts, np.array([total]), 5)[0].tolist() == [1 + 10**9 * (int(c) + 2) // (total + 10) for c in counts[0]]


def test_runs_keep_words_whole():
    text = b"ab cde\tf\ng " * 50 + b"x" * 100 + b" y"
    for size in (1, 7, 64, 10_000):
        assert b"".join(runs(text, size)) == text and [w for r in runs(text, size) for w in r.split()] == text.split()


def test_tallies_count_each_pair_once_a_run(monkeypatch):
    texts = [("x", "Ab ab_cd\x00É", 1), ("y", None, 2), ("x", "", 3), ("x", "ab 12 ab", 4), ("y", "日本 ab " * 40, 5)]
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": (text or "").encode()} for lang, text, _ in texts])
    for held in (1, 4, 1000):
        monkeypatch.setattr(D, "HELD_TERMS", held)
        for once in (False, True):
            got = Counter()
            for keys, words, key, word, n in D.tallies(iter([batch]), ["lang"], once):
                pairs = [(keys[k][0], words[w].as_py()) for k, w in zip(key, word, strict=True)]
                assert len(pairs) == len(set(pairs)) and list(key) == sorted(key)
                got.update(dict(zip(pairs, n.tolist(), strict=True)))
            assert got == Counter((lang, w) for lang, text, _ in texts for w in (set(found(text)) if once else found(text)))


def test_rows_handed_on_do_not_grow_with_tasks_times_terms(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD", 4)
    monkeypatch.setattr(D, "SECTIONS", 3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs = spark.createDataFrame([("en", "ab"[i % 2], " ".join(words).encode()) for i in range(40)], "lang string, source string, text binary").repartition(4)
    shards = D.index(spark.createDataFrame([("en", w) for w in words], "lang string, term string"))
    index = D.Lookup("en", 100, [(r["shard"], r["moves"], r["terms"]) for r in shards.collect()])
    assert D.section_counts(docs, spark.sparkContext.broadcast({"en": index})).count() <= 4 * 2 * 3
    got = D.group_counts(docs, shards).select("source", "shard", F.explode(F.arrays_zip("slots", "n")).alias("c")).groupBy("source", "shard", "c.slots").agg(F.sum("c.n").alias("n")).collect()
    assert len(got) == 2 * len(words) and {r["n"] for r in got} == {20}
