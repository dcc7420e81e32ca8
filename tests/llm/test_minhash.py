import random

from cytomix.llm.minhash import near_duplicates, shingles


def brute(rows, width, percent):
    sets = {i: set(shingles(t, width).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "É é"), (6, "é é")]
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.randint(8, 300))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((100 + len(rows), " ".join(copy)))
    rows.append((9999, "word " * 50000))
    return rows


def test_against_brute_force(spark):
    for width, percent in ((3, 85), (5, 80)):
        rows = corpus()
        got = near_duplicates(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, id int").repartition(5), width, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, width, percent)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got.collect()) == [(-1, 1, True), (1, 1, True), (1, 1, True)]
