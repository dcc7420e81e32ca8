import random

from cytomix.llm.components import components


def brute(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in list(root)}


def test_paths_stars_and_random_graphs(spark):
    rnd = random.Random(6)
    order = rnd.sample(range(1000, 1200), 200)
    pairs = list(zip(order, order[1:]))  # a shuffled path
    pairs += [(5000, 5001 + i) for i in range(300)] + [(6000 + i, 5999) for i in range(50)]
    pairs += [(rnd.randrange(9000, 9300), rnd.randrange(9000, 9300)) for _ in range(220)]
    pairs += [(7, 7), (None, 3), (2, 1), (1, 2)]
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()
    assert dict(map(tuple, got)) == brute(pairs) and len(got) == len(brute(pairs))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
