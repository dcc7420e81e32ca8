import math
import random

import pytest

from cytomix.llm.mixing import mix, weighted


def weights(tokens, entropy=0.95, max_repeats=4.0):
    """By plain bisection over a dictionary of token counts."""
    have = {s: n for s, n in tokens.items() if n > 0}
    total = sum(have.values())

    def at(p):
        z = sum((n / total) ** p for n in have.values())
        return {s: (n / total) ** p / z for s, n in have.items()}

    def largest(good):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return 1.0 if good(1.0) else low

    often = lambda p: max(w * total / have[s] for s, w in at(p).items()) > max_repeats + 1e-9
    power = largest(lambda p: -sum(w * math.log(w) for w in at(p).values()) >= entropy * math.log(len(have)) - 1e-12) if have else 1.0
    if have and often(power):
        power = min(1.0, largest(often) + 1e-9)
    found = at(power) if have else {}
    return {s: found.get(s, 0.0) for s in tokens}


@pytest.mark.parametrize(("tokens", "entropy"), [({"a": 8000, "b": 1000, "c": 1000, "d": 0}, 0.95), ({"a": 99_000, "b": 10}, 1.0), ({"a": 0}, 0.95), ({"a": 5}, 0.95), ({}, 0.95), ({f"s{i}": 7**i for i in range(9)}, 0.7)])
def test_weights_are_those_of_plain_bisection(spark, tokens, entropy):
    got = {r.source: r.weight for r in weighted(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), entropy).collect()}
    assert got.keys() == tokens.keys() and all(abs(got[s] - w) < 1e-6 for s, w in weights(tokens, entropy).items())


def test_weights():
    w = weights({"a": 8000, "b": 1000, "c": 1000, "d": 0}, 0.95)
    have = [w["a"], w["b"], w["c"]]
    assert abs(sum(have) - 1) < 1e-9 and w["d"] == 0 and w["a"] > w["b"] == w["c"]
    assert abs(-sum(x * math.log(x) for x in have) - 0.95 * math.log(3)) < 1e-6
    w = weights({"a": 99_000, "b": 10}, 1.0, 4.0)
    assert w["b"] * 99_010 / 10 <= 4.001


def test_mix_spends_the_budget(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "big" if i % 3 else f"s{i % 12}", 1) for i in range(6000)] + [(9001, None, None, 2), (9002, "x " * 50000, "long", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int").repartition(6)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    tokens, used, most, part = {}, {}, {}, {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.copies
        most[r.source] = max(most.get(r.source, 0), r.n_tokens)
        part.setdefault(r.source, []).append((r.block, r.place, r.copies))
        assert r.n_tokens == len((next(t for i, t, *_ in rows if i == r.doc_id) or "").split()) if r.doc_id < 50 else True
    want = weights({s: t for s, t in tokens.items()})
    total = sum(tokens.values())
    for s, t in tokens.items():
        assert 0 <= used[s] - want[s] * total <= most[s] + 1e-6, s
        copies = [c for _, _, c in sorted(part[s])]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1
    assert mix(docs.limit(0)).count() == 0


def brute_copies(rows, plan, used):
    """Copies of each row by walking each source's rows in the order that block and place give."""
    out = {}
    for s, (weight, total, budget) in plan.items():
        due = weight * budget
        full = int(due // total) if total else 1
        left = due - full * total if total else 0.0
        for i, n in sorted(((r.block, r.place, r.doc_id), r.n_tokens) for r in rows if r.source == s):
            out[i[2]] = full + (used[s] < left)
            used[s] += n
    return out


def test_copies_against_a_walk_along_each_source(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(1, 30), f"s{i % 3 if i % 7 else 9}") for i in range(4000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    tokens = {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    w, budget = weights(tokens), sum(tokens.values())
    want = brute_copies(got, {s: (w[s], t, budget) for s, t in tokens.items()}, dict.fromkeys(tokens, 0))
    assert sum(want[r.doc_id] != r.copies for r in got) <= 1  # the last row, by rounding of the weights


def test_any_column_name_may_be_in_the_input(spark):
    names = "_source _part _end _full _blocks _stop row source_ range left end stop full blocks tokens n size".split()
    docs = spark.createDataFrame([(i, "a b c", "x", *range(len(names))) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mix(docs).collect()
    assert len(got) == 30 and all([r[n] for n in names] == list(range(len(names))) for r in got)
