import re
from itertools import permutations

import numpy as np

from cytomix.llm import filters as T


def brute(docs, labels):
    fails, parts = [], {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, part, text in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs))
        fails.append(dict(zip("ABCDE", bits, strict=True)))
        parts.setdefault(part or "", []).append(len(fails) - 1)
    out = set()
    for part, rows in parts.items():
        removed_in = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in ("".join(p) for p in permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if fails[r][f]]
                stay = [r for r in left if not fails[r][f]]
                redundant = sum(fails[r][f] for r in rows) - len(gone)
                alone = sum(fails[r][f] and sum(fails[r].values()) == 1 for r in rows)
                lines.append((order, step, f, len(stay), len(gone), redundant, alone, sum(docs[r][0] in good for r in gone), sum(docs[r][0] in toxic for r in gone)))
                removed_in[f] += len(gone)
                left = stay
        out |= {(part, o, s, *rest, removed_in[f]) for o, s, f, *rest in lines}
    return out


def test_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    texts = [None, "", " ", "short text", "MANY CAPITALS HERE", "a|b", "é" * 300, " ".join(words[:250]), " ".join(words[:250]), " ".join(words[:3] * 100), " ".join(words[:250]) + " #", " ".join(words[:100] * 2), " ".join(words[:99] + words[:101]), "\x1c".join(words[:250]), "\x0b".join(words[:250]), "ABCD " + " ".join(words[:205])[:195], "x " * 300_000]
    docs = [(int(i), (None, "", "web", "books")[rnd.integers(4)], texts[rnd.integers(len(texts) - 1)]) for i in rnd.permutation(300)]
    docs += [(500, "one", texts[-1]), (501, "one", texts[-1]), (501, "one", texts[-1]), (501, "other", texts[-1]), (None, "one", "short text"), (None, "one", "short text"), (-5, "neg", "twice"), (-5, "neg", "twice")]
    labels = [(int(i), (0, 1, None)[rnd.integers(3)], (0, 1)[rnd.integers(2)]) for i in rnd.integers(0, 320, 150)] + [(501, 1, 0), (500, 0, 1), (500, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, source string, text string, fails int, n int").repartition(5)
    got = [tuple(r) for r in T.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert len(got) == len(set(got)) == 600 * len({d[1] or "" for d in docs}) and set(got) == brute(docs, labels)


def test_copies_of_one_text_meet_as_few_rows(spark):
    docs = spark.createDataFrame([(i, "s", "the same") for i in range(500)], "doc_id long, source string, text string")
    got = {(r.fails, r.n) for r in T.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {(1, 1), (17, 499)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert T.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_contraction_of_a_random_tensor():
    counts = np.random.default_rng(1).integers(0, 9, (2, 2, 2, 2, 2, 2))
    kept, removed, alone = T._selectors()
    at = T.ORDERS.index("CABED") * 5 + 2
    assert (T.contract(counts, kept)[:, at] == counts[:, 0, 0, 0].sum((1, 2))).all()
    assert (T.contract(counts, removed)[:, at] == counts[:, 0, 1, 0].sum((1, 2))).all()
    assert (T.contract(counts, alone)[:, at] == counts[:, 0, 1, 0, 0, 0]).all()
