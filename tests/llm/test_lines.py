import re

import numpy as np
import xxhash
from cytomix.llm.lines import DEPTH, NEAR, PASSAGE, SIMILAR, SKETCH, WIDTH, WORDS, close, drop_recurring


def likeness(a, b):
    """What two texts have in common, on the SKETCH smallest hashes of their shingles."""

    def hashes(text):
        words, out = text.lower().split(), set()
        for i in range(max(len(words) - WIDTH, 0) + 1):
            h = 42
            for w in words[i : i + WIDTH]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            out.add((h + 2**63) % 2**64 - 2**63 >> 32)
        return out

    a, b = hashes(a), hashes(b)
    union = set(sorted(a | b)[:SKETCH])
    return len(a & b & union) / len(union)


def brute(rows, least, groups=None, copy_share=2.0):
    """The same rules over plain dictionaries: templates, attachment to those that recur, leaders among the rest, passages, and copies that groups (id to group) names or that are alike. Ties go to the lesser wording."""

    def masked(line):
        return [("<*>" if re.search(r"[0-9@]", w) or re.match(r"[A-Za-z]{1,10}://", w) else w) for w in line.split()]

    def form(line):
        t = masked(line)
        words = len(t) - t.count("<*>")
        told = words >= WORDS * len(t)
        return ((len(t), tuple(t[:DEPTH])) if told else (line,), tuple(t if told else line.split()), words > PASSAGE)

    def shared(a, b):
        return len(set(a) & set(b))

    def led(rows, share):
        """rows (docs, id, size, f) to their leaders."""
        leads, to = [], {}
        for _, name, size, f in sorted(rows, key=lambda r: (-r[0], r[1])):
            lead = next((x for x in leads if shared(f, x[1]) >= share * size), None)
            if lead is None:
                leads.append((name, f))
        for _, name, size, f in rows:
            to[name] = next(x[0] for x in leads if x[0] == name or shared(f, x[1]) >= share * size)
        return to

    docs = {(i, t): [form(x) if x.split() else None for x in t.split("\n")] for i, t in rows if t is not None}
    forms, passages = {}, set()
    for d, ls in docs.items():
        for leaf, t, passage in filter(None, ls):
            forms.setdefault(leaf, {}).setdefault(t, set()).add(d)
            passages |= {(leaf, t)} if passage else set()
    first = {}
    for leaf, own in forms.items():
        fixed = {}
        for t, ds in own.items():
            for i, w in enumerate(t):
                fixed[i, w] = fixed.get((i, w), 0) + len(ds)
        templates = {}
        for t in own:
            f = tuple((i, w) for i, w in enumerate(t) if fixed[i, w] >= least)
            if f and len(f) >= SIMILAR * len(t):
                templates.setdefault(f, []).append(t)
        count = {f: len(set().union(*(own[t] for t in ts))) for f, ts in templates.items()}
        size = {f: len(ts[0]) for f, ts in templates.items()}
        to, loose = {f: f for f in templates if count[f] >= least}, []
        for f in (f for f in templates if count[f] < least):
            near = [(shared(f, g), count[g], g) for g in to if count[g] >= least and shared(f, g) >= SIMILAR * size[f]]
            if near:
                to[f] = max(near)[2]
            else:
                loose.append((count[f], f, size[f], f))
        if sum(x[0] for x in loose) >= least:
            to |= led(loose, SIMILAR)
        often = {}
        for f, g in to.items():
            for t in templates[f]:
                often.setdefault(g, []).append(t)
        for ts in often.values():
            ds = set().union(*(own[t] for t in ts))
            if len(ds) >= least:
                first |= {(leaf, t): (min(ds)[0], True) for t in ts}
        rest = [(len(own[t]), t, len(t), tuple(enumerate(t))) for t in own if (leaf, t) in passages and (leaf, t) not in first]
        heads = {}
        for t, g in led(rest, NEAR).items():
            heads.setdefault(g, []).append(t)
        for ts in heads.values():
            if sum(len(own[t]) for t in ts) >= 2:
                first |= {(leaf, t): (min(d[0] for t in ts for d in own[t]), False) for t in ts}
    out, of, texts = {}, lambda i: (groups or {}).get(i, i), dict(rows)
    for (i, t), ls in docs.items():
        gone = lambda m: m and (at := first.get(m[:2])) and at[0] != i and (at[1] or (of(i) != of(at[0]) and (copy_share > 1 or likeness(t, texts[at[0]]) < copy_share)))  # noqa: B023, E731
        keep = [x for x, m in zip(t.split("\n"), ls, strict=True) if not gone(m)]
        out[i] = ("\n".join(keep), len(ls), len(ls) - len(keep))
    return out


def test_against_brute_force(spark):
    rows = [(i, f"own words of text {chr(97 + i)} here{chr(97 + i)} and more\nPosted on 2024-01-{i:02d} by user{i} at http://x.y/{i}\n\nAll rights reserved by the owner {'now' if i % 2 else 'then'} forever more\n only {chr(97 + i) * 3} ") for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "x" * 200_000), (54, "All rights reserved by the owner\n" * 40)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring(docs, 5).collect()}
    want = brute(rows, 5)
    assert got.pop(50) == (None, 0, 0) and got == want
    assert got[3][2] >= 2 and got[0][2] == 0


def test_edges(spark):
    assert drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = drop_recurring(spark.createDataFrame([(None, "a b")] * 3, "doc_id long, text string"), 2)
    assert [(r.text, r.n_dropped) for r in got.collect()] == [("a b", 0)] * 3


def test_passages_recur_from_two_documents(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    passage, near = " ".join(words), " ".join([*words[:30], "changed", *words[31:]])
    far = " ".join([*words[:30], *(f"other{w}" for w in words[30:])])
    rows = [(1, f"one\n{passage}"), (2, f"two\n{passage}\nmore"), (3, f"three\n{near}"), (4, f"four\n{far}"), (5, "short line of few words"), (6, "short line of few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_recurring(docs, 5).collect()}
    assert got == dict(rows) | {2: "two\nmore", 3: "three"}
    copies = spark.createDataFrame([(2, 1)], "id long, group long")
    got = {r.doc_id: r.text for r in drop_recurring(docs, 5, copies=copies).collect()}
    assert got == dict(rows) | {3: "three"}


def test_passages_stay_in_whole_copies(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i * 7919))
    line = lambda k, n=60: " ".join(word(100 * k + j) for j in range(n))
    changed = lambda k, at: " ".join(word(9000 + j) if j == at else w for j, w in enumerate(line(k).split()))
    rows = [(i, "\n".join(line(10 * i + k) for k in range(4))) for i in range(3)]
    rows += [(10, "\n".join([changed(0, 30), *(line(k) for k in (1, 2, 3))])), (11, "\n".join([line(0), line(50), line(51), line(52)])), (12, rows[1][1]), (12, rows[1][1])]
    rows += [(13, "\n".join(line(k, 400) for k in (60, 61))), (14, "\n".join(line(k, 400) for k in (60, 61)) + "\nand more"), (15, None), (16, ""), (17, "\x00\ta\u00c9\u0130 \x0bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring(docs, 5, copy_share=0.5).collect()}
    want = brute(rows, 5, copy_share=0.5)
    assert got.pop(15) == (None, 0, 0) and got == want
    assert [got[i][2] for i in (0, 10, 11, 12, 13, 14)] == [0, 0, 1, 0, 0, 0]
    assert got[11][0] == rows[4][1].split("\n", 1)[1]
    assert {r.doc_id: r.n_dropped for r in drop_recurring(docs, 5).collect()}[12] == 4


def test_lines_are_attached_to_the_nearest_template(spark):
    # ids 7 and 8 change a word that others fix; in the second leaf, each value is common but no combination is
    rows = [(i, f"own{chr(97 + i)}\nread the terms of use on our site before you post") for i in range(6)]
    rows += [(7, "read the terms of use on our page before you post"), (8, "read the terms of those on our site before you post")]
    names, places = "Ann Bob Cem Dee Eva".split(), "Rome Oslo Bern Kiev Lima".split()
    rows += [(20 + 5 * i + j, f"we hope that you meet {a} soon in {b} as was planned before") for i, a in enumerate(names) for j, b in enumerate(places)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {i: int(i not in (0, 20)) for i, _ in rows}


def test_lines_of_variable_fields_recur_only_as_they_stand(spark):
    rows = [(i, f"own{chr(97 + i)}\n{i} {i * 7} {i}.5 http://x.y/{i}\nTotal {i} {i * 3} {i * 5}\n10 20 30\nPage {i}") for i in range(8)]
    got = {r.doc_id: r.text for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {i: t if i == 0 else t.replace("\n10 20 30", "").replace(f"\nPage {i}", "") for i, t in rows}


def test_documents_of_a_template_are_counted_once(spark):
    # two documents with three wordings each are not five documents
    rows = [(i, f"own{chr(97 + i)}\n" + "\n".join(f"we hope that you meet {n} soon as was planned before" for n in names)) for i, names in enumerate((("Ann", "Bob", "Cem"), ("Dee", "Eva", "Fay")))]
    rows += [(9, "we hope that you meet Gus soon as was planned before"), (10, "nothing else at all")]
    got = {r.doc_id: r.text for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == dict(rows)
    more = [*rows, (11, "we hope that you meet Hal soon as was planned before"), (12, "we hope that you meet Ida soon as was planned before")]
    got = {r.doc_id: r.n_dropped for r in drop_recurring(spark.createDataFrame(more, "doc_id long, text string"), 5).collect()}
    assert got == {0: 0, 1: 3, 9: 1, 10: 0, 11: 1, 12: 1}


def test_any_column_name_may_be_in_the_input(spark):
    docs = spark.createDataFrame([(i, "one and the same line of words\nown", *range(7)) for i in range(6)], "doc_id long, text string, _key int, _gone int, row int, key int, gone int, flags int, leaf int")
    got = drop_recurring(docs, 5).collect()
    assert all(tuple(r)[2:9] == tuple(range(7)) for r in got) and [r.n_dropped for r in sorted(got)] == [0, 2, 2, 2, 2, 2]


def test_many_lines_take_linear_time(spark):
    text = "\n".join(["one and the same line of words", "other"] * 40_000)
    docs = spark.createDataFrame([(i, text if i < 2 else "one and the same line of words") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in drop_recurring(docs, 5).collect()}
    assert got[1] == (80_000, 40_000) and got[5] == (1, 1)


def test_passages_of_one_leaf_that_share_no_segment_are_not_compared(spark):
    words = lambda i, n: " ".join(f"{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i * 11 + k * k) % 26)}x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for k in range(n))
    rows = [(i, f"one and the same beginning of {words(i, 60)}") for i in range(3000)]
    near = [(5000 + i, " ".join([*rows[i][1].split()[:-1], "changed"])) for i in range(5)]
    docs = spark.createDataFrame(rows + near, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in drop_recurring(docs, 5).collect()}
    assert {i for i, n in got.items() if n} == {i for i, _ in near}
    f = spark.createDataFrame([(1, i, 1, 66, t.split()) for i, t in rows + near], "leaf long, id long, docs long, of int, f array<string>")
    assert {r.id for r in close(f, NEAR).collect()} == {i for i, _ in near} | set(range(5))


def test_no_alike_rows_are_left_apart(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for n in (51, 57, 60, 64):
        base = rnd.integers(0, 10**6, n)
        for i in range(25):
            t = base.copy()
            t[rnd.choice(n, rnd.integers(0, 9), replace=False)] = rnd.integers(10**6, 2 * 10**6)
            rows.append((n, 1000 * n + i, 1, n, [f"{k}:{v}" for k, v in enumerate(t)]))
    got = {r.id for r in close(spark.createDataFrame(rows, "leaf long, id long, docs long, of int, f array<string>"), NEAR).collect()}
    want = {a[1] for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and len(set(a[4]) & set(b[4])) >= NEAR * a[3]}
    assert want and want <= got
