import random

import numpy as np
import pytest
import sentencepiece

from cytomix.llm import pieces as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rnd = random.Random(9)
    texts = ["", " ", "  ", "a", " a", "a  b   ", "é𝒳\x00", "x\ty\n\nz", "<s> <unk> <0x0A>", "a" * 5000, "lo" * 3000 + "梦" * 100, "▁x ▁", "नमस्ते दुनिया", "word " * 3000]
    return texts + ["".join(rnd.choice("abtheing  é\n.,0🙂") for _ in range(rnd.randint(1, 300))) for _ in range(300)]


def test_same_ids_as_the_library(spark, library):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = odd_texts() + given
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(-1, None, [2])], "doc_id long, text string, ids array<int>").repartition(8)
    rows = P.decode(P.encode(docs, MODEL), MODEL).collect()
    got = {r.doc_id: r for r in rows}
    assert got[-1].ids is None and got[-1].decoded is None and got[-1].n_ids == 0
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t) and got[i].n_ids == len(got[i].ids), repr(t[:80])
        assert got[i].decoded == library.decode(got[i].ids) and (got[i].decoded == t or P.SPACE in t)


def test_memory_bound_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 20)
    lattice, texts = P.Lattice(P.Vocabulary(MODEL)), odd_texts()
    for i in range(0, len(texts), 10):
        ids, counts = lattice(texts[i : i + 10])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts[i : i + 10])


def test_viterbi_is_the_best_path():
    v = P.Vocabulary(MODEL)
    rnd = random.Random(2)
    v.score = np.array([-rnd.random() * 9 - 1 for _ in v.text])
    v.merges = False
    lattice = P.Lattice(v)
    for word in ("theing", "▁under", "stand", "xyzabc"):
        def best(w):
            if not w:
                return 0.0, ()
            return max((v.score[v.ids[w[:n]]] + s, (n, *p)) for n in range(1, len(w) + 1) if w[:n] in v.ids for s, p in [best(w[n:])])

        found = lattice.viterbi(lattice.edges([word]))[0]
        assert tuple(found[found > 0].tolist()) == best(word)[1] == tuple(lattice._long(word))


def test_empty_table(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
