import sentencepiece

import corpus_pipeline as C
from cytomix.llm import lines
from cytomix.llm.common import materialize
from test_lines import brute as brute_lines
from test_minhash import brute as brute_minhash
from test_mixing import weights as plain_weights

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in C.STAGES:
        steps.append(materialize(stage(spark, steps[-1], SF), f"test-{name}"))
        if name != "sentencepiece":
            assert steps[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in s.collect()] for s in steps[:5]]

    kept = {i for i, _ in rows[1]}
    assert len((labelled - toxic) & kept) >= 0.95 * len(labelled - toxic) and len(toxic & kept) <= 0.4 * len(toxic)
    want = brute_lines(rows[1], lines.MIN_DOCS, copy_share=C.COPY_SHARE)
    assert {i: t for i, t in rows[2]} == {i: w[0] for i, w in want.items()} and len(rows[2]) == len(rows[1])
    near = brute_minhash(rows[2], 5, 80)
    assert {i for i, _ in rows[3]} == {i for i, w in near.items() if w[2]} and len(rows[3]) == len({i for i, _ in rows[3]})
    used, tokens = {}, {}
    for out, at in ((tokens, 3), (used, 4)):
        for r in steps[at].collect():
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    weights = plain_weights(tokens)
    total = sum(tokens.values())
    assert all(abs(used.get(s, 0) - weights[s] * total) <= 20_000 for s in tokens)
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    last = steps[5].collect()
    assert sorted((r.doc_id, r.ids) for r in last) == sorted((i, library.encode(t)) for i, t in rows[4]) and all(r.round_trip for r in last)


def test_stages_on_nulls_repeats_and_an_empty_table(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "a quiet line of plain words about the weather in the hills"
    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, text, "en", "web", len(text)), (3, text, "en", "web", len(text)), (9, text, "en", "web", len(text))]
    for rows, ids in ((rows, {1, 2, 3}), ([], set())):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in C.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), f"test-{name}")
            assert docs.columns == kind.replace(" long", "").replace(" string", "").split(", ")
        assert {r.doc_id for r in docs.collect()} == ids
        assert {r.doc_id: r.ids for r in C.STAGES[-1][1](spark, docs, SF).collect()}.keys() == ids
