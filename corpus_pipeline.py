"""A corpus pipeline of five stages, each calling one operator of cytomix.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.

Null and empty texts pass every stage that does not score them as toxic: they have no lines to drop, link with no document, weigh nothing in the mix (and are in it once, as their source is), and have no
pieces; an empty table passes as an empty one. Repeated rows are scored alike, are one document to the line stage, and stay or go together as near copies, all with the smallest id staying. Columns of
docs other than those named stay as they are. Near copies are told by five words and a similarity of 0.8, the setting for such stages; op1_minhash has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomix.llm import lines, minhash, mixing, pieces, toxicity
from cytomix.llm.common import join_stored, materialize, table


#: Shingles that two documents have in common at least if both are near copies of a third (0.6), less what a sketch may err.
COPY_SHARE = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The model is fitted on labelled documents of this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines whose template recurs; n_chars follows the text. Passages that only copies share stay in them: the next stage finds the copies by these."""
    return lines.drop_recurring(docs, copy_share=COPY_SHARE).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Five-word shingles, similarity 0.8 or more."""
    gone = materialize(minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct(), "pipeline-copies")
    return join_stored(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight buys; a document is a row for each copy."""
    copies = mixing.mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, and whether decoding them gives the text back."""
    model = pieces.default_model(spark)
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "source", "text"), model), model)
    return coded.select("doc_id", "source", "n_ids", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_recurring_lines),
    ("minhash_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Classifier, signatures and tokenizer have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
