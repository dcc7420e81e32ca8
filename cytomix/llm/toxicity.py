"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomix.llm import trees
from cytomix.llm.common import materialize, spread

#: Labelled rows used for fitting, at most (about), and the most terms kept in the lexicon.
MAX_TRAIN_ROWS, MAX_TERMS = 12_000, 4000
#: A term enters the lexicon from this log ratio of its document rates and this many toxic documents on.
TERM_RATIO, TERM_DOCS = 1.6, 3
STRONG = 3.0
#: Lengths of the word beginnings that stand for all words with the same stem.
STEMS = (4, 5, 6)

# Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()

# Common English insults, known before any label is seen. All other terms are learned.
SEEDS = "idiot idiots idiotic stupid moron moronic dumb dumbass fool jerk freak creep loser losers pathetic worthless useless disgusting scum trash garbage filth vermin clown pig ugly imbecile retard bastard bitch asshole hate kill".split()
SEED_RATIO = 4.0
#: Below so many training rows the calibration uses all of them, not only the part set aside.
FEW_ROWS = 1000

FEATURES = ("strong_density", "weak_density", "strong_any", "top_ratio", "distinct_strong", "near_second_person", "second_person_density", "capitals", "punctuation", "obfuscation", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"[A-Z]{2,}")
_MASKED = re.compile(r"[@$*#!0-9](?<=[^\W\d_].)(?=[^\W\d_])")
_YOU = frozenset(SECOND_PERSON)


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked by a final hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def learned(rows: DataFrame) -> dict[str, float]:
    """The lexicon of rows (text, label): terms with the log ratio of their rates in toxic and other documents.

    Each task counts its own documents; the counts are summed by term, and at most MAX_TERMS reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts[label].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)})
                counts[label][""] += 1
            for label in (label for label in (0, 1) if counts[label]):
                yield pd.DataFrame({"term": list(counts[label]), "label": label, "n": list(counts[label].values())})

    totals = rows.mapInPandas(run, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    totals = materialize(totals.where(f"bad >= {TERM_DOCS} or term = ''"), "toxic-terms")
    n = totals.where("term = ''").head()
    if n is None or not n["bad"] or not n["good"]:
        return {}
    ratio = F.log((F.col("bad") + 0.5) / (n["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (n["good"] + 1.0))
    best = totals.where("term <> ''").withColumn("ratio", ratio).where(F.col("ratio") >= TERM_RATIO).orderBy(F.desc(F.col("ratio") * F.sqrt("bad")), "term").limit(MAX_TERMS)
    return {r["term"]: r["ratio"] for r in best.collect()}


class Describer:
    """The dense features of texts under a lexicon; the ratio of a word is looked up once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = dict.fromkeys(SEEDS, SEED_RATIO) | lexicon, {}

    def ratio(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = _WORD.findall(text.lower())
        n = max(1, len(low))
        hits = [(i, w, r) for i, w in enumerate(low) if (r := self.ratio(w)) > 0]
        strong = [(i, w) for i, w, r in hits if r >= STRONG]
        near = sum(1 for i, _ in strong if not _YOU.isdisjoint(low[max(0, i - 4) : i + 5]))
        second = sum(map(low.count, _YOU)) if len(low) < 40 else sum((c := Counter(low))[w] for w in _YOU)
        marks = text.count("!") + text.count("?")
        return [len(strong) / n, (len(hits) - len(strong)) / n, float(bool(strong)), max((r for _, _, r in hits), default=0.0), float(len({w for _, w in strong})), near / n, second / n, len(_SHOUT.findall(text)) / n, marks / n, len(_MASKED.findall(text)) / n, math.log(n)]


def described(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = Describer(lexicon)
        for batch in batches:
            yield pd.DataFrame({"features": [describe(t) for t in batch["text"]], "label": batch["label"], "part": batch["part"]})

    return rows.mapInPandas(run, "features array<double>, label int, part int")


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: trees.Trees
    raw: np.ndarray
    calibrated: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chances; a thousandth of the raw one keeps the order inside the flat steps of the calibration."""
        p = self.forest.probability(x)
        return np.clip(0.999 * np.interp(p, self.raw, self.calibrated) + 0.001 * p, 0.0, 1.0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out, about MAX_TRAIN_ROWS of them, taken by a hash of the id.

    The rows are dealt into five parts. Features of parts 0 and 1 use the lexicon of 2 and 3 and the reverse, so that the trees
    never see a term's own evidence; part 4 calibrates. The final lexicon is that of all of parts 0 to 3.
    """
    known = labels.where((F.col(label_col).isin(0, 1)) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, MAX_TRAIN_ROWS / max(1, n))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = spread(materialize(rows.select("text", "label", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)).cast("int").alias("part")), "toxic-train"))
    left, right = rows.where("part in (0, 1)"), rows.where("part in (2, 3)")
    lexicon = learned(rows.where("part < 4"))
    parts = described(left, learned(right)).unionByName(described(right, learned(left))).unionByName(described(rows.where("part = 4"), lexicon))
    table = materialize(parts, "toxic-features")
    forest = trees.fit(table.where("part < 4").coalesce(4))

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"label": batch["label"].astype(float), "p": forest.probability(np.stack(batch["features"].to_list()))})

    set_aside = table.where("part = 4") if n >= FEW_ROWS else table
    calibration = materialize(set_aside.mapInPandas(raw, "label double, p double"), "toxic-calibration")
    if calibration.isEmpty():
        return Model(lexicon, forest, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(calibration)
    return Model(lexicon, forest, np.array(curve.boundaries), np.array(curve.predictions))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column score, 0 to 1; null text counts as empty. One pass, no shuffle; every column of docs stays.

    The score depends on the text alone. A column of docs that is itself named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        describe = Describer(shared.value.lexicon)
        for texts in batches:
            x = np.array([describe(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(shared.value.scores(x))

    return docs.withColumn("score", scored(F.col(text_col)))
