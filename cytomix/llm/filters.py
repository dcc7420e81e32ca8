"""Filter interaction audit: what five filters remove in every order, by contractions of one contingency tensor for each part of the table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.llm.common import materialize, runs

FILTERS = "ABCDE"
#: Fewest words, least percentage of different words, and most percentage of capitals.
WORDS, DIFFERENT, CAPITALS = 200, 50, 2

ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITALS = bytes(range(65, 91))
_MARK = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The failed filters of a text among the first four, as bits: A few words, B few different words, C many capitals, D any of six marks."""
    n, seen = 0, set()
    for part in runs(text):
        words = part.split()
        n += len(words)
        seen.update(words)
    points = len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (n < WORDS) + 2 * (100 * len(seen) < DIFFERENT * n) + 4 * (100 * capitals > CAPITALS * points) + 8 * bool(_MARK.search(text))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(part, fails, n, good, toxic): rows of each part by the bits of the filters that they fail, and how many of these are labelled good and toxic.

    E, bit 16, fails where a smaller id has the same text. Rows travel without texts: as digest, id and bits. Copies of one text meet as one row for each part and kind of label, so a
    text that a third of all rows share is a few rows.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(id_col).alias("id"), part, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "part": batch["part"], "digest": [hashlib.sha256(t).digest() for t in batch["text"]], "fails": [failures(t) for t in batch["text"]]})

    kind = rows.schema["id"].dataType.simpleString()
    read_rows = rows.where("id is not null").mapInPandas(read, f"id {kind}, part string, digest binary, fails int")
    seen = read_rows.groupBy("id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    seen = seen.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    alike = seen.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    nameless = rows.where("id is null").select(F.lit(None).cast(kind).alias("id"), "part", "text").mapInPandas(read, f"id {kind}, part string, digest binary, fails int").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"))
    first = F.min("first.id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("lead", F.when(F.col("first.id") == first, F.col("first.n")).otherwise(0))
    split = alike.select("part", "good", "toxic", F.explode(F.array(F.struct("fails", F.col("lead").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("lead")).alias("n")))).alias("t"))
    split = split.select("part", "good", "toxic", "t.*").unionByName(nameless.select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "fails", "n"))
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return split.where("n > 0").groupBy("part", "fails").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _selectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each order and step selects along each axis, as weights of (pass, fail), for the rows kept, removed, and failing its filter alone; arrays of steps by axes by 2."""
    every, passing, failing = np.array([1, 1]), np.array([1, 0]), np.array([0, 1])
    kept, removed, alone = (np.tile(every, (len(ORDERS) * 5, 5, 1)) for _ in range(3))
    for i, (order, step) in enumerate((o, s) for o in ORDERS for s in range(5)):
        at = [FILTERS.index(f) for f in order[: step + 1]]
        kept[i, at] = passing
        removed[i, at[:-1]], removed[i, at[-1]] = passing, failing
        alone[i], alone[i, at[-1]] = passing, failing
    return kept, removed, alone


def contract(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of tensors of 2 x 2 x 2 x 2 x 2 counts over what is chosen along each axis: rows of counts by rows of chosen."""
    return np.einsum("pabcde,na,nb,nc,nd,ne->pn", counts, *(chosen[:, k] for k in range(5)), optimize=True)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """For each part, each of the 120 orders of the filters and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (the removals of the step's filter, summed over all orders).

    A null text or part counts as empty. Repeated rows count each time; rows that share id and text do not fail E for each other. Rows without id have no label, no earlier text, and are nobody's
    earlier text. Labels that name a document twice count if any row is good, or toxic. An empty table gives no rows. Other columns are ignored.
    """
    packed = cells(docs, labels, id_col, part_col, text_col).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("c"))  # 32 cells at most
    packed = materialize(packed.select("part", *[F.col(f"c.{x}").alias(x) for x in ("fails", "n", "good", "toxic")]), "filters-cells")
    names = [o for o in ORDERS for _ in range(5)]
    steps, own = np.tile(np.arange(1, 6), len(ORDERS)), np.array([FILTERS.index(o[s]) for o in ORDERS for s in range(5)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, removed, alone = _selectors()
        bits = (np.arange(32)[:, None] >> np.arange(5)) & 1
        for batch in batches:
            for row in batch.itertuples():
                tensors = np.zeros((3, 2, 2, 2, 2, 2), np.int64)
                for k, values in enumerate((row.n, row.good, row.toxic)):
                    tensors[(k, *bits[np.asarray(row.fails)].T)] = values
                out, lost = contract(tensors[:1], kept)[0], contract(tensors, removed)
                fails = np.array([tensors[0].take(1, axis=k).sum() for k in range(5)])[own]
                shapley = np.array([lost[0][own == k].sum() for k in range(5)], np.int64)[own]
                yield pd.DataFrame({"part": row.part, "filter_order": names, "step": steps, "kept": out, "removed": lost[0], "redundant": fails - lost[0], "unique_fails": contract(tensors[:1], alone)[0], "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley})

    return packed.mapInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
