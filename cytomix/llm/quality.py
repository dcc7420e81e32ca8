"""Quality: random-indexing word vectors pooled by document, and a two-layer network with calibrated temperature.

A word, a number or a run of marks is a token. Tokens share ROWS rows by hash, so the table of vectors has one size whatever the corpus. Every token has a sparse random index vector, made from its
row's number; the vector of a row is the sum of the index vectors of its tokens' neighbours, to the left and to the right apart, over all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import materialize, runs, spread

#: Rows and width of the table of vectors, places that an index vector sets to 1 or -1, and rows of a stored block.
ROWS, WIDTH, SET, BLOCK = 1 << 15, 32, 2, 256
#: Labelled rows used for fitting, at most (about).
MAX_TRAIN_ROWS = 12_000
#: A document is kept from this score on.
KEEP = 0.7
#: Units of the hidden layer, passes over the training rows, rows of a step, step size, and weight decay.
HIDDEN, EPOCHS, STEP_ROWS, STEP, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Below so many training rows the temperature is calibrated on all of them, not only the part set aside.
FEW_ROWS = 500
#: Distances at which a document's tokens are compared with earlier ones.
LAGS = (1, 2, 3)
FEATURES = 2 * WIDTH + len(LAGS) + 1
#: Tokens that are summed at once.
TOKENS = 1 << 17

_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


class Rows(dict):
    """The row of each token; a token is hashed once."""

    def __missing__(self, token: str) -> int:
        row = zlib.crc32(token.encode("utf-8", "surrogatepass")) % ROWS
        if len(self) < 500_000:
            self[token] = row
        return row


def token_rows(text: bytes | None, rows: Rows) -> Iterator[np.ndarray]:
    """The rows of a text's tokens, in runs of bounded length; a word longer than a run is one token."""
    for part in runs(text or b""):
        found = _TOKEN.findall(part.decode())
        yield np.fromiter(map(rows.__getitem__, found), np.int64, len(found))


def _index_vectors(shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector; another shift gives others."""
    rnd = np.random.default_rng(shift)
    return rnd.integers(0, WIDTH, (ROWS, SET)), rnd.choice(np.array([-1, 1]), (ROWS, SET))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of vectors (ROWS by WIDTH) of all texts of docs: unit length, less the mean direction of all tokens; zero for rows that no token has.

    Each task sums whole numbers into a table of its own and hands it on in blocks, which are summed block by block; a table is ROWS * WIDTH numbers, and so is what reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seen, rows, held, size = np.zeros(ROWS * (WIDTH + 1), np.int64), False, Rows(), [np.array([-1])], 0
        sides = [_index_vectors(1), _index_vectors(2)]

        def add() -> np.ndarray:
            """Counts what is held; the first token was counted before and is only a neighbour, as the last one, returned, will be."""
            ids = np.concatenate(held)
            left, right = ids[:-1], ids[1:]
            inside = (left >= 0) & (right >= 0)
            left, right = left[inside], right[inside]
            for own, other, (places, signs) in ((right, left, sides[0]), (left, right, sides[1])):
                for k in range(SET):
                    sums[: ROWS * WIDTH] += np.bincount(own * WIDTH + places[other, k], weights=signs[other, k], minlength=ROWS * WIDTH).astype(np.int64)
            sums[ROWS * WIDTH :] += np.bincount(ids[1:][ids[1:] >= 0], minlength=ROWS)
            return ids[-1:]

        for batch in batches:
            for text in batch["text"]:
                for ids in token_rows(text, rows):
                    held.append(ids)
                    size, seen = size + len(ids), True
                    if size > TOKENS:
                        held, size = [add()], 0
                held.append(np.array([-1]))
        add()
        if seen:
            table = np.concatenate((sums[: ROWS * WIDTH].reshape(ROWS, WIDTH), sums[ROWS * WIDTH :, None]), axis=1)
            for i in range(0, ROWS, BLOCK):
                yield pd.DataFrame({"block": [i // BLOCK], "data": [table[i : i + BLOCK].astype(np.int32 if np.abs(table).max() < 2**31 else np.int64).tobytes()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"], strict=True):
                wide = np.frombuffer(data, np.int32 if len(data) == 4 * BLOCK * (WIDTH + 1) else np.int64).reshape(BLOCK, WIDTH + 1).astype(np.int64)
                sums[block] = sums[block] + wide if block in sums else wide
        for block, wide in sums.items():
            yield pd.DataFrame({"block": [block], "data": [wide.tobytes()]})

    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInPandas(run, "block int, data binary")
    blocks = materialize(parts.repartition("block").mapInPandas(total, "block int, data binary"), "quality-vectors")
    table = np.zeros((ROWS, WIDTH + 1))
    for r in blocks.collect():
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], np.int64).reshape(BLOCK, WIDTH + 1)
    vectors, n = table[:, :WIDTH], table[:, WIDTH]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    vectors = np.where(n[:, None] > 0, vectors - (n @ vectors) / max(n.sum(), 1.0), 0.0)
    return vectors.astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray, rows: Rows) -> np.ndarray:
    """For each text the mean and the deviation of its tokens' vectors, the shares of tokens with the same vector as that 1, 2 and 3 tokens before, and the logarithm of their number."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        n, first, second, same = 0, np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(len(LAGS))
        for ids in token_rows(text, rows):
            for at in range(0, len(ids), TOKENS):
                x = vectors[ids[at : at + TOKENS]]
                n += len(x)
                first += x.sum(0, dtype=float)
                second += np.einsum("ij,ij->j", x, x, dtype=float)
            same += [np.count_nonzero(ids[lag:] == ids[:-lag]) for lag in LAGS]
        if n:
            mean = first / n
            out[i] = np.concatenate((mean, np.sqrt(np.maximum(second / n - mean * mean, 0)), same / n, [math.log(n)]))
    return out


@dataclass
class Network:
    """Two layers over standardised features; the logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Steps of the adaptive-moment rule on the cross entropy, from a seeded start; labels of one kind only give the network their rate alone."""
    rnd = np.random.default_rng(seed)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(FEATURES)
    net = Network(x.mean(0) if len(x) else np.zeros(FEATURES), scale, rnd.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([math.log(rate / (1 - rate))]))
    if len(np.unique(y)) < 2:
        return net
    z = (x - net.mean) / net.scale
    names = ("w1", "b1", "w2", "b2")
    first, second, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(z))
        pace = STEP * (1 - epoch / EPOCHS)
        for at in range(0, len(z), STEP_ROWS):
            own, want = z[order[at : at + STEP_ROWS]], y[order[at : at + STEP_ROWS]]
            hidden = np.tanh(own @ net.w1 + net.b1)
            miss = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -35, 35))) - want) / len(own)
            back = np.outer(miss, net.w2) * (1 - hidden * hidden)
            slopes = {"w1": own.T @ back + DECAY * net.w1, "b1": back.sum(0), "w2": hidden.T @ miss + DECAY * net.w2, "b2": np.array([miss.sum()])}
            t += 1
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
    return net


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/4 to 8 under which the logits have the least cross entropy on labels y, by golden sections of its logarithm; 1 without both labels."""
    if len(np.unique(y)) < 2:
        return 1.0
    loss = lambda u: np.logaddexp(0, -(2 * y - 1) * logits / math.exp(u)).mean()
    a, b, ratio = math.log(0.25), math.log(8.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Vectors from all documents, and a network from the labelled ones that are not held out, about max_rows of them by a hash of the id; a fifth of these only sets the temperature.

    Documents that are labelled twice count as good if any label says so.
    """
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where((F.col(label_col).isin(0, 1)) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, max_rows / max(1, known.count()))))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).join(F.broadcast(sample), "id")
    rows = spread(materialize(rows.select("text", "label", F.xxhash64("id", F.lit(12)).alias("at")), "quality-train"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Rows()
        for batch in batches:
            yield pd.DataFrame({"x": list(pooled(list(batch["text"]), shared.value, found)), "label": batch["label"], "at": batch["at"]})

    # about max_rows rows, times the copies that share an id, which carry the same label
    table = materialize(rows.mapInPandas(run, "x array<double>, label int, at long").groupBy("at", "label").agg(F.first("x").alias("x")), "quality-features").toPandas().sort_values("at", ignore_index=True)
    x, y = np.array(table["x"].to_list()).reshape(-1, FEATURES), table["label"].to_numpy(float)
    aside = table["at"].to_numpy() % 5 == 0
    network = train(x[~aside], y[~aside])
    part = aside if len(y) >= FEW_ROWS else np.ones(len(y), bool)
    network.temperature = calibrate(network.logits(x[part]), y[part])
    return Model(vectors, network)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column score, 0 to 1, the chance of good quality; null text counts as empty. One pass, no shuffle; every column of docs stays.

    The score depends on the text alone: repeated texts score alike, however long they are. An empty text has no tokens and the network's score of that. A column of docs that is itself named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = Rows()
        for texts in batches:
            yield pd.Series(shared.value.network.probability(pooled(list(texts), shared.value.vectors, rows)))

    return docs.withColumn("score", scored(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
