"""SentencePiece encoding and decoding by a lattice of pieces over words."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words up to so many characters are laid out side by side; longer ones are merged one at a time.
MATRIX_CHARS = 64
#: Distinct words that a task remembers, and cells of the lattice that it lays out at once.
KNOWN_WORDS, CELLS = 400_000, 6_000_000

_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


class Vocabulary:
    """A model's pieces: text, score and byte fallback. Plain data, so that it can be sent to tasks."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.text) if usable[i]}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        ranks = self.score[[i for t, i in self.ids.items() if len(t) > 1]]
        #: A merge model numbers its pieces in the order of merging; a unigram model has log probabilities.
        self.merges = bool((ranks == np.round(ranks)).all())
        self.longest = max(map(len, self.ids))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("pieces that go on past a space need whole texts, not words")


class Lattice:
    """Encodes many words at once. The lattice is a table of edges (word, start, length, piece), found by
    taking all substrings up to the longest piece, joining them to the pieces by hash, and grouping them by word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, int] = {}
        self.store: list[np.ndarray] = []
        self.flat = self.start = self.size = np.empty(0, np.int64)
        hashes = np.array([self._hash(t) for t in vocabulary.ids], np.uint64)
        ids = np.fromiter(vocabulary.ids.values(), np.int32, len(vocabulary.ids))
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.tables = []
        while len(hashes):  # pieces whose slot is taken go to a further table
            odd = np.uint64(0xBF58476D1CE4E5B9 + 2 * len(self.tables))
            slot = (hashes * odd) >> np.uint64(64 - _SLOTS)
            _, first = np.unique(slot, return_index=True)
            keys, values = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
            keys[slot[first]], values[slot[first]] = hashes[first], ids[first]
            self.tables.append((odd, keys, values))
            left = np.ones(len(hashes), bool)
            left[first] = False
            hashes, ids = hashes[left], ids[left]
        self.rank = np.append(vocabulary.score, -np.inf)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        """The ids of the pieces with the hashes h, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for odd, keys, values in self.tables:
            slot = (h * odd) >> np.uint64(64 - _SLOTS)
            out = np.where((keys[slot] == h) & (values[slot] >= 0), values[slot], out)
        return out

    def edges(self, words: list[str]) -> np.ndarray:
        """edge[w, i, n - 1]: the piece that is characters i to i + n of word w, or -1. All words have one length."""
        size = len(words[0])
        chars = np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        deep = min(size, self.v.longest)
        out = np.full((len(words), size, deep), -1, np.int32)
        h = np.zeros_like(chars)
        for n in range(1, deep + 1):
            h = h[:, : size - n + 1] * _BASE + chars[:, n - 1 :]
            out[:, : size - n + 1, n - 1] = self._pieces(h)
        return out

    def merged(self, edge: np.ndarray) -> np.ndarray:
        """Token lengths by start (0 inside tokens) when, in every word, the best-scored pair of neighbours is merged until none is a piece."""
        words, size, deep = edge.shape
        length = np.ones((words, size + 1), np.int64)
        length[:, size] = 0
        live, place = np.arange(words), np.arange(size)
        while len(live):
            now = length[live]
            after = np.minimum(place + now[:, :size], size)
            both = now[:, :size] + np.take_along_axis(now, after, 1)
            fits = (now[:, :size] > 0) & (after < size) & (both <= deep)
            piece = np.where(fits, np.take_along_axis(edge[live], np.where(fits, both - 1, 0)[:, :, None], 2)[:, :, 0], -1)
            score = np.where(piece >= 0, self.rank[piece], -np.inf)
            best = score.argmax(1)
            row = np.arange(len(live))
            some = np.isfinite(score[row, best])
            row, best = row[some], best[some]
            live = live[some]
            length[live, after[row, best]] = 0
            length[live, best] = both[row, best]
        return length[:, :size]

    def viterbi(self, edge: np.ndarray) -> np.ndarray:
        """Token lengths by start of the path with the largest sum of scores; a character that is no piece costs more than any path of pieces."""
        words, size, deep = edge.shape
        floor = float(self.v.score.min()) - 10.0
        best, back = np.full((words, size + 1), -np.inf), np.ones((words, size + 1), np.int64)
        best[:, 0] = 0.0
        for end in range(1, size + 1):
            for n in range(1, min(end, deep) + 1):
                piece = edge[:, end - n, n - 1]
                score = best[:, end - n] + np.where(piece >= 0, self.rank[piece], floor if n == 1 else -np.inf)
                better = score > best[:, end]
                best[better, end], back[better, end] = score[better], n
        length, at, rows = np.zeros((words, size), np.int64), np.full(words, size), np.arange(words)
        while (at > 0).any():
            on = at > 0
            n = back[rows[on], at[on]]
            at[on] -= n
            length[rows[on], at[on]] = n
        return length

    def _long(self, word: str) -> list[int]:
        """Token lengths of one long word, by a queue of merges (or, for a unigram model, the lattice row by row)."""
        n = len(word)
        if not self.v.merges:
            best, back = [0.0] + [-np.inf] * n, [1] * (n + 1)
            floor = float(self.v.score.min()) - 10.0
            for i in range(n):
                for k in range(1, min(self.v.longest, n - i) + 1):
                    p = self.v.ids.get(word[i : i + k])
                    s = best[i] + (self.v.score[p] if p is not None else floor if k == 1 else -np.inf)
                    if s > best[i + k]:
                        best[i + k], back[i + k] = s, k
            out, at = [], n
            while at:
                out.append(back[at])
                at -= back[at]
            return out[::-1]
        size, before = [1] * n, list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = i + size[i]
            if i >= 0 and j < n and size[i] + size[j] <= self.v.longest:
                p = self.v.ids.get(word[i : j + size[j]])
                if p is not None:
                    heapq.heappush(heap, (-self.v.score[p], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if size[i] != a or i + a >= n or size[i + a] != b:
                continue
            size[i], size[i + a] = a + b, 0
            if i + a + b < n:
                before[i + a + b] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in size if s]

    def _learn(self, words: list[str]) -> None:
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        for size, group in groups.items():
            if size > MATRIX_CHARS:
                for w in group:
                    ids, at = [], 0
                    lengths = self._long(w)
                    for n in lengths:
                        ids.append(self.v.ids.get(w[at : at + n], -1))
                        at += n
                    self._keep([w], np.array(ids, np.int32), np.array([len(ids)]), np.zeros(len(ids), np.int64), np.cumsum([0, *lengths])[:-1])
                continue
            step = max(1, CELLS // (size * min(size, self.v.longest)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                edge = self.edges(part)
                length = self.merged(edge) if self.v.merges else self.viterbi(edge)
                w, i = np.nonzero(length)
                self._keep(part, edge[w, i, length[w, i] - 1], np.bincount(w, minlength=len(part)), w, i)

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        """Store the ids of words, each with the number of its word and its place there; a character without a piece becomes its bytes, or unknown if the model has no bytes."""
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            letters = [words[w][i] for w, i in zip(owner[missing].tolist(), at[missing].tolist(), strict=True)]
            fall = [[self.v.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.bytes[0] != self.v.unknown else [self.v.unknown] for c in letters]
            sizes = np.ones(len(ids), np.int64)
            sizes[missing] = [len(f) for f in fall]
            wide = np.repeat(ids, sizes)
            wide[wide < 0] = list(chain.from_iterable(fall))
            counts = counts + np.bincount(owner[missing], sizes[missing] - 1, len(counts)).astype(np.int64)
            ids = wide
        self.store.append(ids.astype(np.int32))
        base = len(self.start) + len(self._fresh)
        for k, word in enumerate(words):
            self.known[word] = base + k
        self._fresh.extend(counts.tolist())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        units = [[SPACE + w for w in t.split(" ")] if t and "  " not in t and SPACE not in t and not t.endswith(" ") and not t.startswith(" ") else _RUN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.store, self.start, self.size = [], self.start[:0], self.size[:0]
            self.flat = self.flat[:0]
        new = {w for u in units for w in u if w not in self.known}
        if new:
            self._fresh: list[int] = []
            self._learn(sorted(new))
            self.flat = np.concatenate([self.flat, *self.store]).astype(np.int32)
            self.store = []
            self.size = np.concatenate((self.size, np.array(self._fresh, np.int64)))
            self.start = np.cumsum(self.size) - self.size
        lens = np.array([len(u) for u in units], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(lens.sum()))
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lens)))]
        return ids, np.diff(edge)


class Decoder:
    """Text of ids: pieces joined, byte pieces read as UTF-8, spaces restored, the one put in front removed."""

    def __init__(self, v: Vocabulary):
        self.byte = {i: b for b, i in enumerate(v.bytes) if i != v.unknown}
        #: Bytes under 128 are characters of their own; only others need their neighbours.
        self.text = [chr(self.byte[i]) if self.byte.get(i, 128) < 128 else t for i, t in enumerate(v.text)]
        self.part = np.zeros(len(v.text), bool)
        self.part[[i for i, b in self.byte.items() if b > 127]] = True

    def __call__(self, ids: np.ndarray) -> str:
        if self.part[ids].any():
            out, run = [], bytearray()
            for i in ids.tolist():
                b = self.byte.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.text[i])
            out.append(run.decode("utf-8", "replace"))
        else:
            out = map(self.text.__getitem__, ids.tolist())
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """docs with columns ids and n_ids: the piece ids of the whole text under the model, as the model's own library gives them.

    A null text has null ids and n_ids 0; an empty one has none. All rows and other columns stay; own columns named ids or n_ids are
    replaced. U+2581 in a text counts as a space, as it does in the library. One pass, no shuffle; a task keeps at most about KNOWN_WORDS words.
    """
    docs = docs.drop("ids", "n_ids")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    kind = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                ids, counts = lattice([t or "" for t in texts])
                offsets = pa.array([None if t is None else int(o) for t, o in zip(texts, np.cumsum(counts) - counts, strict=True)] + [int(counts.sum())], pa.int32())
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "ids", "n_ids"])

    return docs.mapInArrow(run, kind)


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of ids_col, null where that is null. A column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([None if ids is None else decoder(np.asarray(ids, np.int64)) for ids in batch], dtype=object)

    return rows.withColumn("decoded", text(F.col(ids_col)))


def default_model(spark: SparkSession) -> str:
    """The model file named by cytomix.tokenizer.model, by default that of the public tokenizers on this machine."""
    return spark.conf.get("cytomix.tokenizer.model", "/opt/tokenizers/piece_bpe_32k.model")
