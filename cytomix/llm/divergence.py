"""Source divergence audit: how far the word rates of a language's sources lie apart, by an exact recount over minimal perfect hashes.

A first pass counts the documents of each term and keeps the frequent ones. The kept terms of a language are cut into shards of about SHARD keys, and each shard gets a minimal
perfect hash: a key's bucket holds the displacement that sends it to its own slot. The hashes and the keys they store are broadcast; a second pass looks every term up, compares it with the key stored at
its slot, and increments the dense slots of its group. What is left are sums by group and slot, and pairs of groups by shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.llm.common import join_stored, materialize, runs

#: Documents of a language in which a term is kept, and the terms that a group reports.
MIN_DOCS, TOP = 10, 10
#: Added to every count, and the scale of the rates.
PLUS, UNIT = 2, 1_000_000_000
#: Keys of a shard (about), and keys of a bucket.
SHARD, BUCKET = 256, 3
#: Bytes of stored keys up to which the hashes are broadcast; beyond, counts travel to the shards instead.
INDEX_BYTES = 64_000_000
#: Terms, of TERM_BYTES with what stands between them, that a task counts at once, and slots that it holds before it hands its counts on.
HELD_TERMS, TERM_BYTES, HELD_SLOTS = 500_000, 8, 12_000_000
#: Parts in which a task hands on a group's slots: so many whatever the number of terms, or its rows would grow with tasks times terms.
SECTIONS = 64

#: Bytes of terms as they are, A to Z lower-cased; all other bytes become spaces.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in runs of bounded length: letters A to Z in either case, and all beyond ASCII."""
    for part in runs((text or b"").translate(_FOLD)):
        yield part.split()


def _tally(keys: list[tuple[str, ...]], texts: list[bytes], once: bool) -> tuple[list[tuple[str, ...]], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As tallies, of folded texts. All terms are one Arrow array: the texts without what stands between terms, and the terms' lengths."""
    names = list(dict.fromkeys(keys))
    code = {name: i for i, name in enumerate(names)}
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    term, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    last = np.cumsum([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, last), prepend=0))
    if once:
        row, term = np.divmod(np.unique(row * size + term, return_counts=True)[0], size)  # with counts it sorts, which is faster here than its hashing
    pairs, n = np.unique(np.array([code[k] for k in keys])[row] * size + term, return_counts=True)
    return names, coded.dictionary, pairs // size, pairs % size, n


def tallies(batches: Iterator[pa.RecordBatch], by: list[str], once: bool = False) -> Iterator[tuple[list[tuple[str, ...]], pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, words, key, word, n) for so many rows at a time as hold about HELD_TERMS terms: words[word[i]] stands n[i] times in rows with the values keys[key[i]] of the columns by or, with once, in n[i] of those rows.

    A pair of key and word comes once, pairs of a key stand together. A long text is counted by runs; with once, it is cut down to its distinct terms first, so that no two of its runs share any.
    """
    keys, texts, held, most = [], [], 0, HELD_TERMS * TERM_BYTES
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in by), batch.column("text"), strict=True):
            text = text.as_py()
            if once and len(text) > most:
                text = b" ".join(set().union(*terms(text)))
            for part in runs(text.translate(_FOLD), most):
                keys.append(tuple(key))
                texts.append(part)
                held += len(part) + 1
                if held > most:
                    yield _tally(keys, texts, once)
                    keys, texts, held = [], [], 0
    if keys:
        yield _tally(keys, texts, once)


def _named(keys: list[tuple[str, ...]], key: np.ndarray) -> list[pa.Array]:
    return [pa.array(names, pa.string()).take(pa.array(key)) for names in zip(*keys, strict=True)]


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): the rows of docs (lang, source, text as bytes) that hold a term, exactly. Tasks hand on partial counts of bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, key, word, n in tallies(batches, ["lang"], once=True):
            yield pa.RecordBatch.from_arrays([*_named(keys, key), words.take(pa.array(word)), pa.array(n)], ["lang", "term", "docs"])

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    return parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _hashes(lang: str, keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key: the first deals out shard and bucket, the second the slot."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k, seed) for k in keys]), dtype=np.uint64).reshape(-1, 2)


def _shards(first: np.ndarray, shards: int) -> np.ndarray:
    return (first % np.uint64(shards)).astype(np.int64)


def _buckets(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((first >> np.uint64(32)) % ((n + BUCKET - 1) // BUCKET).astype(np.uint64)).astype(np.int64)


def _slots(second: np.ndarray, move: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = second ^ (move.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % n.astype(np.uint64)).astype(np.int64)


def perfect_hash(lang: str, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(moves, slot): the displacement of each bucket, and the slot of each key; no two keys share one, and no slot is left over."""
    n = len(keys)
    size, h = np.full(1, n), _hashes(lang, keys)
    bucket = _buckets(h[:, 0], size)
    moves, slot, free = np.zeros((n + BUCKET - 1) // BUCKET, np.int64), np.full(n, -1), np.ones(n, bool)
    members = [np.flatnonzero(bucket == b) for b in range(len(moves))]
    for b in sorted(range(len(moves)), key=lambda b: -len(members[b])):
        own, start = members[b], 0
        while len(own):
            tried = np.arange(start, start + 64)
            at = _slots(h[own, 1][None], tried[:, None], size)
            fits = free[at].all(1) & ((np.sort(at, 1)[:, 1:] != np.sort(at, 1)[:, :-1]).all(1))
            if fits.any():
                moves[b] = tried[fits.argmax()]
                slot[own] = at[fits.argmax()]
                free[slot[own]] = False
                break
            start += 64
    return moves, slot


def index(kept: DataFrame) -> DataFrame:
    """(lang, shard, shards, moves, terms) of kept terms (lang, term): the perfect hash of each shard, with its keys in the order of their slots."""
    sizes = materialize(kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards")), "divergence-langs")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                first = _hashes(lang, [t.encode() for t in rows["term"]])[:, 0]
                yield rows.assign(shard=_shards(first, int(rows["shards"].iloc[0])))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            moves, names = [], []
            for lang, keys in zip(batch["lang"], batch["terms"], strict=True):
                m, slot = perfect_hash(lang, [t.encode() for t in keys])
                moves.append(m)
                names.append(np.asarray(keys, object)[np.argsort(slot)])
            yield batch.assign(moves=moves, terms=names)

    dealt = join_stored(kept, sizes, ["lang"]).select("lang", "term", "shards").mapInPandas(deal, "lang string, term string, shards int, shard int")
    packed = dealt.groupBy("lang", "shard", "shards").agg(F.collect_list("term").alias("terms"))
    return materialize(packed.mapInPandas(build, "lang string, shard int, shards int, terms array<string>, moves array<long>"), "divergence-index")


class Lookup:
    """The shards of one language, laid end to end: slots of terms, told from strangers by the stored key."""

    def __init__(self, lang: str, shards: int, rows: list[tuple[int, list[int], list[str]]]):
        self.lang, self.shards = lang, shards
        self.n = np.zeros(shards, np.int64)
        self.moves, self.keys, places = [], [], np.zeros(shards, np.int64)
        for shard, moves, keys in sorted(rows):
            self.n[shard], places[shard] = len(keys), len(self.moves)
            self.moves.extend(moves)
            self.keys.extend(k.encode() for k in keys)
        self.places, self.starts = places, np.cumsum(self.n) - self.n
        self.moves, self.keys = np.array(self.moves, np.int64), np.array([*self.keys, None], object)[:-1]

    def __call__(self, found: list[bytes]) -> np.ndarray:
        """The place of each term among all slots, -1 for those that are not kept."""
        h = _hashes(self.lang, found)
        shard = _shards(h[:, 0], self.shards)
        n = self.n[shard]
        known = n > 0
        n = np.maximum(n, 1)
        bucket = np.where(known, self.places[shard] + _buckets(h[:, 0], n), 0)
        at = np.where(known, self.starts[shard] + _slots(h[:, 1], self.moves[bucket], n), 0)
        same = self.keys[at] == np.array([*found, None], object)[:-1]
        return np.where(known & same, at, -1)


#: Counts by group and section, or shard, of the slots.
_LAYOUT = "lang string, source string, {} int, slots array<int>, n array<long>"


def _sparse(names: list[tuple[str, str, int]], row: np.ndarray, slot: np.ndarray, n: np.ndarray, unit: str) -> pa.RecordBatch:
    """A row (lang, source, unit, slots, n) for each of names; row, which rises, deals out slots and n."""
    ends = pa.array(np.searchsorted(row, np.arange(len(names) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot.astype(np.int32), n)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*names, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)), *lists], ["lang", "source", unit, "slots", "n"])


def section_counts(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(lang, source, section, slots, n): each task's counts of the kept terms by group, from its dense slots; shared holds the Lookup of each language, and slots are places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, dense, held = shared.value, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in ((k, v) for k, v in dense.items() if v.any()):
                at = np.flatnonzero(slots)
                own, row = np.unique(at * SECTIONS // len(slots), return_inverse=True)
                yield _sparse([(lang, source, int(x)) for x in own], row, at, slots[at], "section")
            dense.clear()

        for keys, words, key, word, n in tallies(batches, ["lang", "source"]):
            ends = np.searchsorted(key, np.arange(len(keys) + 1))
            of = defaultdict(list)
            for k, (lang, _) in enumerate(keys):
                of[lang].append(k)
            for lang in of.keys() & lookups.keys():
                own = np.unique(np.concatenate([word[ends[k] : ends[k + 1]] for k in of[lang]]), return_counts=True)[0]
                place = np.full(len(words), -1)
                place[own] = lookups[lang](words.take(pa.array(own)).cast(pa.binary()).to_pylist())
                for k in of[lang]:
                    at, more = place[word[ends[k] : ends[k + 1]]], n[ends[k] : ends[k + 1]]
                    if keys[k] not in dense:
                        dense[keys[k]] = np.zeros(len(lookups[lang].keys), np.int64)
                        held += len(dense[keys[k]])
                    dense[keys[k]][at[at >= 0]] += more[at >= 0]
                    if held > HELD_SLOTS:
                        yield from out()
                        held = 0
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, _LAYOUT.format("section"))


def group_counts(docs: DataFrame, shards: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(lang, source, shard, slots, n): occurrences of the kept terms in each group of docs (lang, source, text as bytes), where there are any. A group can have several rows a shard; what they count adds up.

    The index is broadcast if its stored keys take index_bytes at most. A larger one stays where it is, and each task's counts are joined to its terms. Counts travel as one row a task, group and section of the slots.
    """
    size = shards.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x) + 64)), F.lit(0))).head()[0]
    if size > index_bytes:
        return _joined_counts(docs, shards)
    by_lang = defaultdict(list)
    for r in shards.toLocalIterator():
        by_lang[r["lang"], r["shards"]].append((r["shard"], r["moves"], r["terms"]))
    lookup = {lang: Lookup(lang, n, rows) for (lang, n), rows in by_lang.items()}
    shared, ends_of = docs.sparkSession.sparkContext.broadcast(lookup), {lang: x.starts + x.n for lang, x in lookup.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for (lang, source, _), own in groupby(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "section")), strict=True)):
                size = len(list(own))
                slots, n = (batch.column(c).slice(start, size).flatten().to_numpy() for c in ("slots", "n"))
                start, low, ends = start + size, slots.min(), ends_of[lang]
                sums = np.zeros(slots.max() - low + 1, np.int64)
                np.add.at(sums, slots - low, n)
                at = np.flatnonzero(sums)
                shards, row = np.unique(np.searchsorted(ends, at + low, side="right"), return_inverse=True)
                yield _sparse([(lang, source, int(x)) for x in shards], row, at + low - np.append(0, ends)[shards][row], sums[at], "shard")

    parts = section_counts(docs, shared).repartition("lang", "source", "section").sortWithinPartitions("lang", "source", "section")
    return parts.mapInArrow(add, _LAYOUT.format("shard"))


def _joined_counts(docs: DataFrame, shards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, key, word, n in tallies(batches, ["lang", "source"]):
            yield pa.RecordBatch.from_arrays([*_named(keys, key), words.take(pa.array(word)), pa.array(n)], ["lang", "source", "term", "n"])

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    keys = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
    found = parts.join(keys, ["lang", "term"]).groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("slot", "n")).alias("c"))
    return found.select("lang", "source", "shard", F.col("c.slot").alias("slots"), F.col("c.n").alias("n"))


def rates(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PLUS) / (total + PLUS * kept)) for each row of counts, exactly: long division by three digits at a time. Totals may reach 9 * 10^15."""
    below = (totals + PLUS * kept)[:, None]
    whole, rest = np.divmod(counts + PLUS, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return 1 + whole


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) * (p - q) // (p + q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group (lang, source) of docs its distance to each other source of the language (part pair, all ranks), and the top terms that it uses more than the language does (part term).

    A language keeps the terms of min_docs of its rows. With p the smoothed rate of a term in the group and q that in the other source, or in the language, a term's distance is floor((p - q)^2 / (p + q)); a pair's value
    sums it over all kept terms. Integers throughout. Null text, lang and source count as empty; repeated rows count each time; a group without terms has only its pairs, and a language that keeps nothing
    has pairs of value 0; an empty table gives no rows. Ranks run from 1 by falling value, ties by the item's bytes. Other columns of docs are ignored.

    The result has a row for each pair of a language's sources, so a language's list of sources travels with each of its shards.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kept = materialize(document_counts(rows).where(F.col("docs") >= min_docs).select("lang", "term"), "divergence-kept")
    shards = index(kept)
    counts = materialize(group_counts(rows, shards, index_bytes), "divergence-counts")
    groups = materialize(rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda t, x: t + x)).alias("total")), ["lang", "source"], "left").fillna(0, ["total"]), "divergence-groups")
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("of"))
    sources = sources.join(shards.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept")), "lang").select("lang", "kept", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"))
    sources = materialize(sources, "divergence-sources")
    packed = counts.groupBy("lang", "shard").agg(F.collect_list(F.struct("source", "slots", "n")).alias("c"))
    packed = packed.join(shards.select("lang", "shard", "terms"), ["lang", "shard"])
    packed = join_stored(packed, sources, ["lang"], items=F.size("sources"))
    packed = packed.select("lang", "kept", "sources", "totals", "terms", F.col("c.source").alias("source"), F.transform("c.n", F.size).alias("sizes"), F.flatten("c.slots").alias("slot"), F.flatten("c.n").alias("n"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between: dict[str, tuple[list[str], np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, (names, value) in ((k, v) for k, v in between.items() if len(v[0]) > 1):
                i, j = np.nonzero(~np.eye(len(names), dtype=bool))
                yield pd.DataFrame({"lang": lang, "source": np.take(names, i), "part": "pair", "item": np.take(names, j), "value": value[i, j]})
            between.clear()

        for batch in batches:
            for row in batch.itertuples():
                names, totals = list(row.sources), np.asarray(row.totals, np.int64)
                grid = np.zeros((len(names), len(row.terms)), np.int64)
                place = {name: i for i, name in enumerate(names)}
                np.add.at(grid, (np.repeat([place[name] for name in row.source], row.sizes), row.slot), row.n)
                p = rates(grid, totals, int(row.kept))
                q = rates(grid.sum(0, keepdims=True), totals.sum(keepdims=True), int(row.kept))
                _, value = between.setdefault(row.lang, (names, np.zeros((len(names), len(names)), np.int64)))
                for i in range(len(names) - 1):
                    far = gaps(p[i], p[i + 1 :]).sum(1)
                    value[i, i + 1 :] += far
                    value[i + 1 :, i] += far
                own, words = gaps(p, q), [t.encode() for t in row.terms]
                order = np.array(sorted(range(len(words)), key=words.__getitem__))
                best = []
                for i in range(len(names)):
                    more = order[(grid[i, order] > 0) & (p[i, order] > q[0, order])]
                    best += [(i, w) for w in more[np.argsort(-own[i, more], kind="stable")[:top]]]
                if best:
                    i, w = np.array(best).T
                    yield pd.DataFrame({"lang": row.lang, "source": np.take(names, i), "part": "term", "item": np.take(row.terms, w), "value": own[i, w]})
                if sum(v.size for _, v in between.values()) > HELD_SLOTS:
                    yield from out()
        yield from out()

    found = materialize(packed.mapInPandas(compare, "lang string, source string, part string, item string, value long"), "divergence-found")
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    values = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(values, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    words = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(words)
