"""Removal of repeated byte strings: two-stage suffix sorting and adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import join_stored, materialize

#: Bytes of the grams by which repeated strings are brought together.
GRAM = 32
#: Bytes of text sorted at once, about, and the most different passages of one gram that are sorted together.
CHUNK_BYTES, CHUNK_PASSAGES = 2_000_000, 256

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size bytes from each place on; size is made of halves that are themselves hashed."""
    whole, level = _mix(b.astype(np.uint64) + _C[0]), 0
    out, covered = None, 0
    while True:
        width = 1 << level
        if size & width:
            part = whole[covered:]
            out = part if out is None else _mix(out[: len(part)] * _C[7] + part)
            covered += width
        if width * 2 > size:
            return out[: max(0, len(b) - size + 1)]
        whole, level = _mix(whole[:-width] * _C[level % 7] + whole[width:]), level + 1


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values, by running minima from both ends of blocks."""
    n = len(h)
    x = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    x[:n] = h
    x = x.reshape(-1, width)
    forth, back = np.minimum.accumulate(x, 1).ravel(), np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def passages(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, gram, tied): runs of n neighbouring length-byte strings of data whose least gram hash is the same.

    Every such string lies in one run, and equal strings have equal least grams wherever they stand. Equal strings within one run
    need its gram twice there; tied marks such runs.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) < length:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    grams, width = _gram_hashes(b, GRAM), length - GRAM + 1
    least = _least(grams, width)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n, gram = np.diff(np.append(start, len(least))), least[start]
    tied = np.fromiter((np.count_nonzero(grams[s : s + k + width - 1] == g) > 1 for s, k, g in zip(start.tolist(), n.tolist(), gram, strict=True)), bool, len(start))
    return start, n, gram, tied


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places wanted, in the order of the suffixes of text that start there, compared over depth bytes at least.

    Stage one: suffixes smaller than their successors are sorted directly, eight bytes at a time. Stage two: a scan of
    the buckets of first bytes, upwards. A suffix larger than its successor is a run of its first byte, then a suffix from an earlier bucket;
    so within its bucket the length of the run and that suffix's rank give its place, before all directly sorted ones.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    ends = np.append(np.flatnonzero(padded[1:] != padded[:-1]), len(padded) - 1)
    after = np.repeat(ends, np.diff(np.append(-1, ends))) + 1  # the first place past the run of equal bytes
    rising = np.ones(len(padded), bool)
    inside = after < len(padded)
    rising[inside] = padded[after[inside]] > padded[: len(padded)][inside]
    need = np.zeros(len(padded), bool)
    front = wanted
    while len(front):
        need[front] = True
        front = np.unique(after[front[~rising[front]]])
        front = front[~need[front]]

    words = np.zeros(len(padded), np.uint64)
    for i in range(8):
        words[: len(padded) - i] |= padded[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.flatnonzero(need & rising)
    group = np.zeros(len(order), np.int64)
    active = np.arange(len(order))
    for at in range(0, depth, 8):
        key = words[np.minimum(order[active] + at, len(words) - 1)]
        by = np.lexsort((key, group[active]))
        order[active], key = order[active][by], key[by]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (group[active][1:] != group[active][:-1])))
        group[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
        if not len(active):
            break

    rank = np.zeros(len(padded), np.int64)
    falling = np.flatnonzero(need & ~rising)
    falling = falling[np.argsort(padded[falling], kind="stable")]
    bytes_up, bytes_down = padded[order], padded[falling]
    out, done = [], 0
    for c in np.unique(np.concatenate((bytes_up, bytes_down))):
        down = falling[np.searchsorted(bytes_down, c) : np.searchsorted(bytes_down, c, "right")]
        down = down[np.lexsort((rank[after[down]], after[down] - down))]
        both = np.concatenate((down, order[np.searchsorted(bytes_up, c) : np.searchsorted(bytes_up, c, "right")]))
        rank[both] = np.arange(done, done + len(both))
        done += len(both)
        out.append(both)
    out = np.concatenate(out) if out else np.empty(0, np.int64)
    keep = np.zeros(len(padded), bool)
    keep[wanted] = True
    return out[keep[out] & (out < n)]


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each place in text whether it is one of starts and its length bytes also begin at another of them."""
    order = sorted_suffixes(text, starts, length)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[(windows[a[alive] + at] == windows[b[alive] + at]).all(1)]
    hit = np.zeros(len(text), bool)
    hit[a[alive]] = hit[b[alive]] = True
    return hit


def _spans(hit: np.ndarray, base: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of hit as (from, to) relative to the part, by base, in which they lie."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out: list[list[tuple[int, int]]] = [[] for _ in base]
    part = np.searchsorted(base, edges[::2], "right") - 1
    for p, x, y in zip(part.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[p].append((x - int(base[p]), y - int(base[p])))
    return out


_SPANS = "array<struct<from:int,to:int>>"


def _sorted_chunks(rows: DataFrame, length: int) -> DataFrame:
    """(gram, body, spans) of passages (gram, body, n, data): which of the n strings of a passage stand in another place of the same gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            base = np.cumsum([0] + [len(h[3]) for h in held])[:-1]
            text = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            starts = np.concatenate([np.arange(s, s + h[2]) for s, h in zip(base, held, strict=True)])
            spans = _spans(repeated(text, starts, length), base)
            return pd.DataFrame({"gram": [h[0] for h in held], "body": [h[1] for h in held], "spans": [[{"from": x, "to": y} for x, y in s] for s in spans]})

        for batch in batches:
            for row in zip(batch["gram"], batch["body"], batch["n"], batch["data"], strict=True):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return rows.mapInPandas(run, f"gram long, body long, spans {_SPANS}")


#: Neighbouring strings of a block, by their distance from the gram.
BLOCK = 8
#: Repeated blocks and strings of a gram that may travel to each of its passages in one array.
KEYS_MOST = 2048


def _blocks(gram: int, n: int, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each of a passage's n strings; and its blocks, strings at BLOCK neighbouring distances from the gram: first and last string, distance,
    hash of the bytes that any of its strings holds (its core), and hash of all its strings."""
    b = np.frombuffer(data, np.uint8)
    places = np.flatnonzero(_gram_hashes(b, GRAM).view(np.int64) == gram)
    marks, cores = _gram_hashes(b, length)[:n], _gram_hashes(b, length - BLOCK + 1)
    string = np.arange(n)
    at = places[np.searchsorted(places, string)]
    part = (at - string) // BLOCK
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
    last = np.append(first[1:], n) - 1
    part = part[first]
    whole = _mix(_mix(_mix(marks[first] * _C[5] + marks[last]) + (last - first).astype(np.uint64)) + part.astype(np.uint64))
    return marks.view(np.int64), first, last, part, cores[at[first] - part * BLOCK].view(np.int64), whole.view(np.int64)


def _spans_of(marks: np.ndarray, first: np.ndarray, last: np.ndarray, whole: np.ndarray, keys: np.ndarray) -> list[dict]:
    """Runs of strings that keys name, one by one or as a block."""
    hit = np.isin(marks, keys)
    for f, g in zip(first[found := np.isin(whole, keys)].tolist(), last[found].tolist(), strict=True):
        hit[f : g + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"from": x, "to": y} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """As _sorted_chunks, for grams with so many passages that one task should not sort them: strings are counted by hash, of 128 bits with the gram's.

    A block's core must occur twice for any of its strings to repeat; if the block occurs twice, all do. Equal blocks of a batch, then of all, are one row with a count, so that a group of
    copies costs what its different wordings cost. Only where blocks of one core differ are their strings counted one by one. What repeats is then
    looked up by each passage: in one array for its gram, or, where a gram has too much for an array, by a join on each block and string.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple, list] = {}
            for gram, n, data in zip(batch["gram"], batch["n"], batch["data"], strict=True):
                marks, first, last, part, core, whole = _blocks(gram, n, data, length)
                for f, g, p, c, w in zip(first.tolist(), last.tolist(), part.tolist(), core.tolist(), whole.tolist(), strict=True):
                    out.setdefault((gram, p, c, w), [0, marks[f : g + 1]])[0] += 1
            yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["gram", "part", "core", "whole", "c", "marks"])

    kinds = materialize(rows.select("gram", "n", "data").mapInPandas(cut, "gram long, part int, core long, whole long, c long, marks array<long>"), "suffix-blocks")
    kinds = kinds.groupBy("gram", "part", "core", "whole").agg(F.sum("c").alias("c"), F.min("marks").alias("marks"))
    shared = kinds.groupBy("gram", "part", "core").agg(F.sum("c").alias("seen"), F.min("c").alias("least")).where("seen > 1").select("gram", "part", "core", (F.col("least") == 1).alias("differ"))
    kinds = materialize(kinds.join(shared, ["gram", "part", "core"]), "suffix-kinds")
    strings = kinds.where("differ").select("gram", "c", F.explode("marks").alias("key")).groupBy("gram", "key").agg(F.sum("c").alias("c"))
    keys = materialize(kinds.where("c > 1").select("gram", F.col("whole").alias("key")).unionByName(strings.where("c > 1").select("gram", "key")).distinct(), "suffix-keys")
    sizes = keys.groupBy("gram").agg(F.count(F.lit(1)).alias("keys"))
    sizes = materialize(sizes.select("gram", (F.col("keys") > KEYS_MOST).alias("crowded")), "suffix-crowded")
    lists = materialize(keys.join(sizes.where("not crowded"), "gram").groupBy("gram").agg(F.collect_list("key").alias("keys")), "suffix-lists")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for gram, n, data, keys in zip(batch["gram"], batch["n"], batch["data"], batch["keys"], strict=True):
                marks, first, last, _, _, whole = _blocks(gram, n, data, length)
                spans.append(_spans_of(marks, first, last, whole, keys))
            yield pd.DataFrame({"gram": batch["gram"], "body": batch["body"], "spans": spans})

    kind = f"gram long, body long, spans {_SPANS}"
    found = rows.join(lists, "gram").mapInPandas(look, kind)
    if not sizes.where("crowded").isEmpty():

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for gram, body, n, data in zip(batch["gram"], batch["body"], batch["n"], batch["data"], strict=True):
                    marks, first, last, _, _, whole = _blocks(gram, n, data, length)
                    string = np.arange(n)
                    yield pd.DataFrame({"gram": gram, "body": body, "key": np.concatenate((marks, whole)), "from": np.concatenate((string, first)), "to": np.concatenate((string, last)) + 1})

        spelt = rows.join(sizes.where("crowded").select("gram"), "gram").mapInPandas(spell, "gram long, body long, key long, from int, to int")
        spans = spelt.join(keys, ["gram", "key"]).groupBy("gram", "body").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
        found = found.unionByName(spans.select("gram", "body", F.col("spans").cast(_SPANS).alias("spans")))
    return materialize(found.where(F.size("spans") > 0), "suffix-counted")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary): its UTF-8 bytes without those covered by
    a length-byte string that starts in another place too, in the same or another row.

    Strings are brought together by their least gram: a run of strings with one least gram is a passage. A gram that occurs once is done
    with, unless its passage repeats itself. Equal passages are one, with a count: all their strings repeat. Others are stored once each, and the strings of all
    passages of a gram are compared by sorting suffixes; those of a gram with over CHUNK_PASSAGES passages by counting, which needs no task to hold them all. Rows with equal texts are told apart by nothing, so they share
    the answer. Null texts count as empty; a text under length bytes loses nothing; nulls in id_col and repeated rows stay as they are;
    other columns are ignored. length is GRAM at least.
    """
    work = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("doc", F.unhex(F.md5("text")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                data = text.encode()
                start, n, gram, tied = passages(data, length)
                if len(start):
                    body = np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + k + length - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)), np.uint64, len(start))
                    out.append(pd.DataFrame({"doc": [doc] * len(start), "start": start.astype(np.int32), "n": n.astype(np.int32), "gram": gram.view(np.int64), "body": body.view(np.int64), "tied": tied}))
            if out:
                yield pd.concat(out)

    cuts = materialize(work.select("doc", "text").mapInPandas(cut, "doc binary, start int, n int, gram long, body long, tied boolean"), "suffix-cuts")
    grams = cuts.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("body").alias("lo"), F.max("body").alias("hi"), F.max("tied").alias("tied")).where("c > 1 or tied")
    grams = materialize(grams.select("gram", ((F.col("lo") != F.col("hi")) | (F.col("c") == 1)).alias("mixed")), "suffix-grams")
    again = materialize(cuts.drop("tied").join(grams, "gram"), "suffix-again")

    mixed = again.where("mixed")
    bodies = materialize(mixed.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "start", "n")).alias("w")), "suffix-bodies")
    sizes = materialize(bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("bodies"), F.min("c").alias("least")).where("least = 1").select("gram", (F.col("bodies") > CHUNK_PASSAGES).alias("many")), "suffix-sizes")
    asked = bodies.join(sizes, "gram").groupBy("w.doc").agg(F.collect_list(F.struct("gram", "body", "w.start", "w.n", "many")).alias("asked"))
    asked = materialize(asked, "suffix-asked")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["asked"], strict=True):
                data = text.encode()
                rows += [(w["gram"], w["body"], w["n"], w["many"], data[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
            yield pd.DataFrame(rows, columns=["gram", "body", "n", "many", "data"])

    found = join_stored(work.select("doc", "text"), asked, ["doc"], items="asked").mapInPandas(fetch, "gram long, body long, n int, many boolean, data binary")
    found = materialize(found.dropDuplicates(["gram", "body"]), "suffix-found")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = found.where("not many").repartition(parts, "gram").sortWithinPartitions("gram").select("gram", "body", "n", "data")
    results = materialize(_sorted_chunks(few, length).where(F.size("spans") > 0), "suffix-results")
    if not sizes.where("many").isEmpty():
        results = results.unionByName(_counted(found.where("many").select("gram", "body", "n", "data"), length))

    whole = bodies.where("c > 1").select("gram", "body", F.lit(True).alias("whole"))
    shared = results.join(whole, ["gram", "body"], "left_anti")
    pairs = mixed.join(whole, ["gram", "body"]).select("doc", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"))
    pairs = pairs.unionByName(mixed.join(shared, ["gram", "body"]).select("doc", "start", F.inline("spans")).select("doc", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")))
    pairs = pairs.unionByName(again.where("not mixed").select("doc", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")))
    gone = materialize(pairs.distinct().groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("gone")), "suffix-gone")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            ids = batch["id"].astype(object).where(batch["id"].notna(), None)
            for i, text, gone in zip(ids, batch["text"], batch["gone"], strict=True):
                data, kept, removed, spans, at = text.encode(), [], 0, 0, 0
                if gone is not None:
                    last = -1
                    for x, y in sorted((g["from"], g["to"] + length - 1) for g in gone):
                        if x > last:
                            spans += 1
                            kept.append(data[at:x])
                        removed += max(0, y - max(x, at))
                        last = at = max(at, y)
                kept = b"".join([*kept, data[at:]])
                rows.append((i, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = join_stored(work, gone, ["doc"], "left", items="gone").select("id", "text", "gone")
    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInPandas(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
