"""Document fingerprints: weighted SimHash, likeness to edited and neighbouring texts, and search within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import join_stored, materialize

BITS = 256
#: Documents in a range of ids, about, and the most ranges (their bounds go through the driver).
RANGE_DOCS, RANGES = 2000, 4096
#: Fingerprints of one block that meet in a task at once, about.
PART = 1000

_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def fingerprint(text: str | None) -> np.ndarray:
    """The 256-bit fingerprint as 32 bytes. Terms are pairs of neighbouring words (a lone word is its own term), weighted
    by their length, as long words are rare. Each term's hash votes for or against every bit. No words: all zero.

    Votes are counted by hash byte: a table of the summed weights of its 256 values, times the signs of their bits.
    """
    words = (text or "").lower().split()
    if not words:
        return np.zeros(BITS // 8, np.uint8)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = np.fromiter(map(len, words), np.float64, len(words))
    if len(words) > 1:
        h, w = h[:-1] * _LANES[1] + h[1:], w[:-1] + w[1:]
    lanes = h[:, None] * _LANES + (h[:, None] >> np.uint64(29))
    lanes = (lanes ^ (lanes >> np.uint64(32))) * _LANES[2]
    lanes ^= lanes >> np.uint64(29)
    columns = lanes.view(np.uint8)
    votes = np.concatenate([np.bincount(columns[:, i], w, 256) @ _SIGNS for i in range(BITS // 8)])
    return np.packbits(votes > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def _ranges(keys: DataFrame) -> tuple[list[int], list[int]]:
    """Lower bounds of ranges of the column key, and the largest key in each. Both are at most RANGES long."""
    n = keys.count()
    parts = max(1, min(RANGES, -(-n // RANGE_DOCS)))
    low = keys.select(F.percentile_approx("key", [i / parts for i in range(parts)], 10 * RANGES)).head()[0] or []
    low = sorted({keys.agg(F.min("key")).head()[0], *low}) if n else []
    rows = keys.groupBy(_range_of(F.col("key"), low).alias("r")).agg(F.max("key").alias("top")).collect()
    return low, [r["top"] for r in sorted(rows)]


def _range_of(key: Column, low: list[int]) -> Column:
    return F.size(F.filter(F.lit(low), lambda b: b <= key)) - 1 if low else F.lit(0)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness and that to the next document (0 to 1).

    Documents follow each other by descending id, ties by text, null ids last; after the last comes the first. Edited: the
    last third (rounded down, in code points) gives way to as much of the start of the next text. Null text counts
    as empty. A sole row is its own successor. Other columns of docs are ignored; an empty table gives an empty result.

    Ids are cut into ranges; each range also gets a copy of the first row of the one that follows. One shuffle puts
    the ranges in order, and a pass over each partition needs two rows at a time.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, top = _ranges(base.select("key"))
    after = {t: (i + 1) % len(top) for i, t in enumerate(top)}
    parts = max(1, len(low))
    rows = base.withColumn("r", _range_of(F.col("key"), low)).withColumn("extra", F.lit(False))
    if after:
        to = F.element_at(F.create_map(*[F.lit(x) for kv in after.items() for x in kv]), F.col("key")) if len(after) < 200 else F.get(F.lit([after[t] for t in top]), F.array_position(F.lit(top), F.col("key")).cast("int") - 1)
        copies = F.when(F.col("key").isin(*top) if len(top) < 200 else F.array_contains(F.lit(top), F.col("key")), F.array(F.struct("r", "extra"), F.struct(to.cast("int").alias("r"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("r", "extra")))
        rows = base.withColumn("r", _range_of(F.col("key"), low)).withColumn("extra", F.lit(False)).select("id", "key", "text", F.inline(copies))
    ordered = rows.repartition(parts, "r").sortWithinPartitions("r", "extra", F.desc("key"), "text")

    def record(row: tuple, follow: tuple) -> tuple:
        i, text, mark = row
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[1][:k] if k else text
        edited_mark = fingerprint(edited)
        return (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark.tobytes().hex(), edited_mark.tobytes().hex(), likeness(mark, edited_mark), likeness(mark, follow[2]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_range, closed = None, None, False
        for batch in batches:
            out = []
            ids = batch["id"].astype(object).where(batch["id"].notna(), None)
            for i, r, extra, text in zip(ids, batch["r"], batch["extra"], batch["text"], strict=True):
                if r != last_range:
                    last, last_range, closed = None, r, False
                if closed:
                    continue
                row = (i, text, fingerprint(text))
                if last is not None:
                    out.append(record(last, row))
                last, closed = row, bool(extra)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = ordered.select("id", "r", "extra", "text").mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _differing(a: str, b: str) -> Column:
    """Differing bits of two hex columns."""
    return sum((F.bit_count(F.conv(F.substring(a, i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 8), 16, 10).cast("long"))) for i in range(1, BITS // 4, 8)), F.lit(0))


def _cuts(radius: int) -> list[tuple[int, int]]:
    """The hex digits cut into radius + 2 blocks, of which fingerprints at most radius bits apart agree in two at least."""
    digits, n = BITS // 4, radius + 2
    at = [round(digits * i / n) for i in range(n + 1)]
    return list(zip(at, at[1:]))


def _tables(mark: str, radius: int) -> Column:
    """The key of a fingerprint in each permuted table: one for each two blocks."""
    cuts = _cuts(radius)
    return F.array(*[F.xxhash64(F.lit(i), *[F.substring(mark, a + 1, b - a) for a, b in two]) for i, two in enumerate(combinations(cuts, 2))])


def near_counts(marks: DataFrame, radius: int = 3, mark_col: str = "fingerprint") -> DataFrame:
    """(mark_col, n_near) for each fingerprint: how many other rows have one at most radius bits away, equal ones included.

    Equal fingerprints are one, with a count. A table for each two blocks brings close ones together, so none is missed; a pair counts in the first table
    that has it. Pairs are counted where they meet, not stored: a crowded block is cut into parts of about PART, and each part meets each. Null fingerprints are left out.
    """
    classes = materialize(marks.where(F.col(mark_col).isNotNull()).groupBy(F.col(mark_col).alias("mark")).agg(F.count(F.lit(1)).alias("size")), "simhash-classes")
    entries = classes.select("mark", "size", F.posexplode(_tables("mark", radius)).alias("t", "block"))
    shared = materialize(entries.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "simhash-blocks")
    rows = join_stored(entries, shared, ["block"]).withColumn("mine", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j")))
    rows = rows.select("block", "t", "mark", "size", "mine", F.explode(cells).alias("cell")).select("block", "t", "mark", "size", "mine", "cell.*")
    cuts, two = _cuts(radius), list(combinations(range(radius + 2), 2))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        p, q = (group[group["mine"] == group[c]] for c in ("i", "j"))
        one, other = two[group["t"].iloc[0]]
        x, y = (np.frombuffer(bytes.fromhex("".join(g["mark"])), np.uint64).reshape(len(g), BITS // 64) for g in (p, q))
        near = np.zeros((len(x), len(y)), np.int64)
        for k in range(x.shape[1]):
            near += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
        near = (near > 0) & (near <= radius)
        for b in range(other + 1):  # this table is the first that has the pair if no other block before its second one agrees
            u, v = (np.array([int(m[cuts[b][0] : cuts[b][1]], 16) for m in g["mark"]], np.uint64) for g in (p, q))
            near &= (u[:, None] == v) == (b in (one, other))
        found = [(p["mark"], near @ q["size"].to_numpy())]
        if group["i"].iloc[0] != group["j"].iloc[0]:
            found.append((q["mark"], near.T @ p["size"].to_numpy()))
        out = pd.concat([pd.DataFrame({"mark": m.to_numpy(), "n": n}) for m, n in found])
        return out[out["n"] > 0]

    met = rows.groupBy("block", "i", "j").applyInPandas(count, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    return classes.join(met, "mark", "left").select(F.col("mark").alias(mark_col), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_near"))


def within_radius(marks: DataFrame, radius: int = 6, id_col: str = "doc_id", mark_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints at most radius bits apart, and the class of each row.

    Returns (pairs: a, b, distance, over smallest ids of classes) and (members: id_col, class_id). Rows with equal
    fingerprints form a class. The digits are cut into radius + 2 blocks, of which a close pair agrees in two at least; a table
    for each two blocks brings such pairs together, so none is missed. Null fingerprints have no class.
    """
    rows = marks.select(F.col(id_col).alias("id"), F.col(mark_col).alias("mark"))
    classes = materialize(rows.where("mark is not null").groupBy("mark").agg(F.min("id").alias("head")), "simhash-classes")
    entries = classes.select("head", "mark", F.explode(_tables("mark", radius)).alias("block"))
    other = entries.select(F.col("head").alias("head_"), F.col("mark").alias("mark_"), "block")
    far = _differing("mark", "mark_")
    pairs = entries.join(other, "block").where((F.col("head") < F.col("head_")) & (far <= radius)).select(F.col("head").alias("a"), F.col("head_").alias("b"), far.alias("distance")).distinct()
    members = rows.join(classes, "mark", "left").select(F.col("id").alias(id_col), F.col("head").alias("class_id"))
    return pairs, members
