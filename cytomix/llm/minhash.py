"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.llm.common import materialize
from cytomix.llm.components import components

BANDS, ROWS = 30, 6
SIZE = BANDS * ROWS
#: Most differing bits, of 128 one-bit samples, that a true pair at 0.80 may show (over 5 standard deviations above the mean).
FAR_BITS = 31

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the width-word shingles, sorted; a shorter text is one shingle, no words give none.

    bytes.lower() and bytes.split() follow exactly the rule wanted: A-Z only, and the
    white space 0x20 and 0x09-0x0D only.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = _mix(out * _MUL + h[i : i + n])
    return np.unique(out)


def superminhash(x: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The SuperMinHash signature of the hashes x, as 32-bit integers.

    Every element walks one random permutation of the slots, step by step for all elements
    at once; slot p(j) gets the minimum of u + j. Once all slots hold less than j + 1, later steps cannot
    lower any, and the walk stops: after one or two steps for long texts.
    """
    h = np.full(size, np.inf)
    steps = _MUL * np.arange(1, 2 * size, 2, dtype=np.uint64)
    at, rows = None, np.arange(len(x))
    for j in range(size):
        r = _mix(x + steps[j])
        k = j + (_mix(r ^ _MUL) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if at is None:
                at = np.tile(np.arange(size, dtype=np.int16), (len(x), 1))
                at[rows, first] = 0
            slot = at[rows, k].astype(np.int64)
            at[rows, k] = at[:, j]
        np.minimum.at(h, slot, (r >> np.uint64(11)) * 2.0**-53 + j)
        if h.max() < j + 1:
            break
    return (_mix(h.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.view(np.uint32).reshape(BANDS, ROWS).T:
        key = _mix(key * _MUL + column)
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, set_hash (of the whole shingle set), bands, and two words of one-bit samples.

    Sets so small that one other element already breaks the similarity link with equal sets only, and get no bands.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                x = shingles(text, width)
                digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None
                if 100 * len(x) >= percent * (len(x) + 1):
                    sig = superminhash(x)
                    bits = np.packbits((sig[:128] & 1).astype(np.uint8)).view(np.int64)
                    rows.append((i, len(x), digest, _band_keys(sig), int(bits[0]), int(bits[1])))
                else:
                    rows.append((i, len(x), digest, None, 0, 0))
            yield pd.DataFrame(rows, columns=["id", "n_shingles", "set_hash", "bands", "s1", "s2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n_shingles long, set_hash binary, bands array<long>, s1 long, s2 long")


def _sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "items": [shingles(t, width).view(np.int64) for t in batch["text"]]})

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids.hint("merge"), "id", "left_semi")
    return wanted.mapInPandas(run, "id long, items array<long>")


def _near(a: str, b: str, percent: int) -> Column:
    """What samples and sizes of two structs allow. Two documents share r elements at most, the smaller r of the two (r: those of n that any
    other candidate has), which bounds their similarity; samples far below the threshold rule a pair out too."""
    far = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    common = F.least(f"{a}.r", f"{b}.r")
    return (far <= FAR_BITS) & (100 * common >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - common))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("items").alias(f"x{end}")), end)
    pairs = pairs.withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return materialize(pairs.where(100 * F.col("common") >= percent * (F.size("xa") + F.size("xb") - F.col("common"))).select("a", "b").distinct(), "minhash-links")


def _star(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Each bucket's pivot p with the members m of other groups that may be near it."""
    pairs = members.join(pivots, "key").where((F.col("p.g") != F.col("m.g")) & (F.col("p.id") != F.col("m.id")) & _near("p", "m", percent))
    return materialize(pairs.select(F.least("p.id", "m.id").alias("a"), F.greatest("p.id", "m.id").alias("b")).distinct(), "minhash-pairs")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members m of different groups that can still be similar, by exact prefix filtering.

    Elements are ordered from rare to common. Two sets of the similarity share an element among the first few of both, and where the first
    shared one stands bounds the overlap. In a group of copies the first elements are each copy's own changes, so its common wording pairs nothing.
    """
    rows = sets.join(members.select(F.col("m.id").alias("id")), "id", "left_semi").select("id", F.explode("items").alias("item"))
    often = materialize(rows.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "minhash-often")
    shared = materialize(rows.join(often, "item"), "minhash-shared")
    by_id = Window.partitionBy("id")
    shared = shared.withColumn("rank", F.row_number().over(by_id.orderBy("c", "item"))).withColumn("kept", F.count(F.lit(1)).over(by_id))
    n = F.col("m.n")
    first = shared.join(members.withColumn("id", F.col("m.id")), "id").withColumn("at", F.col("rank") + n - F.col("kept"))
    first = materialize(first.where(F.col("at") <= n - F.ceil(percent * n / 100) + 1).select("item", "at", "m"), "minhash-prefix")
    other = first.select("item", F.col("at").alias("at_"), F.col("m").alias("p"))
    overlap = 1 + F.least(n - F.col("at"), F.col("p.n") - F.col("at_"))
    enough = (100 + percent) * overlap >= percent * (n + F.col("p.n"))
    pairs = first.join(other, "item").where((F.col("m.id") < F.col("p.id")) & (F.col("m.g") != F.col("p.g")) & enough & _near("m", "p", percent))
    return pairs.select(F.col("m.id").alias("a"), F.col("p.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Documents with equal shingle sets form a class whose smallest id stands for it. Classes that share a band are candidates. In
    each bucket all members are compared with a pivot first, the one with the most company in all its buckets, which in a group of copies is
    the original; then members outside the pivot's group get a pivot of their own. What two rounds of union-find leave apart is compared by exact prefix filtering,
    so no pair that shares a band is given up for a bucket's size, and a large group of copies costs rows in proportion to its size. Links are confirmed on the full sets.
    What the sketches can miss: a pair that shares no band, with a chance of about 7e-7 at a similarity of 0.85 and 1e-4 at 0.80, less above, and one whose one-bit samples differ in over FAR_BITS places,
    which is over 5 standard deviations off at 0.80. Either matters only where no third document links the two.

    Null and empty texts (and those without words) have n_shingles 0 and link with nothing. A row with a null id takes
    its class's component (null if it has none) and is kept. Repeated rows have one class and get the same answer; rows that share an id but no text are one document, sought by the text whose set has the smallest hash, and linked where any of its texts is. Other
    columns of docs are ignored. An empty table gives an empty result.
    """
    sig = materialize(sketches(docs, width, percent, id_col, text_col), "minhash-sig")
    classes = materialize(sig.where("id is not null and set_hash is not null").groupBy("set_hash").agg(F.min("id").alias("rep")), "minhash-classes")
    heads = sig.where("bands is not null").join(classes.select("set_hash", F.col("rep").alias("id")), ["set_hash", "id"]).groupBy("id").agg(F.min_by(F.struct("bands", "n_shingles", "s1", "s2"), "set_hash").alias("h")).select("id", "h.*")
    heads = materialize(heads.select("id", "bands", F.struct("id", F.col("n_shingles").alias("n"), "s1", "s2").alias("m")), "minhash-heads")

    entries = heads.select(F.explode("bands").alias("key"), "id")
    buckets = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "minhash-buckets")
    members = materialize(entries.join(buckets, "key"), "minhash-entries")
    company = materialize(members.groupBy("id").agg(F.sum("c").alias("w")), "minhash-company")
    sets = materialize(_sets(docs, company.select("id"), width, id_col, text_col), "minhash-sets")
    own = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    known = heads.select("id", "m").join(company, "id").join(materialize(own, "minhash-own"), "id", "left").withColumn("r", F.col("m.n") - F.coalesce("own", F.lit(0)))
    known = materialize(known.where(100 * F.col("r") >= percent * F.col("m.n")).select("id", "w", F.struct("m.*", "r").alias("m")), "minhash-known")
    members = materialize(members.select("key", "id").join(known, "id"), "minhash-members").select("key", F.struct("w", (-F.col("id")).alias("order"), "m.*").alias("m"))

    links = groups = None
    for last in (False, False, True):
        if groups is None:
            placed = members.withColumn("m", F.struct("m.*", F.col("m.id").alias("g")))
        else:
            placed = members.withColumn("node", F.col("m.id")).join(groups, "node", "left").select("key", F.struct("m.*", F.coalesce("component", "node").alias("g")).alias("m"))
            mixed = placed.groupBy("key").agg(F.min("m.g").alias("lo"), F.max("m.g").alias("hi")).where("lo <> hi").select("key")
            placed = materialize(placed.join(materialize(mixed, "minhash-mixed"), "key", "left_semi"), "minhash-mixed-members")
        first = placed.groupBy("key").agg(F.max("m").alias("p"))
        if groups is None:
            pairs = _star(placed, materialize(first, "minhash-pivots"), percent)
        elif not last:
            others = placed.join(materialize(first.select("key", "p.g"), "minhash-first"), "key").where("m.g <> g")
            pairs = _star(placed, materialize(others.groupBy("key").agg(F.max("m").alias("p")), "minhash-pivots"), percent)
        else:
            pairs = materialize(_prefix_pairs(placed.select("m").dropDuplicates(["m"]), sets, percent), "minhash-pairs")
        if pairs.isEmpty():
            if groups is None or last:
                break
            continue
        found = _linked(pairs, sets, percent)
        links = found if links is None else links.unionByName(found)
        groups = materialize(components(links), "minhash-groups")

    out = sig.select("id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    if groups is None:
        out = out.withColumn("component", F.col("rep"))
    else:
        out = out.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
