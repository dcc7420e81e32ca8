"""Line dedup by a log-template tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import join_stored, materialize

#: Leading tokens that choose a leaf of the tree, after the token count.
DEPTH = 3
#: Documents in which a template must occur to count as recurring.
MIN_DOCS = 5
#: Least share of a line's tokens that its template must fix.
SIMILAR = 0.6
#: Words beyond which a line is a passage, which recurs from its second document on, and the least share of tokens that passages of one wording have in common.
PASSAGE, NEAR = 50, 0.9
#: Least share of a line's tokens that are words, not variable fields; a line of fewer recurs only as it stands.
WORDS = 0.5
#: Words of a shingle, and shingles of a document's sketch, by which documents are told to be copies as wholes.
WIDTH, SKETCH = 5, 128

#: Fields that vary by their form: words with a digit or an at sign, and links. Possessive, so that long words take linear time.
VARIABLE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+|(?<!\S)[A-Za-z]{1,10}+://\S*+"


def _spaced(line: Column) -> Column:
    """The line's tokens, one space apart. Lines that have only single spaces skip the costlier expressions."""
    odd = line.rlike(r"[\t\x0B\f\r]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)


def _masked(line: Column) -> Column:
    """A spaced line with its variable fields replaced."""
    return F.when(line.rlike("[0-9@:]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row for each line with words: its document's key, place, masked form m, leaf of the tree, hash of m, and whether it is a passage.

    A line of mostly variable fields has no wording to be told by: it is its own form, and alone in its leaf.
    """
    lines = docs.select("key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("key", "at", F.explode(F.array(_spaced(F.col("line")))).alias("line")).where("line <> ''")
    lines = lines.select("key", "at", "line", F.explode(F.array(_masked(F.col("line")))).alias("m"))
    tokens = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit("")))
    variable = F.when(F.col("m").contains("<*>"), (F.length("m") - F.length(F.replace("m", F.lit("<*>"), F.lit("")))) / 3).otherwise(0)
    words = tokens + 1 - variable
    told = words >= WORDS * (tokens + 1)
    m = F.when(told, F.col("m")).otherwise(F.col("line"))
    leaf = F.when(told, F.xxhash64(tokens, F.substring_index("m", " ", DEPTH))).otherwise(F.xxhash64(tokens, "line", F.lit(1)))
    return lines.select("key", "at", m.alias("m"), leaf.alias("leaf"), F.xxhash64(m).alias("whole"), (words > PASSAGE).alias("passage"))


def led(rows: DataFrame, share: float) -> DataFrame:
    """(leaf, id, to) from rows (leaf, id, docs, of, f): within a leaf, the first row, by falling docs, that has at least this share of the leaf's of tokens in common in f; itself where none has."""
    lists = rows.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("docs")).alias("d"), "id", "of", "f"))).alias("rows"))

    def alike(a: Column, b: Column) -> Column:
        return (a["id"] == b["id"]) | (F.size(F.array_intersect(a["f"], b["f"])) >= share * a["of"])

    def lead(found: Column, x: Column) -> Column:
        return F.when(F.exists(found, lambda y: alike(x, y)), found).otherwise(F.concat(found, F.array(x)))

    lists = lists.select("leaf", "rows", F.aggregate("rows", F.slice("rows", 1, 1), lead).alias("leads"))
    moves = F.transform("rows", lambda x: F.struct(x["id"].alias("id"), F.element_at(F.filter("leads", lambda y: alike(x, y)), 1)["id"].alias("to")))
    return lists.select("leaf", F.explode(moves).alias("t")).select("leaf", "t.*")


def close(rows: DataFrame, share: float) -> DataFrame:
    """The rows (leaf, id, docs, of, f) that may have another of their leaf alike: f has a hash for each of the of places, and rows with at least this share of them in common differ in few places, so that of one
    more segments than these at least one is the same in both. All others are alike to none, and need no comparison."""
    cuts = (F.col("of") - F.ceil(share * F.col("of") - 1e-9) + 1).cast("int")
    start = lambda i: F.floor(i * F.col("of") / F.col("cuts")).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.xxhash64(i, F.slice("f", start(i) + 1, start(i + 1) - start(i))))
    segments = materialize(rows.withColumn("cuts", cuts).select("leaf", "id", F.explode(segments).alias("segment")), "lines-segments")
    shared = materialize(segments.groupBy("leaf", "segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", "segment"), "lines-shared")
    ids = materialize(join_stored(segments, shared, ["leaf", "segment"], "left_semi").select("leaf", "id").distinct(), "lines-close")
    return join_stored(rows, ids, ["leaf", "id"], "left_semi")


def recurring(lines: DataFrame, docs: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, whole, first, often): the masked lines that recur, and the smallest key that has their template.

    A line recurs often if min_docs different documents have its template; other passages recur from two documents on, as near-equal wording.

    lines has the hashes of all lines; wording is read again from docs, for one document of each form in question. A leaf holds the lines of one token count and leading tokens. Within it, a token that forms have at a place min_docs times, a form counting
    once for each document that has it, is fixed, any other is a variable field; a line whose fixed tokens are at least SIMILAR of all belongs to the template that they and
    wildcards make. A template that too few documents have is attached to the one of its leaf that recurs and has most tokens in common with it,
    at least SIMILAR of all, or else to another such template, and documents are counted after that. A leaf that too few documents reach cannot have a recurring template, and only the others are opened up.
    """
    seen = lines.select("key", "leaf", "whole", "passage").distinct().groupBy("leaf", "whole").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first"), F.max("passage").alias("passage"))
    seen = materialize(seen, "lines-forms")
    wide = seen.groupBy("leaf").agg(F.sum("docs").alias("all"), F.max("passage").alias("any")).where((F.col("all") >= min_docs) | (F.col("any") & (F.col("all") >= 2)))
    wide = materialize(wide.select("leaf"), "lines-leaves")
    opened = materialize(join_stored(seen, wide, ["leaf"], "left_semi"), "lines-candidates")
    first = materialize(opened.select(F.col("first").alias("key")).distinct(), "lines-first")
    texts = _occurrences(join_stored(docs, first, ["key"], "left_semi")).groupBy("leaf", "whole").agg(F.min("m").alias("t"))
    opened = materialize(opened.join(texts, ["leaf", "whole"]).withColumn("t", F.split("t", " ")), "lines-opened")
    tokens = opened.select("leaf", "whole", "docs", F.posexplode("t").alias("i", "token"))
    fixed = materialize(tokens.groupBy("leaf", "i", "token").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).select("leaf", "i", "token"), "lines-fixed")
    kept = tokens.join(fixed, ["leaf", "i", "token"]).groupBy("leaf", "whole").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("f"))
    hashes = F.transform("f", lambda x: F.xxhash64("leaf", x))
    shaped = opened.join(kept, ["leaf", "whole"]).where(F.size("f") >= SIMILAR * F.size("t")).select("leaf", "whole", "docs", "first", F.size("t").alias("n"), hashes.alias("f"), F.xxhash64("leaf", "f").alias("id"))
    shaped = materialize(shaped, "lines-shaped")
    having = materialize(join_stored(lines.select("leaf", "whole", "key"), shaped.select("leaf", "whole", "id"), ["leaf", "whole"]).select("leaf", "id", "key").distinct(), "lines-having")
    counts = having.groupBy("leaf", "id").agg(F.count(F.lit(1)).alias("docs"))
    groups = shaped.groupBy("leaf", "id", "n").agg(F.first("f").alias("f")).join(counts, ["leaf", "id"])
    groups = materialize(groups, "lines-templates")
    own, loose = groups.where(F.col("docs") >= min_docs), groups.where(F.col("docs") < min_docs)
    shared = F.size(F.array_intersect("f", "to_f"))
    near = loose.join(own.select("leaf", F.col("id").alias("to"), F.col("docs").alias("to_docs"), F.col("f").alias("to_f")), "leaf").withColumn("shared", shared).where(F.col("shared") >= SIMILAR * F.col("n"))
    near = materialize(near.groupBy("leaf", "id").agg(F.max(F.struct("shared", "to_docs", "to")).alias("b")).select("leaf", "id", "b.to"), "lines-near")
    loose = loose.join(near, ["leaf", "id"], "left_anti")
    enough = loose.groupBy("leaf").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).select("leaf")
    loose = materialize(loose.join(enough, "leaf", "left_semi"), "lines-loose")
    moved = own.select("leaf", "id", F.col("id").alias("to")).unionByName(near).unionByName(led(loose.withColumn("of", F.col("n")), SIMILAR))
    moved = materialize(moved, "lines-attached")
    often = join_stored(having, moved, ["leaf", "id"]).select("leaf", "to", "key").distinct().groupBy("leaf", "to").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first"))
    often = materialize(often.where(F.col("docs") >= min_docs).select("leaf", "to", "first"), "lines-often")
    often = materialize(shaped.select("leaf", "whole", "id").join(moved, ["leaf", "id"]).join(often, ["leaf", "to"]).select("leaf", "whole", "first", F.lit(True).alias("often")), "lines-recurring")
    rest = opened.where("passage").join(often, ["leaf", "whole"], "left_anti").withColumnRenamed("whole", "id")
    rest = materialize(rest.select("leaf", "id", "docs", "first", F.size("t").alias("of"), F.transform("t", lambda x, i: F.xxhash64(i, x)).alias("f")), "lines-passages")
    near = materialize(led(close(rest, NEAR), NEAR), "lines-led")
    moved = materialize(join_stored(rest, near, ["leaf", "id"], "left").select("leaf", "id", F.coalesce("to", "id").alias("to"), "docs", "first"), "lines-moved")
    heads = moved.groupBy("leaf", "to").agg(F.sum("docs").alias("all"), F.min("first").alias("first")).where("all >= 2")
    twice = moved.select("leaf", "to", F.col("id").alias("whole")).join(heads, ["leaf", "to"]).select("leaf", "whole", "first", F.lit(False).alias("often"))
    return materialize(often.unionByName(twice), "lines-known")


def sketched(texts: DataFrame) -> DataFrame:
    """(key, s): the SKETCH smallest hashes of the distinct WIDTH-word shingles of each text, in order; one row for each key. A text of fewer words is one shingle."""
    words = texts.select("key", F.explode(F.array(F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), ""))).alias("w"))
    last = F.greatest(F.size("w") - WIDTH, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftright(F.xxhash64(*[F.get("w", i + k) for k in range(WIDTH)]), 32).cast("int"))
    return words.select("key", F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH).alias("s")).groupBy("key").agg(F.first("s").alias("s"))


def whole_copies(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The pairs (key, first) of documents whose sets of shingles have at least this share of their union in common, as estimated on the smallest hashes of the union."""
    pairs = materialize(pairs.distinct(), "lines-pairs")
    keys = materialize(pairs.select("key").unionByName(pairs.select(F.col("first").alias("key"))).distinct(), "lines-keys")
    sketches = materialize(sketched(join_stored(texts, keys, ["key"], "left_semi")), "lines-sketches")
    both = pairs.join(sketches, "key").join(sketches.select(F.col("key").alias("first"), F.col("s").alias("of")), "first")
    union = F.slice(F.sort_array(F.array_union("s", "of")), 1, SKETCH)
    both = both.select("key", "first", "s", "of", F.explode(F.array(union)).alias("u"))
    common = F.size(F.array_intersect(F.array_intersect("s", "of"), "u"))
    return materialize(both.where(common >= share * F.size("u")).select("key", "first"), "lines-whole")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", copies: DataFrame | None = None, copy_share: float | None = None) -> DataFrame:
    """docs without the lines whose template recurs, with columns n_lines and n_dropped (long) added.

    A recurring template stays in one document, the one with the smallest id, so that no wording is lost altogether. Lines that differ
    only in variable fields share a template, if at least
    WORDS of their tokens are words; else they must be equal. A passage, a line of over PASSAGE words, recurs from its second document on; copies (id, group) may name
    documents that are copies as wholes, and a passage in fewer than min_docs documents then stays in those of the same group as the one that keeps it, so that they can
    still be found to be copies; with copy_share it also stays in documents that have at least that share of shingles in common with the one that keeps it. Blank lines stay. A null text stays null with no lines; a text whose lines all go becomes
    empty, and its row stays. Rows with one id and text are one document and get the same answer. All other columns of docs stay;
    own columns named n_lines or n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    id_key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    key = F.struct(id_key.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).alias("text"), key.alias("key"))
    texts = work.select("key", "text").where("text is not null")
    lines = materialize(_occurrences(texts).drop("m"), "lines-places")
    known = recurring(lines, texts, min_docs)
    marks = join_stored(lines, known, ["leaf", "whole"]).where("key <> first")
    if copies is not None:
        of = [materialize(copies.select(F.col("id").alias(f"{c}_id"), F.col("group").alias(f"{c}_group")), "lines-copies") for c in ("key", "first")]
        marks = marks.withColumns({f"{c}_id": F.col(f"{c}.id") for c in ("key", "first")})
        for c, group in zip(("key", "first"), of, strict=True):
            marks = join_stored(marks, group, [f"{c}_id"], "left")
        marks = marks.where(F.col("often") | (F.coalesce("key_group", "key_id") != F.coalesce("first_group", "first_id")))
    if copy_share is not None:
        marks = materialize(marks.select("key", "at", "first", "often"), "lines-marks")
        few = marks.where("not often")
        few = join_stored(few, whole_copies(few.select("key", "first"), texts, copy_share), ["key", "first"], "left_anti")
        marks = marks.where("often").unionByName(few)
    gone = marks.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    # a byte for each line up to the last one dropped, so that every line is looked up at once
    before = lambda i: F.when(i > 0, F.get("gone", i - 1)).otherwise(-1)
    flags = F.array_join(F.transform("gone", lambda at, i: F.concat(F.repeat(F.lit("0"), at - before(i) - 1), F.lit("1"))), "").cast("binary")
    gone = materialize(gone.select("key", flags.alias("flags"), F.size("gone").alias("gone")), "lines-gone")
    out = join_stored(work, gone, ["key"], "left", items=F.octet_length("flags"))
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda _, i: F.substr("flags", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    counts = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], *counts)
