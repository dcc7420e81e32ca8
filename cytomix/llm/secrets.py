"""Secret scan: pattern spans, and tokens that a character Markov model finds random. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and, for each, the least length of the text that must reach it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32

#: Characters of a token that the Markov models judge, and its least length.
TOKEN_CLASS, TOKEN_MIN = "[A-Za-z0-9+/_=-]", 20
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents and made-up strings that the models are fitted on, at most (about, for documents).
SAMPLE_DOCS, SAMPLE_STRINGS = 400, 3000
#: A token is reported when random is likelier by this factor (in nats), in all and per character.
LEAST_TOTAL, LEAST_MEAN = 15.0, 0.6

BACKOFF = 10.0
#: Spans of a text that are gathered in one run.
RUN = 256

_MARK, _OTHER = "\u0001", "\u0002"


def _pieces(text: Column, pattern: str) -> Column:
    """text cut at each match: even entries lie between matches, odd ones are matches. Lengths add up to the text's."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _spans(pieces: str, kind: int, keep: str) -> Column:
    """(start, kind, end) in code points of the matches p in an array made by _pieces for which keep holds."""
    nothing = "cast(array() as array<struct<start:long,kind:int,end:long>>)"
    span = f"array(named_struct('start', s.at, 'kind', {kind}, 'end', s.at + length(p)))"
    # spans gather in runs, so that a match copies no more than RUN of those before it
    fold = f"""aggregate({pieces}, named_struct('at', 0L, 'inside', false, 'run', {nothing}, 'runs', array({nothing})),
        (s, p) -> if(s.inside and {keep},
            named_struct('at', s.at + length(p), 'inside', false, 'run', if(size(s.run) < {RUN}, concat(s.run, {span}), {span}), 'runs', if(size(s.run) < {RUN}, s.runs, concat(s.runs, array(s.run)))),
            named_struct('at', s.at + length(p), 'inside', not s.inside, 'run', s.run, 'runs', s.runs)),
        s -> concat(flatten(s.runs), s.run))"""
    return F.expr(f"if(size({pieces}) > 1, {fold}, {nothing})")


def _token_pattern(least: int) -> str:
    return f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{{least},}}+"


def _pairs(tokens: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pairs = tokens.where(F.length("token") > 1).select("label", "token", at.alias("i"))
    code = F.ascii(F.expr("substring(token, i, 1)")) * 128 + F.ascii(F.expr("substring(token, i + 1, 1)"))
    return pairs.select("label", code.alias("pair")).groupBy("label", "pair").count()


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled strings (token, label): 1 for random ones, 0 for ordinary words and identifiers.

    Random: values that the base patterns find in the sampled documents, and digests written in the
    usual alphabets. Ordinary: the other words of those documents, alone and joined as identifiers.
    """
    n = max(1, docs.count())
    few = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, SAMPLE_DOCS / n))).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    values = F.array_union(F.regexp_extract_all("text", F.lit(ASSIGN), 2), F.array_union(F.regexp_extract_all("text", F.lit(f"({ACCESS})"), 1), F.regexp_extract_all("text", F.lit(f"([0-9a-f]{{{HEX_MIN},}})"), 1)))
    found = few.select(F.explode(F.filter(values, lambda v: F.length(v) >= TOKEN_MIN)).alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    bits = F.unhex(digest)
    made = docs.sparkSession.range(SAMPLE_STRINGS).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.substring(F.base64(bits), 1, 40)).when(F.col("id") % 4 == 2, F.substring(F.upper(F.regexp_replace(F.base64(bits), "[+/=]", "")), 1, 24)).otherwise(F.substring(F.regexp_replace(F.base64(bits), "[+/=]", ""), 1, 32)).alias("token")
    )
    plain = few.select(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), rf"{ACCESS}|[0-9a-f]{{{HEX_MIN},}}", " ").alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({_token_pattern(2)})"), 1)
    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.when(i % 3 == 0, F.concat_ws("_", F.get("w", i), F.get("w", i + 1))).when(i % 3 == 1, F.concat(F.lower(F.get("w", i)), F.initcap(F.get("w", i + 1)))).otherwise(F.upper(F.concat_ws("_", F.get("w", i), F.get("w", i + 1)))))
    plain = plain.select(words.alias("w")).select(F.explode(F.when(F.size("w") > 1, F.concat("w", joined)).otherwise(F.col("w"))).alias("token"))
    return found.unionByName(made).withColumn("label", F.lit(1)).unionByName(plain.withColumn("label", F.lit(0)))


def fit(labelled: DataFrame) -> str:
    """Fit one first-order Markov model on each label's strings; the log ratio of each pair of characters, as a JSON array.

    A row of the matrix leans on the label's overall frequencies with the weight of BACKOFF counts, and these on half a count for every character, so
    that a label without strings gives even chances. The counts that reach the driver are at most 2 * 128 * 128.
    """
    counts = {(r["label"], r["pair"]): r["count"] for r in _pairs(labelled).where("pair < 16384").collect()}
    codes = [ord(c) for c in SYMBOLS]
    logs = {}
    for label in (1, 0):
        ends = {b: sum(counts.get((label, a * 128 + b), 0) for a in codes) + 0.5 for b in codes}
        total = sum(ends.values())
        for a in codes:
            row = sum(counts.get((label, a * 128 + b), 0) for b in codes) + BACKOFF
            for b in codes:
                logs[label, a * 128 + b] = math.log((counts.get((label, a * 128 + b), 0) + BACKOFF * ends[b] / total) / row)
    ratio = [round(logs[1, i] - logs[0, i], 4) if (1, i) in logs else 0.0 for i in range(128 * 128)]
    return json.dumps(ratio)


def scan(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, added) for each row: arrays of (start, kind, end), code points, end exclusive.

    base: leftmost non-overlapping matches of each pattern that are long enough. added: whole runs of TOKEN_CLASS whose
    log-likelihood ratio is high enough and that overlap no base span. Null text counts as empty; repeated rows each get a row;
    other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col), F.inline(F.array(F.struct(_pieces(text, ASSIGN).alias("p0"), _pieces(text, ACCESS).alias("p1"), _pieces(text, f"[0-9a-f]{{{HEX_MIN},}}+").alias("p2"), _pieces(text, _token_pattern(TOKEN_MIN)).alias("p3")))))
    ratio = F.from_json(F.lit(model), "array<double>").alias("ratio")
    score = "aggregate(sequence(1, length(p) - 1), 0D, (t, i) -> t + element_at(ratio, ascii(substring(p, i, 1)) * 128 + ascii(substring(p, i + 1, 1)) + 1))"
    quoted = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    base = F.concat(
        _spans("p0", 0, f"length(regexp_extract(p, '{quoted}', 2)) >= {ASSIGN_MIN}"),
        _spans("p1", 1, f"length(p) >= {ACCESS_MIN}"),
        _spans("p2", 2, f"length(p) >= {HEX_MIN}"),
    )
    found = cut.select(id_col, "p3", ratio, base.alias("base"))
    found = found.select(id_col, F.inline(F.array(F.struct(F.array_sort("base").alias("base"), _spans("p3", 3, f"{score} >= greatest({LEAST_TOTAL}D, {LEAST_MEAN}D * (length(p) - 1))").alias("maybe")))))
    return found.select(id_col, "base", F.expr("filter(maybe, m -> not exists(base, b -> b.start < m.end and m.start < b.end))").alias("added"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _is(kind: int) -> Callable[[Column], Column]:
    """Whether a span is of this kind. One parameter only: Spark hands a second one the element's place."""
    return lambda span: span["kind"] == kind


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of scan()'s rows: counts by kind, a hash of the base spans, and all spans."""
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(id_col, *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))
