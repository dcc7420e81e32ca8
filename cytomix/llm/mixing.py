"""Mixing sources to target weights by temperature. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.llm.common import join_stored, materialize

#: Share of the largest possible entropy that the weights should have, and the most times a source may be read through.
TARGET_ENTROPY, MAX_REPEATS = 0.95, 4.0
#: Documents in a block, about.
BLOCK_DOCS = 500
#: Powers tried at once in a step of the bisection, and its steps: together they settle the power to under 1e-9.
POWERS, STEPS = 31, 6
SEED = 11


def weighted(totals: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """totals (source, tokens, ...) with weight: each source's token share to a power, normalised.

    The power is 1 for proportional weights and 0 for equal ones. Bisection finds the largest power whose weights reach the given share of
    the largest entropy; then, where a source would be read more than max_repeats times within the budget (all tokens by default), the
    smallest power at which none is. Sources without tokens weigh nothing. Every step is one sum over the sources for several powers, so that they may be any number.
    """
    row = totals.agg(F.count(F.when(F.col("tokens") > 0, 1)).alias("k"), F.sum("tokens").alias("total")).head()
    if not row["k"]:
        return totals.withColumn("weight", F.lit(0.0))
    budget = row["total"] if budget is None else budget
    share = F.log(F.col("tokens") / F.lit(float(row["total"])))
    have = totals.where("tokens > 0").select(share.alias("l"), "tokens")

    def at(powers: list[float]) -> dict[float, tuple[float, float, float]]:
        """For each power the sum of the raw weights, the entropy, and the most times that a source is read."""
        raw = F.exp(F.col("p") * F.col("l"))
        rows = have.withColumn("p", F.explode(F.array(*map(F.lit, powers)))).groupBy("p").agg(F.sum(raw).alias("z"), F.sum(raw * F.col("p") * F.col("l")).alias("e"), F.max(raw / F.col("tokens")).alias("m"))
        return {r["p"]: (r["z"], math.log(r["z"]) - r["e"] / r["z"], budget * r["m"] / r["z"]) for r in rows.collect()}

    def bisect(good: Callable[[float, float], bool]) -> float:
        """The largest power at which good(entropy, reads) holds, given that it holds at 0 if anywhere."""
        low, high = 0.0, 1.0
        for step in range(STEPS):
            powers = [low + (high - low) * i / (POWERS + 1) for i in range(1, POWERS + 1)] + ([1.0] if step == 0 else [])
            found = at(powers)
            passed = [p for p in powers if good(*found[p][1:])]
            if step == 0 and 1.0 in passed:
                return 1.0
            low = max([low, *passed])
            high = min([high, *(p for p in powers if p > low)])
        return low

    power = bisect(lambda h, _: h >= entropy * math.log(row["k"]) - 1e-12)
    if at([power])[power][2] > max_repeats + 1e-9:
        power = min(1.0, bisect(lambda _, reads: reads > max_repeats + 1e-9) + 1e-9)
    return totals.withColumn("weight", F.when(F.col("tokens") > 0, F.exp(F.lit(power) * share) / F.lit(at([power])[power][0])).otherwise(0.0))


def _within(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows (by, order, size, left), summed by order, those in which left falls when sizes are taken in that order; left becomes what is left of it there."""
    sums = rows.groupBy(*by, order).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    before = F.sum("size").over(Window.partitionBy(*by).orderBy(order)) - F.col("size")
    return sums.withColumn("before", before).where("before < left and before + size >= left").select(*by, order, (F.col("left") - F.col("before")).alias("left"))


def mix(docs: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with columns n_tokens, weight, copies, block and place added: how often each row is used, and where.

    Tokens are runs without white space. Every source has its weight times the budget (all tokens by default) to spend: whole passes over its rows,
    then the start of a random order. That order is by blocks, and by hash within a block. Where the budget ends is found in a wide range of blocks, then in a block, then among its rows, so
    no task holds a whole source, nor all its blocks. A row is used again when the budget ends within or
    after its first token. Sorting by block, then place, gives the random order. copies is 0 for rows that the budget leaves out. Rows move nowhere, unless there are so many sources that their figures cannot be broadcast.

    A null source is a source of its own; null and empty texts have no tokens and get one copy if their source has weight or holds no
    tokens at all. Repeated rows count each. Columns of docs with the added names are replaced; all others stay, whatever their names.
    """
    added = ("n_tokens", "weight", "copies", "block", "place")
    kept = [c for c in docs.columns if c not in added]
    source = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), source.alias("source"), tokens.alias("n_tokens"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("place"))
    sizes = materialize(rows.select("source", "place", "n_tokens"), "mix-sizes")
    totals = materialize(sizes.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-totals")
    spend = float(totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0] if budget is None else budget)
    due = F.lit(spend) * F.col("weight")
    plan = weighted(totals, entropy, max_repeats, spend).select("source", "tokens", "weight", F.ceil(F.col("n") / BLOCK_DOCS).alias("blocks"), F.when(F.col("tokens") > 0, F.floor(due / F.nullif("tokens", F.lit(0)))).otherwise(1).alias("full"))
    plan = materialize(plan.withColumn("left", F.when(F.col("tokens") > 0, due - F.col("full") * F.col("tokens")).otherwise(0.0)).drop("tokens"), "mix-plan")
    block = F.xxhash64(F.pmod(F.col("place"), F.col("blocks")), F.lit(SEED))

    # Where the rest of each source's budget ends: the range of blocks, the block, then the row in it.
    sizes = join_stored(sizes, plan, ["source"]).select("source", "left", block.alias("block"), "place", F.col("n_tokens").alias("size")).withColumn("range", F.shiftright("block", 54))
    ranges = materialize(_within(sizes, ["source"], "range"), "mix-ranges")
    ends = materialize(_within(join_stored(sizes.drop("left"), ranges, ["source", "range"]), ["source", "range"], "block").drop("range"), "mix-ends")
    last = join_stored(sizes.drop("left", "range"), ends, ["source", "block"]).groupBy("source", "block", "place").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    last = last.withColumn("before", F.sum("size").over(Window.partitionBy("source", "block").orderBy("place")) - F.col("size"))
    stops = materialize(last.where("before < left").groupBy("source", F.col("block").alias("end")).agg(F.max("place").alias("stop")), "mix-stops")

    out = join_stored(join_stored(rows, plan, ["source"]), stops, ["source"], "left").withColumn("block", block)
    more = F.when(F.col("end").isNull(), F.col("left") > 0).otherwise((F.col("block") < F.col("end")) | ((F.col("block") == F.col("end")) & (F.col("place") <= F.col("stop"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_tokens", "weight", (F.col("full") + more.cast("long")).cast("long").alias("copies"), "block", "place")
