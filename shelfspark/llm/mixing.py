"""Mixing sources to target weights by a temperature.

Source token shares p are raised to an exponent a between 0 (all sources alike) and 1 (as they
are): w = p^a / sum p^a.  ``find_exponent`` bisects a: the smallest a at which no source is seen
more than ``max_repeats`` times, or the largest a at which the entropy of w reaches ``min_entropy``
(0 when no exponent does).  Each halving is one small aggregation over the table of sources.

``draw`` turns weights into copies.  The budget of a source holds some whole epochs and a remainder.  The
remainder is a block permutation: documents lie in 1024 hash blocks, and blocks are taken in the
order of a keyed permutation while they fit; the first that does not fit is cut into blocks again; in the
first of those that does not fit, documents are taken in hash order while they fit.  What a
source takes is thus everything before one cut, and no window holds more than a block of a block.

Null source: a source of its own.  Null or empty text: 0 tokens; such a row gets the epochs of its
source, and one more when it lies before the cut.  A source without tokens is seen once.  Repeated rows
share their place in the order and are taken together or not at all.  Empty tables give empty
results.  Other columns are carried along; the columns added here replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import lookup_join
from .common import written

BLOCK_BITS = 10
STEPS = 30


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame, source: str, tokens: Column, id_col: str, text: str, keep: list[str], seed: int) -> DataFrame:
    """``keep`` columns with the source key, tokens and the three places of the block permutation, written once."""
    own = {"weight", "repeats", "copies", "epochs", "_source", "_place", "_k0", "_k1", "_c0", "_c1", "_c2", "_rest"}
    place = F.xxhash64(F.col(id_col), F.col(text))
    block = lambda k: F.shiftright("_place", BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
    out = docs.select(*[c for c in docs.columns if c not in own]).withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")), "tokens": tokens, "_place": place})
    out = out.withColumns({
        "_k0": F.xxhash64(F.lit(seed), "_source", block(0)), "_k1": F.xxhash64(F.lit(seed), "_source", block(0), block(1))})
    kept = [c for c in keep if c not in own and c != "tokens"]
    return written(out.select(*kept, "_source", "tokens", "_place", "_k0", "_k1"), "mixing")


def source_stats(rows: DataFrame) -> DataFrame:
    """One row a source: n_docs, tokens and share of all tokens."""
    stats = rows.groupBy("_source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("in_source"))
    every = stats.agg(F.sum("in_source").alias("_every"))  # one row
    return stats.crossJoin(F.broadcast(every)).withColumn("share", F.coalesce(F.try_divide("in_source", "_every"), F.lit(0.0)))


def entropy_and_repeats(stats: DataFrame, a: float) -> tuple[float, float]:
    """Entropy of the weights at exponent a, and how often the most repeated source is seen when none is seen less than once."""
    p, power = F.col("share"), F.pow(F.col("share"), F.lit(a))
    row = stats.where("share > 0").agg(
        F.sum(power).alias("z"), F.sum(power * F.log(p)).alias("s"), F.max(p).alias("top"), F.min(p).alias("least")).first()
    if not row["z"]:
        return 0.0, 1.0
    return math.log(row["z"]) - a * row["s"] / row["z"], (row["least"] / row["top"]) ** (a - 1)


def find_exponent(stats: DataFrame, max_repeats: float | None = None, min_entropy: float | None = None) -> float:
    """Bisect the exponent for one of the two targets; repeats and entropy both fall as it rises."""
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("give max_repeats or min_entropy")

    def flat_enough(a: float) -> bool:  # holds below the answer for entropy, above it for repeats
        entropy, repeats = entropy_and_repeats(stats, a)
        return entropy >= min_entropy if max_repeats is None else repeats > max_repeats

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if max_repeats is None else high


def weights(stats: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """Add weight, repeats, whole epochs and the remainder in tokens to every source.

    ``budget``: tokens of the mixture.  Without it the mixture is the smallest that shows every document.
    """
    powered = stats.withColumn("_p", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    sums = powered.agg(F.sum("_p").alias("_z"), F.max("share").alias("_top"))  # one row
    out = powered.crossJoin(F.broadcast(sums)).withColumn("weight", F.coalesce(F.try_divide("_p", "_z"), F.lit(0.0)))
    seen = F.col("weight") * budget / F.col("in_source") if budget is not None else F.pow(F.col("share") / F.col("_top"), F.lit(a - 1))
    out = out.withColumn("repeats", F.round(F.when(F.col("in_source") > 0, seen).otherwise(1.0), 6))
    out = out.withColumn("epochs", F.floor("repeats"))
    rest = F.when(F.col("in_source") > 0, F.round((F.col("repeats") - F.col("epochs")) * F.col("in_source"))).otherwise(0)
    return out.select("_source", "weight", "repeats", "epochs", rest.cast("long").alias("_rest"))


def _cut(rows: DataFrame, place: str) -> DataFrame:
    """Per source: the first place whose tokens no longer fit into ``_rest`` (``_cut``, else null), and what is left before it."""
    sums = rows.groupBy("_source", "_rest", place).agg(F.sum("tokens").alias("_in"))
    running = F.sum("_in").over(Window.partitionBy("_source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_sum", running)
    return sums.groupBy("_source").agg(
        F.min(F.when(F.col("_sum") > F.col("_rest"), F.col(place))).alias("_cut"),
        (F.first("_rest") - F.coalesce(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.col("_sum"))), F.lit(0))).alias("_rest"))


def draw(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add weight, repeats and copies to the rows of ``keyed``."""
    slim = rows.select("_source", "tokens", "_place", "_k0", "_k1")
    first = written(_cut(lookup_join(slim, plan.select("_source", "_rest"), ["_source"]), "_k0"), "mixing-cut0")
    inside = lookup_join(slim, first.withColumnRenamed("_cut", "_k0").where("_k0 IS NOT NULL"), ["_source", "_k0"])
    second = written(_cut(inside, "_k1"), "mixing-cut1")
    inside = lookup_join(inside.drop("_rest"), second.withColumnRenamed("_cut", "_k1").where("_k1 IS NOT NULL"), ["_source", "_k1"])
    third = _cut(inside, "_place")
    cuts = written(
        plan.join(first.select("_source", F.col("_cut").alias("_c0")), "_source", "left")
        .join(second.select("_source", F.col("_cut").alias("_c1")), "_source", "left")
        .join(third.select("_source", F.col("_cut").alias("_c2")), "_source", "left"), "mixing-cuts")

    def before(place: str, cut: str, inside: Column) -> Column:
        return F.col(cut).isNull() | (F.col(place) < F.col(cut)) | ((F.col(place) == F.col(cut)) & inside)

    taken = before("_k0", "_c0", before("_k1", "_c1", before("_place", "_c2", F.lit(False))))
    drawn = lookup_join(rows, cuts, ["_source"], spread=F.col("_place"))
    return drawn.withColumn("copies", F.col("epochs") + F.when((F.col("_rest") > 0) & taken, 1).otherwise(0)).drop(
        "_source", "_place", "_k0", "_k1", "_c0", "_c1", "_c2", "_rest", "epochs")


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
        tokens: Column | None = None, max_repeats: float | None = None, min_entropy: float | None = None,
        budget: int | None = None, seed: int = 0) -> DataFrame:
    """Find the exponent for the target and draw copies of every document: adds tokens, weight, repeats and copies."""
    rows = keyed(docs, source, word_count(F.col(text)) if tokens is None else tokens, id_col, text,
                 docs.columns if keep is None else keep, seed)
    stats = written(source_stats(rows), "mixing-sources")
    plan = written(weights(stats, find_exponent(stats, max_repeats, min_entropy), budget), "mixing-plan")
    return draw(rows, plan)
