"""Quality rules: counted rules, and a log-likelihood ratio of hashed n-grams.

``measured`` reads every whole text once and writes its rule counts and the hash buckets of its
word n-grams to the shared folder.  ``train`` counts the buckets over every document (raw
corpus) and over the trusted ones (target).  ``judge`` adds up the log ratio of both multinomials
over a document, divides by its number of n-grams and keeps the document when the mean is at
least ``threshold``.  Ratios are fixed-point integers, so sums and verdicts do not depend on
the order of addition or on partitions.

Everything is DataFrame functions; the model is one row of ``buckets`` integers.

Null or empty text: no words, all counts 0, ``base_failed`` (fewer than 10 words), not kept.
Repeated rows are counted and judged each by itself; a null id is never trusted.  Empty tables
give an empty result and a model of equal weights.  Other columns are carried along; the
columns added here replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, let, total, written

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
PLACES = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

BUCKETS = 1 << 16
SCALE = 1_000_000
#: Mean log ratio (natural log) below which a document is rejected.
THRESHOLD = -0.2
#: Lengths of the n-grams that one multinomial counts together.
ORDERS = (1, 2)
#: Added to the n-gram count when dividing, so very short texts need more evidence.
PRIOR_NGRAMS = 20
#: Bound of the trusted sample; its ids are broadcast (8 bytes each).
MAX_TRUSTED = 500_000


def _repeat_words(hashes: Column) -> Column:
    """Words inside five-word windows that occur twice or more; ``hashes`` are those of the words in order."""
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - WINDOW + 1, F.lit(0))), lambda h, i: F.xxhash64(
        h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    covered = lambda places: total(F.transform(
        places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))))

    def packed(w: Column) -> Column:  # upper hash bits and place in one integer, which sorts fast
        low = F.lit(PLACES - 1).cast("long")
        of_place = lambda x: F.get(w, x.bitwiseAND(low).cast("int"))
        numbers = F.transform(w, lambda h, i: h.bitwiseAND(F.lit(-PLACES).cast("long")).bitwiseOR(i.cast("long")))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: let(of_place(x), lambda h: (of_place(F.get(s, i - 1)) == h) | (of_place(F.get(s, i + 1)) == h)))
            return F.sort_array(F.transform(same, lambda x: x.bitwiseAND(low).cast("int")))

        return let(F.sort_array(numbers), places)

    def paired(w: Column) -> Column:  # texts too long for that
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(same, lambda x: x["p"]))

        return let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), places)

    def of(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(F.size(F.array_distinct(w)) == n, F.lit(0).cast("long"))
            .when(n < PLACES, let(packed(w), covered)).otherwise(let(paired(w), covered))
        )

    return let(windows, of)


def measure(text: Column, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Column:
    """Struct of the rule counts, ``base_failed`` and ``grams``: the buckets of all word n-grams of these lengths, repeats kept.

    Counts of one text are exact but for equal 64-bit hashes of different five-word windows.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.when(t.rlike(f"[{SYMBOLS}]"), F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    size = F.lit(buckets).cast("long")

    def bucket(h: Column) -> Column:
        return F.pmod(h, size).cast("int")

    def of_order(hashes: Column, n: int) -> Column:
        if n == 1:
            return F.transform(hashes, bucket)
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - n + 1, F.lit(0)))
        return F.transform(starts, lambda h, i: bucket(F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)])))

    def grams(hashes: Column) -> Column:
        return F.concat(*[of_order(hashes, n) for n in orders])

    def of(pieces: Column, hashes: Column, repeats: Column) -> Column:
        count = F.size(hashes).cast("long")
        return F.struct(
            count.alias("n_words"),
            (F.char_length(t) - F.size(pieces) + 1).cast("long").alias("word_chars"),  # all but the blanks
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            ((count < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * count)).alias("base_failed"),
            grams(hashes).alias("grams"),
        )

    return let(F.split(t, BLANK), lambda pieces: let(
        F.transform(F.array_remove(pieces, ""), lambda w: F.xxhash64(w)),
        lambda hashes: let(_repeat_words(hashes), lambda repeats: of(pieces, hashes, repeats))))


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS,
             orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """``keep`` columns (default: all) of every document plus what ``measure`` finds, written to the shared folder."""
    keep = docs.columns if keep is None else keep
    found = docs.withColumn("_found", measure(F.col(text), buckets, orders))
    return written(found.select(*[c for c in keep if c not in (*COUNTS, "_found", "_grams", "_weights")], *[F.col("_found")[c].alias(c) for c in COUNTS],
                                F.col("_found")["grams"].alias("_grams")), "quality")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label: str = "quality", most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of the trusted target: rows labelled 1, at most ``most`` of them, the smallest by a hash of the id."""
    ids = labels.where((F.col(label) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(most)


def train(found: DataFrame, trusted: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, the fixed-point log ratio target / raw of every bucket.

    Each n-gram of each document is counted; counts are combined before the shuffle, which
    moves at most ``buckets`` rows a task.
    """
    flagged = found.select(F.col(id_col).alias("_id"), "_grams").join(
        F.broadcast(trusted.withColumn("_t", F.lit(1))), "_id", "left")  # ids bounded by MAX_TRUSTED
    counts = (
        flagged.select("_t", F.explode("_grams").alias("b"))
        .groupBy("b").agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    )
    every = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(F.broadcast(counts), "b", "left").na.fill(0)  # at most ``buckets`` rows
    rows = full.agg(
        F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("rows"),
        F.sum("raw").alias("r"), F.sum("target").alias("t"),
    )

    def ratio(x: Column) -> Column:
        return F.log((x["target"] + 1) / (F.col("t") + buckets)) - F.log((x["raw"] + 1) / (F.col("r") + buckets))

    return rows.select(F.transform("rows", lambda x: F.round(ratio(x) * SCALE).cast("long")).alias("weights"))


def judge(found: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``ratio`` (mean log ratio, natural log) and ``kept`` to every measured document."""
    def score(w: Column) -> Column:
        summed = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, b: a + F.get(w, b))
        return summed / F.lit(float(SCALE)) / (F.size("_grams") + PRIOR_NGRAMS)

    weighed = found.withColumn("_weights", model.select("weights").scalar())
    out = weighed.withColumn("ratio", score(F.col("_weights")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).drop("_weights", "_grams")


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
            buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, threshold: float = THRESHOLD, most_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Measure, train on these documents and their labels, and judge every document."""
    found = measured(docs, text, keep, buckets, orders)
    model = written(train(found, trusted_ids(labels, id_col, most=most_trusted), id_col, buckets), "quality-model")
    return judge(found, model, threshold)
