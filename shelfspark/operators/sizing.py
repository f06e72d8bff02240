"""Size-checked broadcasts and salting for everything larger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when it is measured below both bounds.
MAX_ROWS = 200_000
MAX_BYTES = 32 * 1024 * 1024
SALTS = 16


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure a side: at most ``max_rows`` rows and ``max_bytes`` of JSON text.

    The limit stops the scan early, so measuring a large side stays cheap.
    """
    sized = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b"))
    row = sized.agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is not known to be small: Spark may not broadcast it.

    Spark guesses a side's size from its compressed files and ignores what ``explode`` adds, so it would send sides of
    gigabytes through the driver.
    """
    return side.hint("merge")


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                spread: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Join a large side to a side that is usually small.

    A measured-small side is broadcast, which leaves the large side where it
    is.  Otherwise both sides shuffle on the key plus a salt: a key that holds a
    third of the large side is spread over ``salts`` tasks.  ``spread`` is a
    high-cardinality expression of the large side that picks the salt.
    """
    if is_small(small):
        return big.join(F.broadcast(small), on, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in big.columns])
    salted = big.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(copies), [*on, "_salt"], how).drop("_salt")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Spread a file scan with fewer splits than cores.

    One small file is one task however costly its rows are.  A large table has
    more splits than cores and is left as it is.  Only for plain scans: asking
    a plan with joins for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
