"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``v`` and ``label``, the smallest vertex reachable, for every vertex of ``links(a, b)``.

    Each round a vertex takes the smallest label around it, the vertex that gave its old label takes the smallest
    that any of its followers found, and labels are replaced by their labels; so trees join and paths halve, and the
    rounds are logarithmic in the number of vertices.  Labels are pre-aggregated per task, so a vertex with very many
    links is no hot group.  Null ends and loops are ignored.
    """
    pairs = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("near")), "b")
        least = around.groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        new = written(labels.join(least, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid")), "labels")
        hooks = new.groupBy(F.col("old").alias("v")).agg(F.min("mid").alias("hook"))
        hooked = written(new.join(hooks, "v", "left").select("v", "old", F.least("mid", "hook").alias("mid")), "labels")
        jump = hooked.select(F.col("v").alias("mid"), F.col("mid").alias("far"))
        done = written(hooked.join(jump, "mid").select("v", F.least("mid", "far").alias("label"), "old"), "labels")
        labels = done.select("v", "label")
        if not done.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
