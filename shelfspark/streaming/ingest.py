"""Incremental ingest and embedding as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators import embedding as E
from ..operators.tables import last_per, plan_upserts
from ..schemas import ATTEMPTS, RECORDS
from ..sources.deltas import read_table, write_delta

VECTORS = "key string, text_hash string, model string, dim int, embedding array<float>"


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_stream(updates: DataFrame, base_path: str, checkpoint: str, now, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch of record updates into the table at ``base_path`` (X7), see ``sources.deltas``.

    A batch writes the buckets of the records that it changes and nothing else.  The version is the batch id and
    builds on the versions before it, so a replayed batch gives the same table; an update with an unchanged hash changes nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        base = read_table(batch.sparkSession, base_path, RECORDS, ["id"], version)
        plan = plan_upserts(base, batch, now).where("action <> 'unchanged'").drop("action")
        write_delta(plan, base_path, ["id"], version)

    return _start(updates, each, checkpoint, trigger)


def embed_stream(items: DataFrame, vectors_path: str, attempts_path: str, embedder: E.Embedder, model: str, dim: int,
                 checkpoint: str, max_attempts: int = C.MAX_ATTEMPTS, trigger: dict | None = None) -> StreamingQuery:
    """Embed what each micro-batch of ``items[key, text, text_hash]`` still lacks.

    Failures are tried again until they succeed or reach ``max_attempts``, which
    empties the queue.  An item written again after a give-up starts over.  Every
    attempt is written before anything is derived from it, so the embedder never
    runs twice for one attempt.  A batch writes its own vectors and attempts as deltas
    of both tables, and removes the attempts of items that succeeded.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1
        wanted = last_per(batch, ["key"])
        keys = wanted.select("key")
        vectors = read_table(spark, vectors_path, VECTORS, ["key"], version)
        before = read_table(spark, attempts_path, ATTEMPTS, ["key"], version).join(keys, "key", "left_semi")
        attempts = E.requeue_rewritten(before, batch)
        fresh = spark.createDataFrame([], VECTORS)
        todo = E.embed_worklist(wanted, vectors, model, dim)
        for turn in range(max_attempts):
            folder = f"{vectors_path}/results-{batch_id}-{turn}"
            E.embed(todo, embedder).write.mode("overwrite").parquet(folder)
            results = spark.read.parquet(folder)
            fresh = E.store_vectors(fresh, results, model)
            attempts = E.apply_results(attempts, results, max_attempts)
            failed = results.where("error IS NOT NULL").select("key")
            if not failed.limit(1).collect():
                break
            todo = wanted.join(failed, "key", "left_semi")
        write_delta(fresh, vectors_path, ["key"], version)
        write_delta(attempts, attempts_path, ["key"], version, before.select("key").join(attempts.select("key"), "key", "left_anti"))

    return _start(items, each, checkpoint, trigger)
