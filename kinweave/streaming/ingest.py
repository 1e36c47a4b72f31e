"""Streaming shells over the batch engine: incremental runs per micro-batch, and run alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.plans.engine import Engine, RunConfig


def on_new_files(engine: Engine, stream: DataFrame, checkpoint: str, now: datetime | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch with rows triggers an incremental run; the watermark, with its look-back, makes replays idempotent."""

    def step(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            result = engine.run(RunConfig("INCREMENTAL"), now)
            if result.status == "FAILED":  # the batch is not committed and comes again
                raise RuntimeError(f"run {result.run_id} failed: {result.error}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_alerts(spark: SparkSession, store: str, checkpoint: str, sink) -> StreamingQuery:
    """Failed runs, as they are recorded in the store's folder, to ``sink(batch)``, each once.

    Every publication writes a new version of the history, so a run stands in many: each run and status passes once; the
    state is one entry a failed run of the last 30 days.
    """
    from kinweave.sources.store import SCHEMAS

    rows = spark.readStream.schema(SCHEMAS["run_history"]).option("recursiveFileLookup", "true").parquet(f"{store.rstrip('/')}/run_history")
    bad = rows.where(F.col("status").isin("FAILED", "ERROR", "INTERRUPTED")).withWatermark("started_at", "30 days").dropDuplicates(["run_id", "status", "started_at"])
    return bad.writeStream.foreachBatch(lambda b, _e: sink(b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
