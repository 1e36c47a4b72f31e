"""Result tables as versioned Parquet: merges, publication by a pointer, retention, layout, metric sinks.

A store is a folder. Each table has one folder a version; a version is complete before a run's manifest, the one
small file written last, names it. Readers follow the newest manifest, so a crash between tables leaves the
previous state whole. No executor writes anything but Spark's own output.
"""

from __future__ import annotations

import importlib
import json
import logging
import time
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "membership": "entity_key string, resolved_id string, source_id string, source_key string, super_cluster_id string, run_id string, updated_at timestamp",
    "clusters": "resolved_id string, cluster_size bigint, edge_diversity bigint, match_density double, confidence_score double, primary_reason string, pair_density double, super_cluster_id string, run_id string, updated_at timestamp",
    "edges": "left_entity_key string, right_entity_key string, identifier_type string, identifier_value_norm string, rule_id string, first_seen_ts timestamp, last_seen_ts timestamp, run_id string",
    "identifiers": "entity_key string, identifier_type string, identifier_value_norm string, max_group_size int, is_hashed boolean",
    "skipped_groups": "run_id string, identifier_type string, identifier_value_norm string, group_size bigint, max_allowed int, sample_entity_keys string, reason string, skipped_at timestamp",
    "evidence": "run_id string, entity_key_a string, entity_key_b string, rule_id string, identifier_type string, match_value string, score double, created_at timestamp",
    "run_history": "run_id string, run_mode string, status string, started_at timestamp, ended_at timestamp, duration_seconds double, entities_processed bigint, edges_created bigint, clusters_impacted bigint, groups_skipped bigint, rounds int, warnings string, config_hash string, error_message string",
    "stage_metrics": "run_id string, stage_name string, stage_order int, started_at timestamp, duration_seconds double, rows_out bigint",
    "config_snapshot": "config_hash string, config_json string, created_at timestamp",
    "run_state": "table_id string, last_watermark_value timestamp, last_run_id string, updated_at timestamp",
    "dry_run_results": "run_id string, entity_key string, current_resolved_id string, proposed_resolved_id string, change_type string, current_cluster_size bigint, proposed_cluster_size bigint, created_at timestamp",
    "rule_audit": "run_id string, rule_id string, edges_created bigint, started_at timestamp, ended_at timestamp",
    "metrics_export": "metric_id string, run_id string, metric_name string, metric_value double, metric_type string, dimensions string, recorded_at timestamp, exported_at timestamp",
}

#: Days that rows of a table are kept, by their time column; null times stay.
RETENTION = {"skipped_groups": ("skipped_at", 30), "dry_run_results": ("created_at", 7), "metrics_export": ("recorded_at", 90)}
STALE_SECONDS = 600
#: Tables written at once.
WRITERS = 4


class Conflict(RuntimeError):
    """Another writer published, or is publishing, since the state that this one started from."""


def schema_rows(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, column_type) of every system table."""
    rows = [(t, *c.strip().split(" ", 1)) for t, s in SCHEMAS.items() for c in s.split(",")]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in order, with nulls for those that are missing; further columns stay behind them."""
    names = [c.strip().split(" ", 1) for c in schema.split(",")]
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in names], *[c for c in df.columns if c not in {n for n, _ in names}])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``target`` with the same keys; the rest stays."""
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def upsert_edges(stored: DataFrame, fresh: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Known edges keep first_seen and get last_seen; new ones get both."""
    keys = ["left_entity_key", "right_entity_key", "identifier_type"]
    now = F.lit(at).cast("timestamp")
    old = stored.select(*keys, F.col("identifier_value_norm").alias("old_value"), F.col("first_seen_ts").alias("old_first"), F.col("last_seen_ts").alias("old_last"), F.col("run_id").alias("old_run"))
    new = fresh.select(*keys, "identifier_value_norm").withColumn("is_new", F.lit(True))
    return old.join(new, keys, "full").select(
        *keys, F.coalesce("identifier_value_norm", "old_value").alias("identifier_value_norm"), F.concat(F.lit("exact_"), F.col("identifier_type")).alias("rule_id"), F.coalesce("old_first", now).alias("first_seen_ts"),
        F.when(F.col("is_new"), now).otherwise(F.col("old_last")).alias("last_seen_ts"), F.when(F.col("is_new"), F.lit(run_id)).otherwise(F.col("old_run")).alias("run_id"),
    )


def watermark_state(entities: DataFrame, run_id: str, at: datetime) -> DataFrame:
    return entities.groupBy("table_id").agg(F.max("watermark_value").alias("last_watermark_value")).select("table_id", "last_watermark_value", F.lit(run_id).alias("last_run_id"), F.lit(at).cast("timestamp").alias("updated_at"))


def retained(df: DataFrame, column: str, now: datetime, days: int) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")))


def kept(table: str, df: DataFrame, now: datetime) -> DataFrame:
    """The rows of a system table that its retention keeps."""
    return retained(df, RETENTION[table][0], now, RETENTION[table][1]) if table in RETENTION else df


def mark_exported(metrics: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    sent = ids.select("metric_id").distinct().withColumn("sent", F.lit(True))
    return metrics.join(sent, "metric_id", "left").withColumn("exported_at", F.when(F.col("sent"), F.lit(at).cast("timestamp")).otherwise(F.col("exported_at"))).drop("sent")


def unexported(metrics: DataFrame, limit: int = 1000) -> DataFrame:
    return metrics.where("exported_at is null").orderBy("recorded_at", "metric_id").limit(limit)


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 0, cluster_by: list[str] | None = None) -> None:
    """Hive partitions, Zstandard; optional bound of rows a file and clustering inside each."""
    out = df.sortWithinPartitions(*by, *cluster_by) if cluster_by else df
    writer = out.write.mode("overwrite").partitionBy(*by).option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._known: dict[str, dict[str, str]] = {}  # manifests never change
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        at = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if not s.getPath().getName().startswith((".", "_")))

    def _manifest(self, name: str) -> dict[str, str] | None:
        """What a manifest names; None if it is not written out."""
        if name not in self._known:
            path = self._path(f"{self.folder}/_manifests/{name}")
            stream = self._fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if not text.endswith("}"):
                return None
            self._known[name] = json.loads(text)
        return self._known[name]

    def current(self) -> dict[str, str]:
        return next((m for m in map(self._manifest, reversed(self._manifests())) if m is not None), {})

    def read(self, table: str) -> DataFrame:
        """The current version; columns that its schema has gained since are null."""
        version = self.current().get(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.parquet(f"{self.folder}/{table}/{version}")
        return conform(df, SCHEMAS[table]) if table in SCHEMAS else df

    def _create(self, number: int, text: str) -> None:
        """Write a manifest: creating a file is atomic, so one of several writers gets the number."""
        path = self._path(f"{self.folder}/_manifests/{number:08d}")
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if not self._fs.exists(path):
                raise
            raise Conflict(f"manifest {number} was written by another run") from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def initialize(self, reset: bool = False) -> None:
        """Make every system table, empty where it is missing or, with ``reset``, all of them; older versions stay on disk."""
        have = set() if reset else set(self.current())
        self.publish({name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items() if name not in have})

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Write a new version of each table, a few at a time, then the manifest that makes all of them visible at once.

        Raises ``Conflict`` if another writer has published, or is publishing, since the state read here. A manifest that
        was never written out is passed over once it is old.
        """
        names = self._manifests()  # first: what is published after this takes the number that follows
        if names and self._manifest(names[-1]) is None:
            age = time.time() - self._fs.getFileStatus(self._path(f"{self.folder}/_manifests/{names[-1]}")).getModificationTime() / 1000
            if age < STALE_SECONDS:
                raise Conflict(f"manifest {names[-1]} is being written by another run")
        before, version = self.current(), uuid.uuid4().hex

        def write(item: tuple[str, DataFrame]) -> None:
            name, df = item
            (conform(df, SCHEMAS[name]) if name in SCHEMAS else df).write.parquet(f"{self.folder}/{name}/{version}")

        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), tables.items()))  # raises what a write raises
        self._create(len(names), json.dumps(before | {name: version for name in tables}))

    def append(self, table: str, df: DataFrame) -> DataFrame:
        return self.read(table).unionByName(conform(df, SCHEMAS[table]), allowMissingColumns=True)


class JsonFormatter(logging.Formatter):
    """One JSON object a line, with the run's structured fields where a record has them."""

    FIELDS = ("run_id", "stage", "rows", "duration_seconds", "status", "mode", "table_id", "rule_id", "rounds", "clusters", "edges")

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage(), "logger": record.name}
        return json.dumps(out | {f: getattr(record, f) for f in self.FIELDS if hasattr(record, f)})


def webhook(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[list[dict]], None]:
    """A sink that posts each batch as JSON: ``{"metrics": [...]}``; an answer other than 2xx raises."""

    def send(rows: list[dict]) -> None:
        body = json.dumps({"metrics": rows}, default=str).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout):
            pass

    return send


EXPORTERS: dict[str, Callable[[list[dict]], None]] = {
    "stdout": lambda rows: print("\n".join(json.dumps(r, default=str) for r in rows)),
    "log": lambda rows: [logging.getLogger("kinweave.metrics").info(json.dumps(r, default=str)) for r in rows] and None,
    "prometheus": lambda rows: print(prometheus_text(rows)),
}


def exporter(name: str) -> Callable[[list[dict]], None]:
    """A registered sink, a URL to post to, or ``module:function``."""
    if name in EXPORTERS:
        return EXPORTERS[name]
    if name.startswith(("http://", "https://")):
        return webhook(name)
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"unknown exporter {name}")
    return getattr(importlib.import_module(module), function)


def prometheus_text(rows: list[dict]) -> str:
    lines = []
    for r in rows:
        labels = ",".join(f'{k}="{v}"' for k, v in sorted(json.loads(r.get("dimensions") or "{}").items()))
        lines.append(f"{r['metric_name']}{{{labels}}} {r['metric_value']}" if labels else f"{r['metric_name']} {r['metric_value']}")
    return "\n".join(lines)


def export(store: Store, sink: str, at: datetime, limit: int = 1000) -> int:
    """Send a bounded batch of metrics, oldest first, and mark it."""
    batch = unexported(store.read("metrics_export"), limit)
    rows = [r.asDict() for r in batch.collect()]  # at most ``limit``
    if rows:
        exporter(sink)(rows)
        ids = store.spark.createDataFrame([(r["metric_id"],) for r in rows], "metric_id string")
        store.publish({"metrics_export": mark_exported(store.read("metrics_export"), ids, at)})
    return len(rows)


def export_loop(store: Store, sink: str, clock: Callable[[], datetime], pause: Callable[[], bool], limit: int = 1000) -> int:
    """Export until ``pause()``, called when nothing is left, says to stop; returns how many metrics were sent."""
    sent = 0
    while True:
        n = export(store, sink, clock(), limit)
        sent += n
        if not n and not pause():
            return sent
