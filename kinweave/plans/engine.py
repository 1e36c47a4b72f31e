"""A run: extract, link, resolve, score, profile, publish - full, incremental or dry."""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import source_id, source_key
from kinweave.operators import edges as E
from kinweave.operators import extract, fuzzy, preview, scoring, survivorship
from kinweave.operators.components import cut, resolved, scratch
from kinweave.plans.config import Config, ConfigError
from kinweave.sources.readers import preflight
from kinweave.sources.store import Conflict, Store, kept, upsert, upsert_edges, watermark_state

log = logging.getLogger("kinweave")
STALE_HOURS = 4


@dataclass
class RunConfig:
    mode: str = "FULL"
    dry_run: bool = False
    strict: bool = False
    max_iters: int | None = None  # bound of the rounds; the configuration's if not given

    def __post_init__(self):
        self.mode = {"INCR": "INCREMENTAL"}.get(self.mode.upper(), self.mode.upper())
        if self.mode not in ("FULL", "INCREMENTAL"):
            raise ConfigError(f"unknown mode {self.mode}")


@dataclass
class RunResult:
    run_id: str
    status: str
    entities: int = 0
    edges: int = 0
    clusters: int = 0
    groups_skipped: int = 0
    rounds: int = 0
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    summary: dict | None = None


class Engine:
    """Runs a configuration over sources that ``read`` opens, with its state in ``store``."""

    def __init__(self, spark: SparkSession, config: Config, read, store: Store):
        self.spark, self.config, self.read, self.store = spark, config, read, store

    def run(self, options: RunConfig | None = None, now: datetime | None = None) -> RunResult:
        options = options or RunConfig()
        now = now or datetime.now(UTC).replace(tzinfo=None)
        result = RunResult(uuid.uuid4().hex, "RUNNING")
        started, self._stages = time.time(), []
        history = self.store.read("run_history")
        running = history.where("status = 'RUNNING'").where(F.col("started_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {STALE_HOURS} HOURS"))
        if not running.isEmpty():
            raise ConfigError("another run is in progress")
        history = history.withColumn("status", F.when(F.col("status") == "RUNNING", "INTERRUPTED").otherwise(F.col("status")))
        try:
            self.store.publish({"run_history": history.unionByName(self._row(result, options, now, 0.0))})
        except Conflict as e:  # of two runs that start at once, one gets the manifest
            raise ConfigError("another run is in progress") from e
        with scratch(self.spark):
            return self._recorded(options, result, now, started)

    def _recorded(self, options: RunConfig, result: RunResult, now: datetime, started: float) -> RunResult:
        tables: dict[str, DataFrame] = {}
        try:
            result.warnings += preflight(self.spark, self.config, self.read)
            tables = self._compute(options, result, now)
        except Exception as e:  # noqa: BLE001  a failed run is recorded and returned
            log.exception("run failed", extra={"run_id": result.run_id})
            result.status, result.error = "FAILED", str(e)[:2000]
            tables = {}
        done = time.time() - started
        history = self.store.read("run_history").where(F.col("run_id") != result.run_id)
        tables["run_history"] = history.unionByName(self._row(result, options, now, done))
        tables["stage_metrics"] = self.store.append("stage_metrics", self.spark.createDataFrame(self._stages, "run_id string, stage_name string, stage_order int, started_at timestamp, duration_seconds double, rows_out bigint"))
        digest = self.config.fingerprint()
        snapshots = self.store.read("config_snapshot")
        if snapshots.where(F.col("config_hash") == digest).isEmpty():
            tables["config_snapshot"] = snapshots.unionByName(self.spark.createDataFrame([(digest, json.dumps(self.config.to_dict()), now)], snapshots.schema))
        metrics = [(uuid.uuid4().hex, result.run_id, f"resolve_{k}", float(v), "gauge", "{}", now, None) for k, v in (("entities", result.entities), ("edges", result.edges), ("clusters", result.clusters), ("groups_skipped", result.groups_skipped), ("duration_seconds", done))]
        old = self.store.read("metrics_export")
        tables["metrics_export"] = old.unionByName(self.spark.createDataFrame(metrics, old.schema))
        tables = {name: kept(name, df, now) for name, df in tables.items()}
        self.store.publish(tables)
        return result

    def _row(self, r: RunResult, o: RunConfig, now: datetime, seconds: float) -> DataFrame:
        schema = self.store.read("run_history").schema
        ended = None if r.status == "RUNNING" else datetime.now(UTC).replace(tzinfo=None)
        row = (r.run_id, o.mode, r.status, now, ended, seconds, r.entities, r.edges, r.clusters, r.groups_skipped, r.rounds, json.dumps(r.warnings), self.config.fingerprint(), r.error)
        return self.spark.createDataFrame([row], schema)

    def _stage(self, name: str, df: DataFrame, run_id: str) -> tuple[DataFrame, int]:
        began, at = time.time(), datetime.now(UTC).replace(tzinfo=None)
        out = cut(df)
        n = out.count()
        self._stages.append((run_id, name, len(self._stages) + 1, at, time.time() - began, n))
        return out, n

    def _compute(self, options: RunConfig, result: RunResult, now: datetime) -> dict[str, DataFrame]:
        spark, config, store, run_id = self.spark, self.config, self.store, result.run_id
        state = {r.table_id: r.last_watermark_value for r in store.read("run_state").collect()}  # a row a source
        incremental = options.mode == "INCREMENTAL" and not store.read("membership").isEmpty()
        delta, result.entities = self._stage("entities", extract.entities(spark, config, self.read, state, incremental), run_id)
        if not result.entities:
            result.status = "SUCCESS_NO_CHANGES"
            return {}
        fresh, _ = self._stage("identifiers", extract.identifiers(spark, config, self.read, state, incremental), run_id)
        old_members, old_ids = store.read("membership"), store.read("identifiers")
        if incremental:
            # a re-read entity gives up its old identifiers; every cluster that this or the new values touch is redone
            ids = cut(upsert_ids(old_ids, fresh, delta))
            touched = old_ids.join(delta, "entity_key", "left_semi").unionByName(fresh)
            scope = cut(E.closed_members(touched, ids, old_members.select("entity_key", "resolved_id")).unionAll(delta.select("entity_key")).distinct())
            scope = cut(E.closed_members(ids.join(scope, "entity_key", "left_semi"), ids, old_members.select("entity_key", "resolved_id")).unionAll(scope).distinct())
            work = ids.join(E.delta_members(ids.join(scope, "entity_key", "left_semi"), ids).select(*E.KEYS).distinct(), E.KEYS, "left_semi")
            nodes = scope
        else:
            ids, work, nodes = fresh, fresh, delta.select("entity_key")
        links, result.edges = self._stage("edges", E.anchor_edges(work).join(nodes.withColumnRenamed("entity_key", "left_entity_key"), "left_entity_key", "left_semi"), run_id)
        skipped, result.groups_skipped = self._stage("skipped", E.skipped_groups(work, run_id, now), run_id)
        found, result.rounds = resolved(nodes, links, max_rounds=config.max_rounds if options.max_iters is None else options.max_iters)
        members, _ = self._stage("components", found, run_id)
        result.clusters = members.select("resolved_id").distinct().count()
        if options.dry_run:
            found = cut(preview.changes(members, old_members.select("entity_key", "resolved_id"), run_id, removed=not incremental))
            row = preview.summary(found).first()
            result.summary, result.status = row.asDict(), "DRY_RUN_COMPLETE"
            return {"dry_run_results": store.append("dry_run_results", found.withColumn("created_at", F.lit(now).cast("timestamp")))}
        stamped = members.select(
            "entity_key", "resolved_id", source_id(F.col("entity_key")).alias("source_id"), source_key(F.col("entity_key")).alias("source_key"), F.lit(run_id).alias("run_id"), F.lit(now).cast("timestamp").alias("updated_at")
        )
        membership = upsert(old_members.drop("super_cluster_id"), stamped, ["entity_key"]) if incremental else stamped
        if incremental:
            old_edges = store.read("edges").join(nodes.withColumnRenamed("entity_key", "left_entity_key"), "left_entity_key", "left_anti")
            known = store.read("edges").join(nodes.withColumnRenamed("entity_key", "left_entity_key"), "left_entity_key", "left_semi").join(links.select("left_entity_key", "right_entity_key", "identifier_type"), ["left_entity_key", "right_entity_key", "identifier_type"], "left_semi")
            all_edges = upsert_edges(old_edges.unionByName(known), links, run_id, now)
        else:
            known = store.read("edges").join(links.select("left_entity_key", "right_entity_key", "identifier_type"), ["left_entity_key", "right_entity_key", "identifier_type"], "left_semi")
            all_edges = upsert_edges(known, links, run_id, now)
        membership, all_edges = cut(membership), cut(all_edges)
        touched, stamp = None, {"run_id": F.lit(run_id), "updated_at": F.lit(now).cast("timestamp")}
        if incremental:  # clusters that were or are made of the nodes in scope; all others keep their statistics and profiles
            before = old_members.join(nodes.select("entity_key"), "entity_key", "left_semi")
            touched = cut(members.select("resolved_id").unionAll(before.select("resolved_id")).distinct())
            rest = store.read("clusters").join(touched, "resolved_id", "left_anti")
            table = scoring.clusters(members, links, rest, stamp)
        else:
            table = scoring.clusters(membership, all_edges, None, stamp)
        if config.fuzzy and not options.strict:
            names = sorted({n for s in config.active_sources() for n, _ in s.attributes})
            profile = cut(fuzzy.profiles(extract.attributes(spark, config, self.read), membership, names))
            labels, _ = fuzzy.super_clusters(profile, config.fuzzy, config.block_cap)
            labels = cut(labels)
            known = set(profile.columns) - {"resolved_id"}
            for rule in config.fuzzy:
                if rule.active and fuzzy.usable(rule, known) is None:
                    over = fuzzy.skipped_blocks(profile, rule, config.block_cap)
                    skipped = skipped.unionByName(over.withColumns({"run_id": F.lit(run_id), "skipped_at": F.lit(now).cast("timestamp")}), allowMissingColumns=True)
        else:
            labels = spark.createDataFrame([], "resolved_id string, super_cluster_id string")
        membership = membership.join(labels, "resolved_id", "left")
        table = table.join(labels, "resolved_id", "left")
        out = {
            "membership": membership, "edges": all_edges, "clusters": table, "identifiers": ids, "skipped_groups": store.append("skipped_groups", skipped),
            "run_state": upsert(store.read("run_state"), watermark_state(delta, run_id, now), ["table_id"]),
        }
        if config.evidence:
            found = E.evidence(links, run_id, {t: r.name for t, r in config.rule_of().items()}, now)
            out["evidence"] = store.append("evidence", found)
            out["rule_audit"] = store.append("rule_audit", found.groupBy("run_id", "rule_id").agg(F.count(F.lit(1)).alias("edges_created"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at")))
        rules = config.survivorship_rules()
        if rules:
            names = [r.attribute for r in rules]
            wide = extract.wide_profiles(spark, config, self.read, names)
            stored = store.read("unified_profile") if "unified_profile" in store.current() else None
            if touched is not None and stored is not None and set(names) <= set(stored.columns):
                profile = survivorship.golden_incremental(wide, membership, rules, stored, touched, stamp)
            else:
                profile = survivorship.golden(wide, membership, rules).withColumns(stamp)
            out["unified_profile"] = profile
        result.status = "SUCCESS"
        return out


def upsert_ids(stored: DataFrame, fresh: DataFrame, delta: DataFrame) -> DataFrame:
    """Identifiers with those of re-read entities replaced."""
    return stored.join(delta.select("entity_key"), "entity_key", "left_anti").unionByName(fresh).distinct()
