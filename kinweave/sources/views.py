"""Monitoring views and the dashboard's tables over a store."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import analytics as Q
from kinweave.operators import edges
from kinweave.plans.config import Config
from kinweave.sources.store import Store


def views(store: Store, config: Config | None = None) -> dict[str, DataFrame]:
    """With a configuration, the rules' view has every active rule with its type and priority, in order."""
    runs, clusters, skipped, audit = (store.read(t) for t in ("run_history", "clusters", "skipped_groups", "rule_audit"))
    rules = store.spark.createDataFrame([(r.name, r.name, r.identifier_type, r.priority) for r in config.rules if r.active], "rule_id string, rule_name string, identifier_type string, priority int") if config else audit.select("rule_id").distinct()
    return {
        "v_run_summary": Q.latest_runs(runs), "v_cluster_health": Q.size_histogram(clusters, "health"), "v_identifier_issues": Q.identifier_issues(edges.group_stats(store.read("identifiers"))),
        "v_rule_effectiveness": Q.rule_effectiveness(rules, audit).orderBy("priority" if config else "rule_id"), "v_run_trends": Q.run_trends(runs), "v_alerts": Q.alerts(skipped, clusters), "v_largest": Q.largest(clusters), "v_rule_share": Q.rule_share(store.read("edges")),
        "v_skipped": skipped.orderBy(F.desc("group_size"), "identifier_value_norm").limit(100), "v_totals": Q.totals(clusters, store.read("edges")),
    }


def dashboard(store: Store, config: Config | None = None, rows: int = 100) -> str:
    """One HTML page with the first ``rows`` rows of every view."""
    parts = []
    for name, df in views(store, config).items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table border='1'><tr>{head}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>kinweave</title></head><body>{''.join(parts)}</body></html>"


def register(store: Store, config: Config | None = None) -> list[str]:
    found = views(store, config)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return sorted(found)


def analyze(spark, table: str, columns: list[str] | None = None) -> None:
    """Statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def golden_profile(store: Store, resolved_id: str, masked: bool = True) -> DataFrame:
    """One profile, its text values masked unless asked otherwise."""
    from kinweave.functions.text import mask_pii

    row = store.spark.read.parquet(f"{store.folder}/unified_profile/{store.current()['unified_profile']}").where(F.col("resolved_id") == resolved_id)
    hidden = [c for c, t in row.dtypes if t == "string" and c not in ("resolved_id", "run_id")]
    return row.withColumns({c: mask_pii(F.col(c), not masked) for c in hidden})
