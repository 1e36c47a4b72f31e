"""Read side: health, audits, trends, searches and documented reports, each a function from tables to a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import SIZE_BUCKETS, bucket, bucket_order, mask_pii, severity, source_id, source_key


def size_histogram(clusters: DataFrame, spec: str = "five") -> DataFrame:
    n = F.col("cluster_size")
    return clusters.groupBy(bucket(n, spec).alias("bucket"), bucket_order(n, spec).alias("bucket_order")).agg(
        F.count(F.lit(1)).alias("cluster_count"), F.sum("cluster_size").alias("entity_count"), F.min("cluster_size").alias("min_size"), F.max("cluster_size").alias("max_size"), F.round(F.avg("cluster_size"), 4).alias("avg_size")
    )


def size_of_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters"))


def rule_share(edges: DataFrame) -> DataFrame:
    per = edges.groupBy("identifier_type").agg(F.count(F.lit(1)).alias("edges"))
    return per.select("identifier_type", "edges", F.round(100.0 * F.col("edges") / F.sum("edges").over(Window.partitionBy()), 1).alias("share"))


def rule_audit(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("run_id", "rule_id").agg(F.count(F.lit(1)).alias("edges_created"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"))


def rule_effectiveness(rules: DataFrame, audit: DataFrame) -> DataFrame:
    """Every rule, with what else ``rules`` says of it, its edges in all runs and in the one that started last."""
    latest = audit.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest"))
    per = audit.crossJoin(F.broadcast(latest)).groupBy("rule_id").agg(F.sum("edges_created").alias("total_edges"), F.max(F.when(F.col("run_id") == F.col("latest"), F.col("edges_created"))).alias("latest_edges"))
    return rules.join(per, "rule_id", "left").select(*rules.columns, F.coalesce("total_edges", F.lit(0)).alias("total_edges"), F.coalesce("latest_edges", F.lit(0)).alias("latest_edges"))


def identifier_issues(stats: DataFrame, least: int = 100) -> DataFrame:
    return stats.where(F.col("group_size") > least).select("identifier_type", "identifier_value_norm", "group_size", severity(F.col("group_size")).alias("severity"))


def alerts(skipped: DataFrame, clusters: DataFrame, large: int = 1000) -> DataFrame:
    a = skipped.agg(F.count(F.lit(1)).alias("n"), F.max("group_size").alias("largest")).select(F.lit("SKIPPED_GROUPS").alias("alert"), "n", F.coalesce("largest", F.lit(0)).cast("long").alias("largest"))
    b = clusters.where(F.col("cluster_size") > large).agg(F.count(F.lit(1)).alias("n"), F.max("cluster_size").alias("largest")).select(F.lit("LARGE_CLUSTERS").alias("alert"), "n", F.coalesce("largest", F.lit(0)).cast("long").alias("largest"))
    return a.unionAll(b).where("n > 0")


def totals(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: clusters, entities, mean confidence (three digits, 0 without clusters), edges."""
    c = clusters.agg(F.count(F.lit(1)).alias("total_clusters"), F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("total_entities"), F.round(F.coalesce(F.nanvl(F.avg("confidence_score"), F.lit(0.0)), F.lit(0.0)), 3).alias("avg_confidence"))
    return c.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("total_edges"))))


def largest(clusters: DataFrame, k: int = 10) -> DataFrame:
    return clusters.orderBy(F.desc("cluster_size"), "resolved_id").limit(k)


def latest_runs(runs: DataFrame, k: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(min(k, 100))


def run_trends(runs: DataFrame) -> DataFrame:
    failed = F.col("status").isin("FAILED", "ERROR")
    return runs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status").startswith("SUCCESS")).alias("succeeded"), F.count_if(failed).alias("failed"), F.round(F.avg("duration_seconds"), 4).alias("avg_duration"), F.sum("entities_processed").alias("entities")
    )


def run_statistics(runs: DataFrame, today, days: int = 30) -> DataFrame:
    """The last ``days`` days up to ``today`` (a date): runs, success rate, mean duration, entities and skipped groups of each."""
    recent = runs.where(F.to_date("started_at").between(F.date_sub(F.lit(today), days), F.lit(today)))
    return recent.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(100.0 * F.count_if(F.col("status").startswith("SUCCESS")) / F.count(F.lit(1)), 1).alias("success_rate"),
        F.round(F.avg("duration_seconds"), 0).alias("avg_duration"), F.sum("entities_processed").alias("entities"), F.sum("groups_skipped").alias("groups_skipped"),
    )


def audit_duration(audit: DataFrame, k: int = 10) -> DataFrame:
    """The latest ``k`` runs of a rule audit: edges, start, end and whole minutes between."""
    per = audit.groupBy("run_id").agg(F.sum("edges_created").alias("total_edges"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    minutes = F.floor((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000)
    return per.withColumn("minutes", minutes).orderBy(F.desc("started_at"), "run_id").limit(k)


def success_rate(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.round(100.0 * F.count_if(F.col("status").startswith("SUCCESS")) / F.count(F.lit(1)), 1).alias("success_rate"))


def metric_timeline(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.where(F.col("metric_name") == name).groupBy(F.to_date("recorded_at").alias("day")).agg(F.round(F.avg("metric_value"), 6).alias("avg_value"), F.max("metric_value").alias("max_value"))


def percentiles(df: DataFrame, column: str, by: list[str], accuracy: int | None = None) -> DataFrame:
    """p50, p90 and p99 of each group: exact ones hold a group's distinct values in one task; with an ``accuracy``, a sketch of that size does."""
    one = (lambda p: F.percentile(column, p)) if accuracy is None else (lambda p: F.percentile_approx(column, p, accuracy))
    return df.groupBy(*by).agg(*[F.round(one(p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


def cross_source(membership: DataFrame, least: int = 2) -> DataFrame:
    """Clusters over ``least`` sources and more, with their sources in order."""
    per = membership.select("resolved_id", source_id(F.col("entity_key")).alias("source_id")).groupBy("resolved_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("resolved_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_id")), ", ").alias("sources"), F.sum("n").alias("members")).where(F.col("n_sources") >= least)


def customer_360(membership: DataFrame, per_source: list[str], profile: DataFrame | None = None) -> DataFrame:
    """Records of each source for each cluster (a key is in the membership once), beside its profile if one is given."""
    s = source_id(F.col("entity_key"))
    counts = membership.groupBy("resolved_id").agg(*[F.count_if(s == name).alias(f"{name}_count") for name in per_source])
    return counts if profile is None else profile.join(counts, "resolved_id")


def back_to_sources(membership: DataFrame, rows: dict[str, tuple[DataFrame, str]], columns: list[str]) -> DataFrame:
    """Members with columns of their source rows: ``rows`` has for each source its table and key; one equi-join a source."""
    split = membership.select("resolved_id", source_id(F.col("entity_key")).alias("source_id"), source_key(F.col("entity_key")).alias("source_key"))
    parts = []
    for name, (df, key) in rows.items():
        own = df.select(F.col(key).cast("string").alias("source_key"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])
        parts.append(split.where(F.col("source_id") == name).join(own, "source_key").select("resolved_id", "source_id", "source_key", *columns))
    return reduce(DataFrame.unionAll, parts)


def first_touch(rows: DataFrame, value: str, at: str) -> DataFrame:
    """(resolved_id, first_at, last_at, first_value): of equal times the smallest value."""
    return rows.groupBy("resolved_id").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by(value, F.struct(at, value)).alias("first_value"))


def truth_accuracy(truth: DataFrame, membership: DataFrame) -> DataFrame:
    """Truth is (entity_key, person_id): persons, share of them in one cluster (two digits), mean clusters a person."""
    per = truth.join(membership, "entity_key", "left").groupBy("person_id").agg(F.count_distinct("resolved_id").alias("clusters"))
    return per.agg(F.count(F.lit(1)).alias("persons"), F.round(100.0 * F.count_if(F.col("clusters") == 1) / F.count(F.lit(1)), 2).alias("in_one_cluster"), F.round(F.avg("clusters"), 4).alias("avg_clusters"))


def fragmented(truth: DataFrame, membership: DataFrame) -> DataFrame:
    per = truth.join(membership, "entity_key").groupBy("person_id").agg(F.count_distinct("resolved_id").alias("clusters"))
    return per.where("clusters > 1")


def null_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, filled) of each column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{k}") for k, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{k}").alias("filled")) for k, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows with each column, and rows with none of them (``orphaned``)."""
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in columns], F.count_if(none).alias("orphaned"))


def drill_down(membership: DataFrame, identifiers: DataFrame, resolved_ids: DataFrame) -> DataFrame:
    """Which identifiers hold the given clusters together: distinct entities of each."""
    inside = membership.join(resolved_ids, "resolved_id", "left_semi")
    return identifiers.join(inside, "entity_key").groupBy("resolved_id", "identifier_type", "identifier_value_norm").agg(F.count_distinct("entity_key").alias("entities"))


def orphans(clusters: DataFrame, membership: DataFrame) -> DataFrame:
    return clusters.join(membership, "resolved_id", "left_anti")


def search(identifiers: DataFrame, membership: DataFrame, text: str, limit: int = 50, least: int = 3) -> DataFrame:
    """Clusters with an identifier value that contains ``text`` in any case."""
    if len(text) < least:
        return membership.select("resolved_id").limit(0)
    hit = identifiers.where(F.contains(F.lower("identifier_value_norm"), F.lit(text.lower()))).select("entity_key").distinct()
    return membership.join(hit, "entity_key", "left_semi").select("resolved_id").distinct().orderBy("resolved_id").limit(min(limit, 50))


def search_clusters(edges: DataFrame, membership: DataFrame, clusters: DataFrame, text: str, limit: int = 50, least: int = 3) -> DataFrame:
    """(resolved_id, cluster_size) of clusters with an edge whose value contains ``text``: edges are filtered first, then their ends joined."""
    found = clusters.select("resolved_id", "cluster_size")
    if len(text) < least:
        return found.limit(0)
    hit = edges.where(F.contains(F.lower("identifier_value_norm"), F.lit(text.lower()))).select(F.explode(F.array("left_entity_key", "right_entity_key")).alias("entity_key")).distinct()
    ids = membership.join(hit, "entity_key", "left_semi").select("resolved_id").distinct()
    return found.join(ids, "resolved_id", "left_semi").orderBy("resolved_id").limit(min(limit, 50))


def cluster_detail(clusters: DataFrame, membership: DataFrame, edges: DataFrame, resolved_id: str) -> dict[str, DataFrame]:
    """A cluster's header (no row if unknown), members and edges, values masked."""
    header = clusters.where(F.col("resolved_id") == resolved_id).select("resolved_id", "cluster_size", "confidence_score")
    links = edges_of(edges, membership, resolved_id).select("left_entity_key", "right_entity_key", "identifier_type", mask_pii(F.col("identifier_value_norm"), False).alias("value"))
    return {"cluster": header, "members": members(membership, resolved_id), "edges": links}


def problem_identifiers(stats: DataFrame, k: int = 20) -> DataFrame:
    """The largest identifier groups."""
    return stats.orderBy(F.desc("group_size"), "identifier_type", "identifier_value_norm").limit(k).select("identifier_type", "identifier_value_norm", "group_size")


def members(membership: DataFrame, resolved_id: str) -> DataFrame:
    return membership.where(F.col("resolved_id") == resolved_id).select("entity_key", source_id(F.col("entity_key")).alias("source_id"))


def edges_of(edges: DataFrame, membership: DataFrame, resolved_id: str) -> DataFrame:
    """Components are closed, so the left end decides."""
    inside = membership.where(F.col("resolved_id") == resolved_id).select(F.col("entity_key").alias("left_entity_key"))
    return edges.join(inside, "left_entity_key", "left_semi")


def explain_edge(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges between two entities, in either direction, values masked."""
    pair = (F.least("left_entity_key", "right_entity_key") == min(a, b)) & (F.greatest("left_entity_key", "right_entity_key") == max(a, b))
    return edges.where(pair).select("left_entity_key", "right_entity_key", "identifier_type", mask_pii(F.col("identifier_value_norm"), False).alias("value"))


def bucket_names(spec: str) -> list[str]:
    return [name for _, name in SIZE_BUCKETS[spec]]


def overlap(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of two sources that agree on a column in any case."""
    x = a.select(F.lower(left).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n_left"))
    y = b.select(F.lower(right).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n_right"))
    return x.join(y, "value")


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()])
