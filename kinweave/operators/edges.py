"""Identifier groups, their audit, star edges, evidence and the subgraph that a delta touches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import rekeyed

KEYS = ["identifier_type", "identifier_value_norm"]


def group_stats(identifiers: DataFrame) -> DataFrame:
    """(identifier_type, identifier_value_norm, group_size, anchor, max_group_size) of groups of two and more."""
    own = identifiers.select("entity_key", *KEYS, "max_group_size").distinct()
    return own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("group_size"), F.min("entity_key").alias("anchor"), F.max("max_group_size").alias("max_group_size")).where("group_size > 1")


def skipped_groups(identifiers: DataFrame, run_id: str = "", at: datetime | None = None) -> DataFrame:
    """Groups above their cap, with the five smallest keys. The caps are found first; samples are taken for those alone."""
    big = group_stats(identifiers).where("group_size > max_group_size")
    rows = identifiers.select("entity_key", *KEYS).distinct().join(rekeyed(big.select(*KEYS), *KEYS), KEYS)
    # the limit is applied in every task before rows are shuffled: a group sends five rows a task, then a part of its hash five
    part = Window.partitionBy(*KEYS, F.pmod(F.xxhash64("entity_key"), F.lit(64))).orderBy("entity_key")
    few = rows.withColumn("k", F.row_number().over(part)).where("k <= 5").drop("k")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("entity_key"))).where("k <= 5")
    sample = few.groupBy(*KEYS).agg(F.to_json(F.sort_array(F.collect_list("entity_key"))).alias("sample_entity_keys"))
    return big.join(sample, KEYS).select(
        F.lit(run_id).alias("run_id"), *KEYS, "group_size", F.col("max_group_size").alias("max_allowed"), "sample_entity_keys",
        F.lit("EXCEEDED_MAX_GROUP_SIZE").alias("reason"), F.lit(at).cast("timestamp").alias("skipped_at"),
    )


def anchor_edges(identifiers: DataFrame) -> DataFrame:
    """Star edges: each member but the smallest -> the smallest of its group, for groups within their cap (inclusive; null: none).

    One row for each (left, right, identifier_type): the smallest value that links them.
    """
    groups = group_stats(identifiers).where("max_group_size is null or group_size <= max_group_size").select(*KEYS, "anchor")
    rows = identifiers.select("entity_key", *KEYS).distinct()
    linked = rows.join(rekeyed(groups, *KEYS), KEYS).where("entity_key <> anchor")
    return linked.groupBy(F.col("entity_key").alias("left_entity_key"), F.col("anchor").alias("right_entity_key"), "identifier_type").agg(F.min("identifier_value_norm").alias("identifier_value_norm"))


def evidence(edges: DataFrame, run_id: str = "", rule_ids: dict[str, str] | None = None, at: datetime | None = None) -> DataFrame:
    names = F.concat(F.lit("exact_"), F.col("identifier_type"))
    for t, name in (rule_ids or {}).items():
        names = F.when(F.col("identifier_type") == t, F.lit(name)).otherwise(names)
    return edges.select(
        F.lit(run_id).alias("run_id"), F.col("left_entity_key").alias("entity_key_a"), F.col("right_entity_key").alias("entity_key_b"), names.alias("rule_id"), "identifier_type",
        F.col("identifier_value_norm").alias("match_value"), F.lit(1.0).alias("score"), F.lit(at).cast("timestamp").alias("created_at"),
    )


def both_ways(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(src, dst) in both directions, from one pass."""
    two = edges.select(F.explode(F.array(F.struct(F.col("left_entity_key").alias("src"), F.col("right_entity_key").alias("dst")), F.struct(F.col("right_entity_key").alias("src"), F.col("left_entity_key").alias("dst")))).alias("e")).select("e.*")
    return two.distinct() if distinct else two


def delta_members(delta: DataFrame, everything: DataFrame) -> DataFrame:
    """All identifier rows whose value occurs in the delta."""
    return everything.join(delta.select(*KEYS).distinct(), KEYS, "left_semi")


def impacted_nodes(new_edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Endpoints of new edges and their neighbours over stored edges."""
    ends = both_ways(new_edges).select(F.col("src").alias("entity_key")).distinct()
    near = both_ways(stored).join(ends.withColumnRenamed("entity_key", "src"), "src", "left_semi").select(F.col("dst").alias("entity_key"))
    return ends.unionAll(near).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("entity_key")
    return edges.join(n.withColumnRenamed("entity_key", "left_entity_key"), "left_entity_key", "left_semi").join(n.withColumnRenamed("entity_key", "right_entity_key"), "right_entity_key", "left_semi")


def closed_members(delta_identifiers: DataFrame, stored_identifiers: DataFrame, membership: DataFrame) -> DataFrame:
    """Keys that a delta can move: its own, those that share a value with it, and all of their old clusters."""
    touched = delta_identifiers.select("entity_key").unionAll(delta_members(delta_identifiers, stored_identifiers).select("entity_key")).distinct()
    clusters = membership.join(touched, "entity_key", "left_semi").select("resolved_id").distinct()
    return touched.unionAll(membership.join(clusters, "resolved_id", "left_semi").select("entity_key")).distinct()
