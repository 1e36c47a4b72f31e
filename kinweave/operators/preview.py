"""Dry runs: what a run would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(proposed: DataFrame, current: DataFrame, run_id: str = "", removed: bool = False) -> DataFrame:
    """(run_id, entity_key, current_resolved_id, proposed_resolved_id, change_type, sizes); ``removed`` adds keys that go."""
    new = proposed.select("entity_key", F.col("resolved_id").alias("proposed_resolved_id"))
    old = current.select("entity_key", F.col("resolved_id").alias("current_resolved_id"))
    kind = (
        F.when(F.col("proposed_resolved_id").isNull(), "REMOVED").when(F.col("current_resolved_id").isNull(), "NEW")
        .when(F.col("current_resolved_id") != F.col("proposed_resolved_id"), "MOVED").otherwise("UNCHANGED")
    )
    joined = new.join(old, "entity_key", "full" if removed else "left")
    sizes = lambda df, name: df.groupBy("resolved_id").agg(F.count(F.lit(1)).alias(name))
    joined = joined.join(sizes(current, "current_cluster_size").withColumnRenamed("resolved_id", "current_resolved_id"), "current_resolved_id", "left")
    joined = joined.join(sizes(proposed, "proposed_cluster_size").withColumnRenamed("resolved_id", "proposed_resolved_id"), "proposed_resolved_id", "left")
    return joined.select(F.lit(run_id).alias("run_id"), "entity_key", "current_resolved_id", "proposed_resolved_id", kind.alias("change_type"), "current_cluster_size", "proposed_cluster_size")


def summary(found: DataFrame) -> DataFrame:
    """One row: counts by kind, clusters merged and split, largest proposed cluster."""
    merged = found.where("current_resolved_id is not null and proposed_resolved_id is not null").groupBy("proposed_resolved_id").agg(F.count_distinct("current_resolved_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("merged_clusters"))
    split = found.where("current_resolved_id is not null and proposed_resolved_id is not null").groupBy("current_resolved_id").agg(F.count_distinct("proposed_resolved_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_clusters"))
    kinds = {"NEW": "new_entities", "MOVED": "moved_entities", "UNCHANGED": "unchanged_entities", "REMOVED": "removed_entities"}
    counts = found.agg(*[F.count_if(F.col("change_type") == k).alias(v) for k, v in kinds.items()], F.count(F.lit(1)).alias("total_entities"), F.coalesce(F.max("proposed_cluster_size"), F.lit(0)).alias("largest_proposed_cluster"))
    return counts.crossJoin(F.broadcast(merged)).crossJoin(F.broadcast(split))  # one row each


def breakdown(found: DataFrame) -> DataFrame:
    return found.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def moved_into(found: DataFrame, least: int = 100) -> DataFrame:
    moved = found.where("change_type = 'MOVED'").groupBy("proposed_resolved_id").agg(F.count(F.lit(1)).alias("moved_in"))
    return moved.where(F.col("moved_in") > least)


def size_deltas(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """(resolved_id, old_size, new_size, delta) of clusters whose size changes."""
    old = current.groupBy("resolved_id").agg(F.count(F.lit(1)).alias("old_size"))
    new = proposed.groupBy("resolved_id").agg(F.count(F.lit(1)).alias("new_size"))
    both = old.join(new, "resolved_id", "full").select("resolved_id", F.coalesce("old_size", F.lit(0)).alias("old_size"), F.coalesce("new_size", F.lit(0)).alias("new_size"))
    return both.withColumn("delta", F.abs(F.col("new_size") - F.col("old_size"))).where("delta > 0")


def gate(summary_row, max_moved: int = 10_000, max_cluster: int = 50_000) -> bool:
    """Whether a scheduled run may go live."""
    return summary_row["moved_entities"] <= max_moved and summary_row["largest_proposed_cluster"] <= max_cluster
