"""Cluster sizes, edge statistics and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import cut, rekeyed


def cluster_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("resolved_id").agg(F.count(F.lit(1)).alias("cluster_size"))


def edge_stats(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(resolved_id, edge_diversity, edge_count): each edge counts once at each of its ends.

    "left or right is a member" is one equi-join over the exploded ends, not a nested loop.
    """
    ends = edges.select(F.explode(F.array("left_entity_key", "right_entity_key")).alias("entity_key"), "identifier_type")
    per = ends.groupBy("entity_key", "identifier_type").agg(F.count(F.lit(1)).alias("n"))
    joined = membership.select("entity_key", "resolved_id").join(per, "entity_key")
    return joined.groupBy("resolved_id").agg(F.count_distinct("identifier_type").alias("edge_diversity"), F.sum("n").alias("edge_count"))


def pair_density(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(resolved_id, pair_density): linked pairs over possible pairs."""
    pairs = edges.select(F.least("left_entity_key", "right_entity_key").alias("entity_key"), F.greatest("left_entity_key", "right_entity_key").alias("other")).distinct()
    count = membership.join(pairs, "entity_key").groupBy("resolved_id").agg(F.count(F.lit(1)).alias("pairs"))
    n = F.col("cluster_size")
    return cluster_sizes(membership).join(count, "resolved_id", "left").select("resolved_id", F.when(n > 1, F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2)).otherwise(1.0).alias("pair_density"))


def _reason(n: Column, diversity: Column, density: Column, style: str) -> Column:
    if style == "short":
        return F.when(n == 1, "SINGLETON").when(diversity > 1, "MULTIPLE_IDENTIFIERS").otherwise("SINGLE_IDENTIFIER")
    many = F.concat(diversity.cast("string"), F.lit(" identifier types"))
    return (
        F.when(n == 1, "SINGLETON_NO_MATCH_REQUIRED")
        .when((diversity >= 3) & (density >= 0.8), F.concat(many, F.lit(", high density")))
        .when((diversity >= 2) & (density >= 0.5), F.concat(many, F.lit(", moderate density")))
        .when(diversity >= 2, F.concat(many, F.lit(", low density")))
        .when(density >= 0.8, F.lit("Single identifier type, high density"))
        .otherwise(F.lit("Single identifier type, chain pattern"))
    )


def confidence(membership: DataFrame, edges: DataFrame, style: str = "long", max_diversity: int | None = None) -> DataFrame:
    """(resolved_id, cluster_size, edge_diversity, match_density, confidence_score, primary_reason)."""
    return scored(statistics(membership, edges), style, max_diversity)


def statistics(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(resolved_id, cluster_size, edge_diversity, match_density): density is the number of edge ends over size - 1, 1 at most."""
    stats = cluster_sizes(membership).join(edge_stats(membership, edges), "resolved_id", "left")
    n = F.col("cluster_size")
    density = F.when(n == 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("edge_count", F.lit(0)) / F.nullif(n - 1, F.lit(0)).cast("double")))
    return stats.select("resolved_id", "cluster_size", F.coalesce("edge_diversity", F.lit(0)).alias("edge_diversity"), density.alias("match_density"))


def scored(stats: DataFrame, style: str = "long", max_diversity: int | None = None) -> DataFrame:
    """Statistics with scores: 1 for one member; else .50 diversity / largest diversity + .35 density + .15, three digits. Other
    columns are carried. Statistics of clusters that did not change need not be made again when the largest diversity does."""
    n = F.col("cluster_size")
    if max_diversity is None:
        stats = cut(stats)  # read twice
        top = stats.agg(F.greatest(F.lit(1), F.max("edge_diversity")).alias("top"))
        stats = stats.crossJoin(F.broadcast(top))  # one row
    else:
        stats = stats.withColumn("top", F.lit(max_diversity))
    score = F.when(n == 1, 1.0).otherwise(F.round(0.5 * F.col("edge_diversity") / F.col("top") + 0.35 * F.col("match_density") + 0.15, 3))
    reason = _reason(n, F.col("edge_diversity"), F.col("match_density"), style)
    rest = [c for c in stats.columns if c not in ("resolved_id", "cluster_size", "edge_diversity", "match_density", "top", "confidence_score", "primary_reason")]
    return stats.select("resolved_id", "cluster_size", "edge_diversity", "match_density", score.alias("confidence_score"), reason.alias("primary_reason"), *rest)


def clusters(membership: DataFrame, edges: DataFrame, stored: DataFrame | None = None, stamp: dict[str, Column] | None = None) -> DataFrame:
    """Scores and pair densities; ``stamp``: further columns of these; ``stored``: a cluster table that goes on beside them as it is, but for scores."""
    stats = statistics(membership, edges).join(rekeyed(pair_density(membership, edges), "resolved_id"), "resolved_id").withColumns(stamp or {})
    return scored(stats if stored is None else stored.select(*stats.columns).unionByName(stats))
