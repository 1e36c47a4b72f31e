"""Blocked fuzzy matching between clusters."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import register
from kinweave.operators.components import connected_components, rekeyed
from kinweave.plans.config import DEFAULT_CAP, FuzzyRule

_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def profiles(attributes: DataFrame, membership: DataFrame, names: list[str]) -> DataFrame:
    """(resolved_id, one column an attribute): the largest value; clusters without attributes are absent."""
    rows = attributes.where(F.col("attribute_name").isin(names)).join(membership.select("entity_key", "resolved_id"), "entity_key")
    return rows.groupBy("resolved_id").pivot("attribute_name", names).agg(F.max("attribute_value"))


def usable(rule: FuzzyRule, known: set[str]) -> str | None:
    """Why a rule is skipped, or None."""
    if re.search(r"<[ab]>", rule.blocking):
        return "the blocking key names a side"
    if not (re.search(r"<a>\.", rule.score) and re.search(r"<b>\.", rule.score)):
        return "the score does not compare <a> with <b>"
    missing = {m for m in re.findall(r"<[ab]>\.([A-Za-z_][A-Za-z0-9_]*)", rule.score)} - known
    if missing:
        return f"unknown attributes {sorted(missing)}"
    if not set(_TOKEN.findall(rule.blocking)) & known:
        return "the blocking key names no attribute"
    return None


def blocks(profile: DataFrame, blocking: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(block, size) of blocks of two to ``cap`` clusters."""
    keyed = profile.select(F.expr(blocking).cast("string").alias("block")).where("block is not null")
    return keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, cap))


def skipped_blocks(profile: DataFrame, rule: FuzzyRule, cap: int = DEFAULT_CAP) -> DataFrame:
    """Audit rows of the blocks that a rule leaves out: (identifier_type: the rule, identifier_value_norm: the block, group_size, max_allowed, reason)."""
    keyed = profile.select(F.expr(rule.blocking).cast("string").alias("identifier_value_norm")).where("identifier_value_norm is not null")
    big = keyed.groupBy("identifier_value_norm").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > cap)
    return big.select(F.lit(f"fuzzy:{rule.name}").alias("identifier_type"), "identifier_value_norm", "group_size", F.lit(cap).alias("max_allowed"), F.lit("EXCEEDED_BLOCK_CAP").alias("reason"))


def pairs(profile: DataFrame, rule: FuzzyRule, cap: int = DEFAULT_CAP) -> DataFrame:
    """(left_id, right_id, score) with score >= threshold, each pair once, in order of the ids' MD5.

    Blocks above the cap are left out before the join (that is the rule's meaning); the size of a block and so the
    number of its pairs is bounded by the cap.
    """
    register(profile.sparkSession)
    keyed = profile.withColumn("block", F.expr(rule.blocking).cast("string")).where("block is not null").withColumn("order", F.md5("resolved_id"))
    keyed = keyed.join(rekeyed(blocks(profile, rule.blocking, cap).select("block"), "block"), "block", "left_semi")
    a, b = keyed.alias("a"), keyed.alias("b")
    joined = a.join(b, F.expr("a.block = b.block and a.order < b.order"))
    score = F.expr(re.sub(r"<([ab])>\.", r"\1.", rule.score)).cast("double")
    scored = joined.select(F.col("a.resolved_id").alias("left_id"), F.col("b.resolved_id").alias("right_id"), score.alias("score"))
    return scored.where(F.col("score") >= rule.threshold)


def super_clusters(profile: DataFrame, rules: tuple[FuzzyRule, ...], cap: int = DEFAULT_CAP) -> tuple[DataFrame, DataFrame]:
    """((resolved_id, super_cluster_id), all fuzzy edges): edges of all rules together, smallest id of each component."""
    spark, known = profile.sparkSession, set(profile.columns) - {"resolved_id"}
    edges = spark.createDataFrame([], "left_id string, right_id string, score double, rule string")
    for rule in sorted((r for r in rules if r.active), key=lambda r: r.priority):
        if why := usable(rule, known):
            warnings.warn(f"fuzzy rule {rule.name} skipped: {why}", stacklevel=2)
            continue
        edges = edges.unionByName(pairs(profile, rule, cap).withColumn("rule", F.lit(rule.name)))
    found = connected_components(edges, "left_id", "right_id").select(F.col("node").alias("resolved_id"), F.col("component").alias("super_cluster_id"))
    labels = profile.select("resolved_id").join(found, "resolved_id", "left").select("resolved_id", F.coalesce("super_cluster_id", "resolved_id").alias("super_cluster_id"))
    return labels, edges
