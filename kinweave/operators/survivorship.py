"""Golden profiles: one row a cluster, one value an attribute, by strategy; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.config import STRATEGIES, Survivorship

OTHERS = 999


def rank_of(source: Column, priority: tuple[str, ...]) -> Column:
    rank = F.lit(OTHERS)
    for i, s in reversed(list(enumerate(priority))):
        rank = F.when(source == s, i + 1).otherwise(rank)
    return rank


def pick(rule: Survivorship) -> Column:
    """One aggregate over rows (source_id, recency, attribute...). Nulls never win; ties go to the latest, then the smallest value."""
    value, recency = F.col(rule.attribute), F.col(rule.recency_field or "recency")
    there = value.isNotNull()
    newest = -F.unix_micros(F.coalesce(recency.cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))
    strategy = STRATEGIES[rule.strategy]
    if strategy == "RECENCY":
        out = F.min_by(value, F.when(there & recency.isNotNull(), F.struct(newest, value)))
    elif strategy == "FIRST_SEEN":
        out = F.min_by(value, F.when(there & recency.isNotNull(), F.struct(-newest, value)))
    elif strategy == "PRIORITY":
        out = F.min_by(value, F.when(there, F.struct(rank_of(F.col("source_id"), rule.priority), newest, value)))
    elif strategy == "FREQUENCY":
        out = F.mode(value, True)
    elif strategy == "AGG_SUM":
        out = F.sum(value.try_cast("double")).cast("string")
    else:
        out = F.max(value)
    return out.alias(rule.attribute)


def golden(wide: DataFrame, membership: DataFrame, rules: tuple[Survivorship, ...]) -> DataFrame:
    """(resolved_id, attributes...): one join and one aggregation for all attributes."""
    joined = wide.join(membership.select("entity_key", "resolved_id"), "entity_key")
    return joined.groupBy("resolved_id").agg(*[pick(r) for r in rules if r.active])


def golden_incremental(wide: DataFrame, membership: DataFrame, rules: tuple[Survivorship, ...], stored: DataFrame, touched: DataFrame, stamp: dict[str, Column] | None = None) -> DataFrame:
    """``golden`` of the clusters in ``touched`` (resolved_id: new ones and those that are gone), with ``stamp``, in place of their stored rows."""
    ids = touched.select("resolved_id").distinct()
    fresh = golden(wide, membership.join(ids, "resolved_id", "left_semi"), rules).withColumns(stamp or {})
    return stored.join(ids, "resolved_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def value_counts(wide: DataFrame, membership: DataFrame, names: list[str]) -> DataFrame:
    """(resolved_id, attribute, value, n, first_seen, last_seen)."""
    cells = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value")) for n in names])
    rows = wide.join(membership.select("entity_key", "resolved_id"), "entity_key").select("resolved_id", "recency", F.explode(cells).alias("c")).select("resolved_id", "recency", "c.*")
    return rows.where("value is not null").groupBy("resolved_id", "attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.min("recency").alias("first_seen"), F.max("recency").alias("last_seen"))


def ranked(counts: DataFrame, strategy: str = "MOST_RECENT") -> DataFrame:
    """The first value of each attribute by MOST_RECENT, MOST_FREQUENT or FIRST_SEEN; ties by value."""
    order = {"MOST_FREQUENT": [F.desc("n")], "FIRST_SEEN": [F.asc("first_seen")]}.get(strategy, [F.desc("last_seen")])
    w = Window.partitionBy("resolved_id", "attribute").orderBy(*order, "value")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def ranked_by_source(wide: DataFrame, membership: DataFrame, names: list[str], priority: tuple[str, ...] = ()) -> DataFrame:
    """(resolved_id, attribute, value): each attribute's first value by source priority, if one is given, then the latest, then the smallest."""
    cells = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value")) for n in names])
    rows = wide.join(membership.select("entity_key", "resolved_id"), "entity_key").select("resolved_id", "source_id", "recency", F.explode(cells).alias("c")).select("resolved_id", "source_id", "recency", "c.*")
    order = [*([rank_of(F.col("source_id"), priority)] if priority else []), F.desc_nulls_last("recency"), F.asc("value")]
    w = Window.partitionBy("resolved_id", "attribute").orderBy(*order)
    return rows.where("value is not null").withColumn("rank", F.row_number().over(w)).where("rank = 1").select("resolved_id", "attribute", "value")
