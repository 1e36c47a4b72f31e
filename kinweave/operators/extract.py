"""Entities, identifiers and attributes from sources: one scan of each source, nothing recomputed by a join."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import canonical, entity_key
from kinweave.plans.config import Config, Exclusion, Rule, Source

Read = Callable[[Source], DataFrame]
EPOCH = "1970-01-01 00:00:00"
ENTITIES = "table_id string, entity_key string, watermark_value timestamp"
IDENTIFIERS = "entity_key string, identifier_type string, identifier_value_norm string, max_group_size int, is_hashed boolean"
ATTRIBUTES = "entity_key string, attribute_name string, attribute_value string"


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def changed_since(df: DataFrame, source: Source, last: datetime | None, incremental: bool) -> DataFrame:
    """Rows after the stored mark less the look-back (strictly); all rows in a full run or without a mark."""
    if not incremental or last is None or source.watermark is None:
        return df
    return df.where(F.expr(source.watermark) > F.lit(last).cast("timestamp") - F.expr(f"INTERVAL {int(source.lookback_minutes)} MINUTES"))


def entities(spark: SparkSession, config: Config, read: Read, state: dict[str, datetime] | None = None, incremental: bool = False) -> DataFrame:
    """(table_id, entity_key, watermark_value), one row for each key: the latest mark counts."""
    parts = []
    for s in config.active_sources():
        rows = changed_since(read(s), s, (state or {}).get(s.table_id), incremental)
        mark = F.expr(s.watermark).cast("timestamp") if s.watermark else F.lit(EPOCH).cast("timestamp")
        parts.append(rows.select(F.lit(s.table_id).alias("table_id"), entity_key(s.table_id, s.key).alias("entity_key"), mark.alias("watermark_value")))
    return _union(spark, parts, ENTITIES).groupBy("table_id", "entity_key").agg(F.max("watermark_value").alias("watermark_value"))


def identifiers(spark: SparkSession, config: Config, read: Read, state: dict[str, datetime] | None = None, incremental: bool = False) -> DataFrame:
    """Distinct (entity_key, identifier_type, identifier_value_norm, max_group_size, is_hashed)."""
    rules, parts = config.rule_of(), []
    for s in config.active_sources():
        mapped = [(t, e) for t, e in s.identifiers if t in rules]
        if not mapped:
            continue
        rows = changed_since(read(s), s, (state or {}).get(s.table_id), incremental)
        cells = F.array(*[
            F.struct(F.lit(t).alias("identifier_type"), canonical(F.expr(e), rules[t].canonicalize).alias("identifier_value_norm"), F.lit(rules[t].max_group_size).cast("int").alias("max_group_size"), F.lit(t in s.hashed).alias("is_hashed"))
            for t, e in mapped
        ])
        parts.append(rows.select(entity_key(s.table_id, s.key).alias("entity_key"), F.explode(cells).alias("c")).select("entity_key", "c.*").where(_present(rules, [t for t, _ in mapped])))
    return without_excluded(_union(spark, parts, IDENTIFIERS), config.exclusions).distinct()


def _present(rules: dict[str, Rule], types: list[str]):
    """Null values are left out, but for types whose rule allows them (they are carried and link nothing)."""
    free = [t for t in types if not rules[t].require_non_null]
    there = F.col("identifier_value_norm").isNotNull()
    return there | F.col("identifier_type").isin(free) if free else there


def without_excluded(ids: DataFrame, exclusions: tuple[Exclusion, ...]) -> DataFrame:
    """Drop identifiers that an exclusion names, by equality or LIKE, on the canonical value.

    Values to be dropped by equality are a table of their own, however many: an anti join.
    """
    value, kind = F.col("identifier_value_norm"), F.col("identifier_type")
    exact = sorted({(x.identifier_type, x.pattern) for x in exclusions if x.match == "EXACT"})
    if exact:
        ids = ids.join(ids.sparkSession.createDataFrame(exact, "identifier_type string, identifier_value_norm string"), ["identifier_type", "identifier_value_norm"], "left_anti").select(*ids.columns)
    gone = F.lit(False)
    for x in exclusions:
        if x.match == "LIKE":
            gone = gone | ((kind == x.identifier_type) & value.like(x.pattern))
    return ids.where(~F.coalesce(gone, F.lit(False)))


def attributes(spark: SparkSession, config: Config, read: Read) -> DataFrame:
    """(entity_key, attribute_name, attribute_value), null values left out."""
    parts = []
    for s in config.active_sources():
        if s.attributes:
            cells = F.array(*[F.struct(F.lit(n).alias("attribute_name"), F.expr(e).cast("string").alias("attribute_value")) for n, e in s.attributes])
            parts.append(read(s).select(entity_key(s.table_id, s.key).alias("entity_key"), F.explode(cells).alias("c")).select("entity_key", "c.*").where("attribute_value is not null"))
    return _union(spark, parts, ATTRIBUTES)


def wide_profiles(spark: SparkSession, config: Config, read: Read, names: list[str]) -> DataFrame:
    """(entity_key, source_id, recency, attributes...): a typed null where a source lacks an attribute."""
    parts = []
    for s in config.active_sources():
        have = dict(s.attributes)
        rows = read(s)
        mark = F.expr(s.watermark).cast("timestamp") if s.watermark else F.lit(EPOCH).cast("timestamp")
        columns = [(F.expr(have[n]).cast("string") if n in have else F.lit(None).cast("string")).alias(n) for n in names]
        parts.append(rows.select(entity_key(s.table_id, s.key).alias("entity_key"), F.lit(s.table_id).alias("source_id"), mark.alias("recency"), *columns))
    schema = ", ".join(["entity_key string, source_id string, recency timestamp", *[f"{n} string" for n in names]])
    return _union(spark, parts, schema)
