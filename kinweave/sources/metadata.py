"""A configuration as tables, and back: one row a source, mapping, rule, exclusion, fuzzy rule and survivorship rule.

``tables`` and ``config_of`` are inverse to each other. ``write`` replaces all tables of a database, ``read`` opens them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans.config import Config, Exclusion, FuzzyRule, Rule, Source, Survivorship

SCHEMAS = {
    "source_table": "position int, table_id string, table_fqn string, entity_type string, entity_key_expr string, watermark_column string, watermark_lookback_minutes int, is_active boolean, trust_rank int, format string",
    "identifier_mapping": "position int, table_id string, identifier_type string, identifier_value_expr string, is_hashed boolean",
    "entity_attribute_mapping": "position int, table_id string, attribute_name string, attribute_expr string",
    "rule": "position int, rule_id string, identifier_type string, canonicalize string, max_group_size int, priority int, is_active boolean, require_non_null boolean",
    "fuzzy_rule": "position int, rule_id string, rule_name string, blocking_key_expr string, score_expr string, threshold double, priority int, is_active boolean",
    "identifier_exclusion": "position int, identifier_type string, identifier_value_pattern string, match_type string, reason string",
    "survivorship_rule": "position int, attribute_name string, strategy string, source_priority_list string, recency_field string, is_active boolean",
    "settings": "generate_evidence boolean, max_rounds int, block_cap int",
}


def tables(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    rows: dict[str, list[tuple]] = {
        "source_table": [(i, s.table_id, s.table, s.entity_type, s.key, s.watermark, s.lookback_minutes, s.active, s.trust_rank, s.format) for i, s in enumerate(config.sources)],
        "identifier_mapping": [(i, s.table_id, t, e, t in s.hashed) for s in config.sources for i, (t, e) in enumerate(s.identifiers)],
        "entity_attribute_mapping": [(i, s.table_id, n, e) for s in config.sources for i, (n, e) in enumerate(s.attributes)],
        "rule": [(i, r.rule_id, r.identifier_type, r.canonicalize, r.max_group_size, r.priority, r.active, r.require_non_null) for i, r in enumerate(config.rules)],
        "fuzzy_rule": [(i, r.rule_id, r.name, r.blocking, r.score, r.threshold, r.priority, r.active) for i, r in enumerate(config.fuzzy)],
        "identifier_exclusion": [(i, x.identifier_type, x.pattern, x.match, x.reason) for i, x in enumerate(config.exclusions)],
        "survivorship_rule": [(i, r.attribute, r.strategy, json.dumps(list(r.priority)), r.recency_field, r.active) for i, r in enumerate(config.survivorship)],
        "settings": [(config.evidence, config.max_rounds, config.block_cap)],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def config_of(found: dict[str, DataFrame]) -> Config:
    """The configuration that the tables hold; they have as many rows as its author wrote."""
    rows = {name: sorted((r.asDict() for r in found[name].collect()), key=lambda r: r.get("position", 0)) for name in SCHEMAS}
    own = lambda name, table_id: [r for r in rows[name] if r["table_id"] == table_id]
    sources = tuple(
        Source(
            s["table_id"], s["table_fqn"], s["entity_key_expr"], tuple((r["identifier_type"], r["identifier_value_expr"]) for r in own("identifier_mapping", s["table_id"])),
            tuple((r["attribute_name"], r["attribute_expr"]) for r in own("entity_attribute_mapping", s["table_id"])), s["watermark_column"], s["watermark_lookback_minutes"], s["entity_type"], s["is_active"], s["trust_rank"],
            tuple(r["identifier_type"] for r in own("identifier_mapping", s["table_id"]) if r["is_hashed"]), s["format"],
        )
        for s in rows["source_table"]
    )
    return Config(
        sources, tuple(Rule(r["identifier_type"], r["canonicalize"], r["max_group_size"], r["priority"], r["is_active"], r["require_non_null"], r["rule_id"]) for r in rows["rule"]),
        tuple(Exclusion(r["identifier_type"], r["identifier_value_pattern"], r["match_type"], r["reason"]) for r in rows["identifier_exclusion"]),
        tuple(FuzzyRule(r["rule_name"], r["blocking_key_expr"], r["score_expr"], r["threshold"], r["priority"], r["is_active"], r["rule_id"]) for r in rows["fuzzy_rule"]),
        tuple(Survivorship(r["attribute_name"], r["strategy"], tuple(json.loads(r["source_priority_list"])), r["recency_field"], r["is_active"]) for r in rows["survivorship_rule"]),
        rows["settings"][0]["generate_evidence"], rows["settings"][0]["max_rounds"], rows["settings"][0]["block_cap"],
    )


def write(spark: SparkSession, config: Config, database: str) -> None:
    """Replace the metadata tables of a database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables(spark, config).items():
        df.coalesce(1).write.mode("overwrite").saveAsTable(f"{database}.{name}")


def read(spark: SparkSession, database: str) -> Config:
    return config_of({name: spark.table(f"{database}.{name}") for name in SCHEMAS})


def active_rules(found: dict[str, DataFrame]) -> DataFrame:
    return found["rule"].where("is_active").orderBy("priority", "position")


def active_sources(found: dict[str, DataFrame]) -> DataFrame:
    return found["source_table"].where("is_active").orderBy("position")
