"""Further registered queries with their SQL: runs and stores, metadata, readers, reports, generators, dry runs and streams."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import analytics as Q
from kinweave.operators import components, edges, extract, fuzzy, preview, scoring, survivorship
from kinweave.plans import queries as core
from kinweave.plans.config import Config, ConfigError, Rule, Source, Survivorship, check_expression, check_table, from_dict, resolve_attribute
from kinweave.plans.queries import A, A_CAP, B, CUR, CUT, DOCS, E_A, GOLDEN, I_A, I_B, ORACLES, ORDERS, W_SQL, WIDE, _ids, _links, _members, _ntz, _query, _read, _resolved, _sql, _states, _t
from kinweave.sources import datagen, metadata, readers, store


def _place(spark, name: str) -> str:
    components.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _values(rows, columns: str) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(quote(v) for v in r) + ')' for r in rows)}) t({columns})"


# readers and writers
@_query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def multi_part_load(spark, d):
    found = readers.read_parts(spark, [f"{d}/{t}.parquet" for t in ("nation", "region", "supplier")])
    return Q.stage_counts(found).withColumnsRenamed({"stage": "name", "rows": "n"})


@_query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def seed_round_trip(spark, d):
    path = _place(spark, "seed")
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return readers.read_seed(spark, path, "n_nationkey int, n_name string")


@_query("SELECT 'orders:' || o_orderkey AS entity_key, 'CUSTOMER_ID' AS identifier_type, CAST(o_custkey AS VARCHAR) AS identifier_value_norm FROM orders")
def csv_source(spark, d):
    path = _place(spark, "csv")
    _t(spark, d, "orders").select("o_orderkey", "o_custkey").write.option("header", True).csv(path)
    c = Config((Source("orders", path, "o_orderkey", (("CUSTOMER_ID", "o_custkey"),), format="csv"),), (Rule("CUSTOMER_ID", "NONE"),))
    return extract.identifiers(spark, c, readers.catalog_reader(spark)).select("entity_key", "identifier_type", "identifier_value_norm")


@_query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2 AND n_name <> 'x''y; --'")
def bound_parameters(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("kinweave_nation")
    found = readers.query(spark, "SELECT n_name, n_regionkey FROM kinweave_nation WHERE n_regionkey = ? AND n_name <> ?", [2, "x'y; --"])
    return spark.createDataFrame(found, "n_name string, n_regionkey int")


@_query("SELECT (SELECT count(*) FROM nation) AS n, (SELECT min(n_name) FROM nation WHERE n_regionkey = 3) AS first, TRUE AS present, FALSE AS absent, 2 AS statements")
def scalars_and_scripts(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("kinweave_nation")
    n = readers.query_one(spark, "SELECT count(*) FROM kinweave_nation")
    first = readers.query_one(spark, "SELECT min(n_name) FROM kinweave_nation WHERE n_regionkey = :k", k=3)
    ran = readers.run_script(spark, "-- two statements; one comment\nSELECT 'a;b';\nSELECT 1;")
    return spark.createDataFrame([(n, first, readers.table_exists(spark, "kinweave_nation"), readers.table_exists(spark, "kinweave_no_such_table"), ran)], "n long, first string, present boolean, absent boolean, statements int")


@_query(_values([("r_name", "string"), ("r_regionkey", "int")], "name, type"))
def column_types(spark, d):
    return spark.createDataFrame(readers.columns(_t(spark, d, "region")), "name string, type string")


@_query(_values([(t, c.strip().split(" ")[0], c.strip().split(" ")[1]) for t, s in store.SCHEMAS.items() for c in s.split(",")], "table_name, column_name, column_type"))
def system_schema(spark, d):
    return store.schema_rows(spark)


@_query("SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders")
def partitioned_write(spark, d):
    path = _place(spark, "parts")
    store.write_partitioned(_t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status")), path, ["status"], 500, ["o_custkey"])
    return spark.read.parquet(path)


@_query("SELECT CAST(event_id AS VARCHAR) AS metric_id, event_type AS metric_name FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retained_metrics(spark, d):
    e = _metrics(spark, d)
    now = e.agg(F.max("recorded_at")).first()[0]
    return store.retained(e, "recorded_at", now, 10).select("metric_id", "metric_name")


def _metrics(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_id").cast("string").alias("metric_id"), F.lit("r").alias("run_id"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.col("ts").cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("exported_at"))


@_query("SELECT CAST(event_id AS VARCHAR) AS metric_id FROM events ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 100")
def oldest_metrics_topk(spark, d):
    return store.unexported(_metrics(spark, d), 100).select("metric_id")


@_query("SELECT event_type AS metric_name, count(*) FILTER (value > 50) AS sent, count(*) FILTER (value <= 50 OR value IS NULL) AS waiting FROM events GROUP BY 1")
def metrics_marked(spark, d):
    m = _metrics(spark, d)
    marked = store.mark_exported(m, m.where("metric_value > 50").select("metric_id"), CUT)
    return marked.groupBy("metric_name").agg(F.count("exported_at").alias("sent"), F.count_if(F.col("exported_at").isNull()).alias("waiting"))


# configuration and metadata
BAD = (
    ("no sources", {}), ("no rules", {"sources": [{"id": "a"}]}), ("a source id occurs twice", {"sources": [{"id": "a"}, {"id": "a"}], "rules": [{"type": "EXACT", "identifier_type": "E"}]}),
    ("rule E: unknown canonicalize SHOUT", {"sources": [{"id": "a"}], "rules": [{"identifier_type": "E", "canonicalize": "shout"}]}), ("a.E: 'DROP' is not allowed in an expression", {"sources": [{"id": "a", "identifiers": {"E": "DROP TABLE x"}}], "rules": [{"identifier_type": "E"}]}),
    ("generate_evidence is not a boolean", {"sources": [{"id": "a"}], "rules": [{"identifier_type": "E"}], "generate_evidence": "yes"}), ("survivorship: unknown strategy BEST", {"sources": [{"id": "a"}], "rules": [{"identifier_type": "E"}], "survivorship": {"name": "best"}}),
)


@_query(_values([(m,) for m, _ in BAD], "message"))
def config_errors(spark, d):
    out = []
    for _, raw in BAD:
        try:
            from_dict(raw)
        except ConfigError as e:
            out.append((str(e),))
    return spark.createDataFrame(out, "message string")


EXPRESSIONS = (("lower(email)", True), ("'drop table' || x", True), ("x; select 1", False), ("x -- y", False), ("concat(a, b) /* c */", False), ("delete from t", False), ("", False))


@_query(_values(EXPRESSIONS, "expression, allowed"))
def expressions_checked(spark, d):
    def good(x):
        try:
            return bool(check_expression(x, "x"))
        except ConfigError:
            return False

    return spark.createDataFrame([(x, good(x)) for x, _ in EXPRESSIONS], "expression string, allowed boolean")


@_query(_values([("a", True), ("db.a", True), ("cat.db.a", True), ("a.b.c.d", False), ("a b", False), ("a;b", False)], "name, allowed"))
def table_names_checked(spark, d):
    def good(x):
        try:
            return bool(check_table(x))
        except ConfigError:
            return False

    return spark.createDataFrame([(x, good(x)) for x in ("a", "db.a", "cat.db.a", "a.b.c.d", "a b", "a;b")], "name string, allowed boolean")


@_query(_values([(s.table_id, t, e) for s in B.sources for t, e in s.identifiers], "table_id, identifier_type, identifier_value_expr"))
def metadata_mappings(spark, d):
    return metadata.tables(spark, B)["identifier_mapping"].select("table_id", "identifier_type", "identifier_value_expr")


@_query(_values([(r.identifier_type, r.canonicalize, r.max_group_size, r.priority) for r in B.rules], "identifier_type, canonicalize, max_group_size, priority"))
def metadata_rules(spark, d):
    return metadata.active_rules(metadata.tables(spark, B)).select("identifier_type", "canonicalize", "max_group_size", "priority")


@_query(_values([(s.table_id, s.table, s.key, s.watermark) for s in B.sources], "table_id, table_fqn, entity_key_expr, watermark_column"))
def metadata_sources(spark, d):
    return metadata.active_sources(metadata.tables(spark, B)).select("table_id", "table_fqn", "entity_key_expr", "watermark_column")


@_query(f"SELECT '{B.fingerprint()}' AS config_hash, TRUE AS same, TRUE AS any_order")
def metadata_round_trip(spark, d):
    back = metadata.config_of(metadata.tables(spark, B))
    turned = Config(B.sources[::-1], B.rules[::-1])
    return spark.createDataFrame([(back.fingerprint(), back == B, turned.fingerprint() == B.fingerprint())], "config_hash string, same boolean, any_order boolean")


@_query("SELECT c_custkey, c_name AS value FROM customer")
def attribute_fallback(spark, d):
    df = _t(spark, d, "customer")
    found = resolve_attribute({"segment": "c_mktsegment"}, "full_name", ("name", "C_NAME"), df.columns)
    return df.select("c_custkey", F.expr(found).alias("value"))


INACTIVE = Config((DOCS, Source("orders", "orders", "o_orderkey", (("CUSTOMER_ID", "o_custkey"),), active=False)), (Rule("CONTENT_HASH"), Rule("CUSTOMER_ID", active=False)))


@_query("SELECT 'documents' AS table_id, 'documents:' || doc_id AS entity_key FROM documents GROUP BY doc_id")
def active_sources_only(spark, d):
    return extract.entities(spark, INACTIVE, _read(spark, d)).select("table_id", "entity_key")


@_query("SELECT c_custkey, '***MASKED***' AS shown, c_name AS seen FROM customer")
def role_masking(spark, d):
    roles = ("STEWARD", "ADMIN")
    return _t(spark, d, "customer").select("c_custkey", T.mask_by_role(F.col("c_name"), "ANALYST", roles).alias("shown"), T.mask_by_role(F.col("c_name"), "ADMIN", roles).alias("seen"))


# runs of the engine
def _engine(spark, d, config=A, keep=None):
    from kinweave.plans.engine import Engine

    read = _read(spark, d)
    return Engine(spark, config, (lambda s: keep(s, read(s))) if keep else read, store.Store(spark, _place(spark, "store")))


_RUNS: dict[tuple[str, str], store.Store] = {}


def _full_run(spark, d) -> store.Store:
    """The store of one full run over the folder; queries of this session that only read it share it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        engine = _engine(spark, d)
        _done(engine.run(now=CUT))
        _RUNS[key] = engine.store
    return _RUNS[key]


def _done(result):
    if result.status not in ("SUCCESS", "DRY_RUN_COMPLETE"):
        raise RuntimeError(result.error or result.status)
    return result


def _early(s: Source, df: DataFrame) -> DataFrame:
    """The sources as they were before 2024-01-15 of events, with every second order."""
    return df.where(F.col("ts") < F.lit(CUT)) if s.table_id == "events" else df


@_query(_sql("SELECT entity_key, resolved_id FROM mem", I_A, E_A, cc=True))
def engine_incremental_run(spark, d):
    """A full run over the early events, then an incremental one over all: the result of a full run over all."""
    engine = _engine(spark, d, keep=_early)
    _done(engine.run(now=CUT))
    from kinweave.plans.engine import RunConfig

    engine.read = _read(spark, d)
    _done(engine.run(RunConfig("INCREMENTAL"), now=datetime(2024, 3, 1)))
    return engine.store.read("membership").select("entity_key", "resolved_id")


@_query(_sql("SELECT 'FULL' AS run_mode, 'SUCCESS' AS status, (SELECT count(*) FROM ent) AS entities_processed, (SELECT count(*) FROM lnk) AS edges_created, (SELECT count(DISTINCT resolved_id) FROM mem) AS clusters_impacted, 0::BIGINT AS groups_skipped", I_A, E_A, cc=True) + f", '{A.fingerprint()}' AS config_hash")
def engine_run_history(spark, d):
    return _full_run(spark, d).read("run_history").select("run_mode", "status", "entities_processed", "edges_created", "clusters_impacted", "groups_skipped", "config_hash")


@_query(_sql("SELECT 'entities' AS stage_name, 1 AS stage_order, (SELECT count(*) FROM ent) AS rows_out UNION ALL SELECT 'identifiers', 2, (SELECT count(*) FROM ids) UNION ALL SELECT 'edges', 3, (SELECT count(*) FROM lnk) UNION ALL SELECT 'skipped', 4, (SELECT count(*) FROM grp WHERE n > 50) UNION ALL SELECT 'components', 5, (SELECT count(*) FROM ent)", I_A, E_A, cap=50))
def engine_stage_metrics(spark, d):
    engine = _engine(spark, d, A_CAP)
    _done(engine.run(now=CUT))
    return engine.store.read("stage_metrics").select("stage_name", "stage_order", "rows_out")


@_query("WITH e AS (SELECT 'orders:' || o_orderkey AS k, o_custkey AS c, TRUE AS old FROM orders UNION ALL SELECT 'customer:' || c_custkey, c_custkey, TRUE FROM customer UNION ALL SELECT 'events:' || event_id, user_id, ts < TIMESTAMP '2024-01-15' FROM events), s AS (SELECT *, min(k) OVER (PARTITION BY c) AS new_id, min(k) FILTER (old) OVER (PARTITION BY c) AS old_id FROM e) SELECT CASE WHEN NOT old THEN 'NEW' WHEN old_id <> new_id THEN 'MOVED' ELSE 'UNCHANGED' END AS change_type, count(*) AS n FROM s GROUP BY 1")
def engine_dry_run(spark, d):
    from kinweave.plans.engine import RunConfig

    engine = _engine(spark, d, keep=_early)
    _done(engine.run(now=CUT))
    engine.read = _read(spark, d)
    _done(engine.run(RunConfig("FULL", dry_run=True), now=datetime(2024, 3, 1)))
    return preview.breakdown(engine.store.read("dry_run_results"))


@_query(_sql("SELECT left_entity_key AS entity_key_a, right_entity_key AS entity_key_b, 'exact_' || identifier_type AS rule_id, identifier_value_norm AS match_value FROM lnk", I_A))
def engine_evidence(spark, d):
    return _full_run(spark, d).read("evidence").select("entity_key_a", "entity_key_b", "rule_id", "match_value")


@_query(f"SELECT '{A.fingerprint()}' AS config_hash, TRUE AS same, 1::BIGINT AS snapshots, 2::BIGINT AS runs")
def engine_config_snapshot(spark, d):
    engine = _engine(spark, d, Config(A.sources[:1], A.rules))
    engine.config = A
    engine.read = lambda s: _read(spark, d)(s)
    _done(engine.run(now=CUT))
    _done(engine.run(now=datetime(2024, 3, 1)))
    found = engine.store.read("config_snapshot")
    same = json.loads(found.first().config_json) == json.loads(json.dumps(A.to_dict()))
    return found.select("config_hash", F.lit(same).alias("same"), F.lit(found.count()).cast("long").alias("snapshots"), F.lit(engine.store.read("run_history").count()).cast("long").alias("runs"))


@_query("SELECT 'customer' AS table_id, NULL::TIMESTAMP AS later UNION ALL SELECT 'orders', max(o_orderdate) FROM orders UNION ALL SELECT 'events', max(ts) FROM events")
def engine_run_state(spark, d):
    found = _full_run(spark, d).read("run_state")
    return _ntz(found.select("table_id", F.when(F.col("table_id") != "customer", F.col("last_watermark_value")).alias("later")), "later")


@_query("SELECT 'resolve_entities' AS metric_name, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS metric_value")
def engine_metrics(spark, d):
    return _full_run(spark, d).read("metrics_export").where("metric_name = 'resolve_entities'").select("metric_name", F.col("metric_value").cast("long").alias("metric_value"))


# the delta of incremental runs
LATE_DELTA = "del AS (SELECT * FROM ids WHERE entity_key IN (SELECT 'events:' || event_id FROM events WHERE ts > TIMESTAMP '2024-01-15') OR entity_key IN (SELECT 'orders:' || o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'))"


def _late(spark, d, ids: DataFrame) -> DataFrame:
    c = Config((ORDERS, core.EVENTS), A.rules)
    return ids.join(extract.entities(spark, c, _read(spark, d), core.LATE, True).select("entity_key"), "entity_key", "left_semi")


@_query(_sql("", I_A, E_A, cc=True) + f", {LATE_DELTA}, tou AS (SELECT entity_key FROM ids WHERE v IN (SELECT v FROM del)), cl AS (SELECT DISTINCT resolved_id FROM mem WHERE entity_key IN (SELECT entity_key FROM tou)) SELECT entity_key FROM tou UNION SELECT entity_key FROM mem WHERE resolved_id IN (SELECT resolved_id FROM cl)")
def impacted_members(spark, d):
    ids = _ids(spark, d, A)
    return edges.closed_members(_late(spark, d, ids), ids, _members(spark, d, A))


@_query(_sql("", I_A) + f", {LATE_DELTA} SELECT lnk.* FROM lnk WHERE identifier_value_norm IN (SELECT v FROM del)")
def incremental_edges(spark, d):
    ids = _ids(spark, d, A)
    return edges.anchor_edges(edges.delta_members(_late(spark, d, ids), ids))


@_query(ORACLES["golden_profile"])
def golden_profile_incremental(spark, d):
    """The profiles without events are stored; those of clusters that events touch are made anew."""
    names = [r.attribute for r in GOLDEN]
    wide, members = extract.wide_profiles(spark, WIDE, _read(spark, d), names), _members(spark, d, A)
    stored = survivorship.golden(wide.where("source_id <> 'events'"), members, GOLDEN)
    touched = members.where("entity_key like 'events:%'").select("resolved_id").distinct()
    return survivorship.golden_incremental(wide, members, GOLDEN, stored, touched)


@_query(_sql("", I_B, cc=True) + ", " + core.STATS + " SELECT resolved_id, cluster_size, edge_diversity, match_density, confidence_score FROM sc")
def confidence_incremental(spark, d):
    """Half of the clusters keep stored statistics, which an older and larger normaliser had scored."""
    members, links = _resolved(spark, d, B)
    half = F.crc32(F.col("resolved_id").cast("binary")) % 2 == 0
    stored = scoring.confidence(members, links, max_diversity=9).where(half)
    fresh = scoring.statistics(members, links).where(~half)
    return scoring.scored(stored.select(*fresh.columns).unionByName(fresh)).drop("primary_reason")


@_query(_sql("SELECT count(DISTINCT resolved_id) AS clusters, count(*) AS entities FROM mem", I_A, E_A, cc=True))
def distinct_clusters(spark, d):
    return _members(spark, d, A).agg(F.count_distinct("resolved_id").alias("clusters"), F.count(F.lit(1)).alias("entities"))


@_query(f"WITH {W_SQL}, v AS (SELECT resolved_id, 'status' AS attribute, status AS value, source_id, recency FROM w UNION ALL SELECT resolved_id, 'order_priority', order_priority, source_id, recency FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY resolved_id, attribute ORDER BY CASE source_id WHEN 'events' THEN 1 WHEN 'orders' THEN 2 ELSE 999 END, recency DESC, value) AS k FROM v WHERE value IS NOT NULL) SELECT resolved_id, attribute, value FROM r WHERE k = 1")
def golden_ranked_by_source(spark, d):
    names = ["status", "order_priority"]
    return survivorship.ranked_by_source(extract.wide_profiles(spark, A, _read(spark, d), names), _members(spark, d, A), names, ("events", "orders"))


TRUSTED = Config((Source("customer", "customer", "c_custkey", A.sources[0].identifiers, trust_rank=3), Source("orders", "orders", "o_orderkey", ORDERS.identifiers, ORDERS.attributes, "o_orderdate", trust_rank=2), Source("events", "events", "event_id", core.EVENTS.identifiers, core.EVENTS.attributes, "ts", trust_rank=1)), A.rules, survivorship=(Survivorship("status", "PRIORITY"),))


@_query(core._best("status", "CASE source_id WHEN 'events' THEN 1 WHEN 'orders' THEN 2 ELSE 999 END, recency DESC, status"))
def survivorship_by_trust(spark, d):
    rules = TRUSTED.survivorship_rules()
    return survivorship.golden(extract.wide_profiles(spark, TRUSTED, _read(spark, d), ["status"]), _members(spark, d, A), rules)


# read side
for _spec in ("dashboard", "quickstart", "guide"):
    core._histogram(_spec)


@_query("WITH m AS (SELECT max(o_orderdate)::DATE AS t FROM orders) SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS runs, round(100.0 * count(*) FILTER (o_orderstatus <> 'F') / count(*), 1) AS success_rate, round(avg(CAST(o_custkey AS DOUBLE)), 0) AS avg_duration, sum(o_custkey)::BIGINT AS entities, sum(o_orderkey % 3)::BIGINT AS groups_skipped FROM orders, m WHERE o_orderdate::DATE BETWEEN t - 30 AND t GROUP BY 1")
def run_statistics_month(spark, d):
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCESS")
    runs = o.select(F.col("o_orderdate").alias("started_at"), status.alias("status"), F.col("o_custkey").cast("double").alias("duration_seconds"), F.col("o_custkey").alias("entities_processed"), (F.col("o_orderkey") % 3).alias("groups_skipped"))
    today: date = o.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return Q.run_statistics(runs, today)


@_query("SELECT CAST(o_custkey AS VARCHAR) AS run_id, sum(o_orderkey)::BIGINT AS total_edges, min(o_orderdate) AS started_at, max(o_orderdate) AS ended_at, date_diff('minute', min(o_orderdate), max(o_orderdate))::BIGINT AS minutes FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def audit_duration_topk(spark, d):
    audit = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("edges_created"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("ended_at"))
    return Q.audit_duration(audit)


@_query("SELECT count(*) AS rows, count(lang) AS with_lang, count(source) AS with_source, count(*) FILTER (lang IS NULL AND source IS NULL) AS orphaned FROM documents")
def coverage_of_none(spark, d):
    return Q.all_null(_t(spark, d, "documents"), ["lang", "source"])


@_query(_sql("SELECT resolved_id, 'customer' AS source_id, CAST(c_custkey AS VARCHAR) AS source_key, c_name, NULL::VARCHAR AS o_orderstatus FROM mem JOIN customer ON entity_key = 'customer:' || c_custkey UNION ALL SELECT resolved_id, 'orders', CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus FROM mem JOIN orders ON entity_key = 'orders:' || o_orderkey", I_A, E_A, cc=True))
def back_to_sources(spark, d):
    return Q.back_to_sources(_members(spark, d, A), {"customer": (_t(spark, d, "customer"), "c_custkey"), "orders": (_t(spark, d, "orders"), "o_orderkey")}, ["c_name", "o_orderstatus"])


@_query(f"WITH {W_SQL}, s AS (SELECT resolved_id, max(number) AS number FROM w GROUP BY 1), c AS (SELECT resolved_id, count(*) FILTER (mem.entity_key LIKE 'orders:%') AS orders_count, count(*) FILTER (mem.entity_key LIKE 'events:%') AS events_count FROM mem JOIN lab USING (c) GROUP BY 1) SELECT s.resolved_id, number, orders_count, events_count FROM s JOIN c USING (resolved_id)")
def customer_360_profile(spark, d):
    members = _members(spark, d, A)
    profile = survivorship.golden(extract.wide_profiles(spark, WIDE, _read(spark, d), ["number"]), members, (Survivorship("number", "AGG_MAX"),))
    return Q.customer_360(members, ["orders", "events"], profile)


@_query(_sql("", I_A, E_A, cc=True) + ", hit AS (SELECT DISTINCT resolved_id FROM mem JOIN (SELECT left_entity_key AS entity_key FROM lnk WHERE contains(identifier_value_norm, '123') UNION SELECT right_entity_key FROM lnk WHERE contains(identifier_value_norm, '123')) USING (entity_key)), sz AS (SELECT resolved_id, count(*) AS cluster_size FROM mem GROUP BY 1) SELECT resolved_id, cluster_size FROM sz WHERE resolved_id IN (SELECT resolved_id FROM hit) ORDER BY 1 LIMIT 50")
def search_with_sizes(spark, d):
    members, links = _resolved(spark, d, A)
    return Q.search_clusters(links, members, scoring.cluster_sizes(members), "123")


@_query(_sql("SELECT 'member' AS part, entity_key AS a, split_part(entity_key, ':', 1) AS b FROM mem WHERE resolved_id = 'customer:3' UNION ALL SELECT 'cluster', resolved_id, CAST(count(*) AS VARCHAR) FROM mem WHERE resolved_id = 'customer:3' GROUP BY 2 UNION ALL SELECT 'edge', left_entity_key, right_entity_key FROM lnk WHERE right_entity_key = 'customer:3'", I_A, E_A, cc=True))
def cluster_detail(spark, d):
    members, links = _resolved(spark, d, A)
    found = Q.cluster_detail(scoring.confidence(members, links), members, links, "customer:3")
    header = found["cluster"].select(F.lit("cluster").alias("part"), F.col("resolved_id").alias("a"), F.col("cluster_size").cast("string").alias("b"))
    return header.unionAll(found["members"].select(F.lit("member"), "entity_key", "source_id")).unionAll(found["edges"].select(F.lit("edge"), "left_entity_key", "right_entity_key"))


@_query("WITH s AS (SELECT count(*) FILTER (change_type = 'MOVED') AS moved, (SELECT max(n) FROM (SELECT count(*) AS n FROM prop GROUP BY resolved_id)) AS top FROM ch) SELECT moved <= 10000 AND top <= 50000 AS live, moved <= 0 AND top <= 50000 AS strict FROM s".join([f"WITH {CUR}, ", ""]).replace(", WITH s", ", s"))
def scheduled_gate(spark, d):
    row = preview.summary(preview.changes(*_states(spark, d), removed=True)).first()
    return spark.createDataFrame([(preview.gate(row), preview.gate(row, max_moved=0))], "live boolean, strict boolean")


@_query(_values([("blocking names a side", True), ("score without b", True), ("unknown attribute", True), ("constant block", True), ("good", False)], "rule, skipped"))
def fuzzy_rule_guards(spark, d):
    from kinweave.plans.config import FuzzyRule

    rules = {"blocking names a side": ("<a>.nation", "f(<a>.name, <b>.name)"), "score without b": ("nation", "f(<a>.name)"), "unknown attribute": ("nation", "f(<a>.phone, <b>.phone)"), "constant block": ("'x'", "f(<a>.name, <b>.name)"), "good": ("nation", "f(<a>.name, <b>.name)")}
    return spark.createDataFrame([(n, fuzzy.usable(FuzzyRule(n, b, s, 0.9), {"name", "nation"}) is not None) for n, (b, s) in rules.items()], "rule string, skipped boolean")


@_query(f"WITH {core.P_SQL} SELECT 'fuzzy:name' AS identifier_type, nation AS identifier_value_norm, count(*) AS group_size, 1 AS max_allowed, 'EXCEEDED_BLOCK_CAP' AS reason FROM pr GROUP BY 2 HAVING count(*) > 1")
def skipped_blocks(spark, d):
    return fuzzy.skipped_blocks(core._profile(spark, d), core.SUPPLIER_PROFILE.fuzzy[0], 1)


TWO_RULES = (core.FuzzyRule("second", "nation", "levenshtein(<a>.name, <b>.name) * 0.0 + 1.0", 2.0, priority=2), core.FuzzyRule("first", "nation", "1.0 - levenshtein(<a>.name, <b>.name) / greatest(length(<a>.name), length(<b>.name), 1)", 0.9, priority=1))


@_query(f"WITH {core.P_SQL}, {core.LEV} SELECT 'first' AS rule, count(*) AS pairs FROM lv HAVING count(*) > 0")
def fuzzy_rules_in_order(spark, d):
    return fuzzy.super_clusters(core._profile(spark, d), TWO_RULES)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"))


@_query("WITH ids AS (SELECT DISTINCT 'pages:' || page_id AS k, lower(split_part(split_part(url, '://', 2), '/', 1)) AS v FROM pages) SELECT v AS identifier_value_norm, count(*) AS group_size FROM ids GROUP BY 1 HAVING count(*) > 5 ORDER BY 2 DESC, 1 LIMIT 10")
def skipped_groups_topk(spark, d):
    return edges.skipped_groups(_ids(spark, d, core.CAP_PAGES)).orderBy(F.desc("group_size"), "identifier_value_norm").limit(10).select("identifier_value_norm", "group_size")


# streams
@_query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderstatus = 'F'")
def alert_stream(spark, d):
    """Failed runs of a history, read as a stream of its versions into a table: each once, though it stands in two versions."""
    from kinweave.streaming.ingest import run_alerts

    place = store.Store(spark, _place(spark, "store"))
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCESS")
    runs = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), status.alias("status"), F.lit(CUT).cast("timestamp").alias("started_at"))
    for _ in range(2):
        place.publish({"run_history": runs})
    out = _place(spark, "alerts")
    run_alerts(spark, place.folder, _place(spark, "stream"), lambda b: b.write.mode("append").parquet(out)).awaitTermination()
    return spark.read.schema("run_id string").parquet(out).select("run_id")


# generators
def _draw(name: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{name}', '42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(values, at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(floor({at} * {len(values)}) AS INTEGER) + 1]"


def _cuts(values, at: str) -> str:
    out, total = "CASE", 0.0
    for v, share in values[:-1]:
        total += share
        out += f" WHEN {at} < {total!r}::DOUBLE THEN {v if not isinstance(v, str) else repr(v)}"
    return f"{out} ELSE {values[-1][0] if not isinstance(values[-1][0], str) else repr(values[-1][0])} END"


def _typo_sql(value: str, name: str, rate: float) -> str:
    n = f"length({value})"
    at = f"(CAST(floor({_draw(name + 'at', 'person_id', 'n')} * greatest({n} - 1, 1)) AS INTEGER) + 1)"
    head, a, b, tail = f"substr({value}, 1, {at} - 1)", f"substr({value}, {at}, 1)", f"substr({value}, {at} + 1, 1)", f"substr({value}, {at} + 2)"
    kind = _draw(name + "kind", "person_id", "n")
    return f"CASE WHEN {_draw(name, 'person_id', 'n')} < {rate} AND {n} > 2 THEN CASE WHEN {kind} < 0.25 THEN {head} || {b} || {a} || {tail} WHEN {kind} < 0.5 THEN {head} || {b} || {tail} WHEN {kind} < 0.75 THEN {head} || 'x' || {b} || {tail} ELSE {head} || {a} || {a} || {b} || {tail} END ELSE {value} END"


_NICK = "CASE first0 " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in datagen.NICKNAMES) + " ELSE first0 END"
_SHOWN = lambda c, share: f"CASE WHEN n = 0 OR {_draw(c, 'person_id', 'n')} < {share} THEN {c}0 END"
PEOPLE = f"""WITH p AS (SELECT c_custkey AS person_id, {_cuts([(f"({lo} + CAST(floor({_draw('within', 'c_custkey')} * {hi - lo + 1}) AS INTEGER))", s) for lo, hi, s in datagen.DEMO_MIX], _draw('size', 'c_custkey')).replace("'(", "(").replace(")'", ")").replace('"', '')} AS records,
  {_pick(datagen.FIRST, _draw('first', 'c_custkey'))} AS first0, {_pick(datagen.LAST, _draw('last', 'c_custkey'))} AS last0, {_cuts(datagen.DOMAINS, _draw('domain', 'c_custkey'))} AS dom FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS c_custkey)),
 r AS (SELECT *, unnest(range(0, records)) AS n FROM p),
 s AS (SELECT *, first0 || '.' || last0 || person_id || '@' || dom AS email0, CAST(person_id + 2000000000 AS VARCHAR) AS phone0, 'L' || lpad(CAST(person_id AS VARCHAR), 8, '0') AS loyalty_id0 FROM r),
 t AS (SELECT *, CASE WHEN {_draw('nick', 'person_id', 'n')} < 0.25 THEN {_NICK} ELSE first0 END AS first1, CASE WHEN n = 0 OR {_draw('email', 'person_id', 'n')} < 0.6 THEN email0 END AS email1, CASE WHEN n = 0 OR {_draw('phone', 'person_id', 'n')} < 0.4 THEN phone0 END AS phone1 FROM s)"""


@_query(PEOPLE + f""" SELECT 'C-' || person_id || '-' || n AS customer_id, person_id, {_pick(datagen.SOURCES, _draw('source', 'person_id', 'n'))} AS source_system, {_typo_sql('first1', 'ft', 0.08)} AS first_name, {_typo_sql('last0', 'lt', 0.08)} AS last_name,
 CASE WHEN {_draw('en', 'person_id', 'n')} < 0.02 THEN upper(email1) WHEN {_draw('en', 'person_id', 'n')} < 0.03 THEN split_part(email1, '@', 1) || '+news@' || split_part(email1, '@', 2)
  WHEN {_draw('en', 'person_id', 'n')} < 0.04 AND split_part(email1, '@', 2) = 'gmail.com' THEN list_aggregate(list_transform(range(1, length(split_part(email1, '@', 1)) + 1), lambda i: substr(email1, i, 1) || CASE WHEN regexp_matches(substr(email1, i, 2), '^[a-z][a-z]$') THEN '.' ELSE '' END), 'string_agg', '') || '@gmail.com' ELSE email1 END AS email,
 CASE WHEN {_draw('pn', 'person_id', 'n')} < 0.02 THEN '+1' || phone1 WHEN {_draw('pn', 'person_id', 'n')} < 0.05 THEN substr(phone1, 1, 3) || '-' || substr(phone1, 4, 3) || '-' || substr(phone1, 7, 4) ELSE phone1 END AS phone,
 CASE WHEN n = 0 OR {_draw('loyalty_id', 'person_id', 'n')} < 0.3 THEN loyalty_id0 END AS loyalty_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(floor({_draw('at', 'person_id', 'n')} * 31536000) AS BIGINT)) AS created_at FROM t""")
def synthetic_customers(spark, d):
    """As many generated persons as there are customers, with their truth."""
    people = datagen.customers(spark, _t(spark, d, "customer").count(), typo_rate=0.08, nickname_rate=0.25)
    return _ntz(people, "created_at")


@_query(PEOPLE.split(",\n s AS")[0] + ", z AS (SELECT records AS size, count(*) AS clusters FROM p GROUP BY 1) SELECT size::BIGINT AS size, clusters, clusters / sum(clusters) OVER () AS share FROM z")
def synthetic_cluster_mix(spark, d):
    return datagen.cluster_mix(datagen.customers(spark, _t(spark, d, "customer").count()))


@_query(PEOPLE + " SELECT 'crm:C-' || person_id || '-' || n AS entity_key, person_id FROM t")
def synthetic_truth(spark, d):
    return datagen.truth_links(datagen.customers(spark, _t(spark, d, "customer").count()), "crm")


def _postal_sql() -> str:
    letter = lambda k: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(floor({_draw('zip' + k, 's_suppkey')} * 26) AS INTEGER) + 1, 1)"
    digit = lambda k: f"CAST(CAST(floor({_draw('zip' + k, 's_suppkey')} * 10) AS INTEGER) AS VARCHAR)"
    rest = " ".join(f"WHEN '{c}' THEN lpad(CAST(CAST(floor({_draw('zip', 's_suppkey')} * {10**n}) AS BIGINT) AS VARCHAR), {n}, '0')" for c, n in datagen.POSTAL_DIGITS)
    return f"CASE country WHEN 'UK' THEN {letter('a')} || {letter('b')} || {digit('1')} || ' ' || {digit('2')} || {letter('c')} || {letter('d')} {rest} END"


COUNTRIES = ("US", "UK", "HK", "KR", "AU", "IN")


@_query(f"""WITH c AS (SELECT s_suppkey, {_pick(COUNTRIES, _draw('country', 's_suppkey'))} AS country, 'name' || s_suppkey || '@x.com' AS e, CAST(s_suppkey + 2000000000 AS VARCHAR) AS p, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 300 AS INTEGER)) AS a FROM supplier),
 r AS (SELECT *, CASE WHEN {_draw('pp', 's_suppkey')} < 0.3 THEN '(' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7, 4) ELSE p END AS p1, CASE WHEN {_draw('ea', 's_suppkey')} < 0.05 THEN replace(e, '@', '+promo@') ELSE e END AS e1 FROM c),
 q AS (SELECT *, CASE WHEN {_draw('px', 's_suppkey')} < 0.2 THEN '+1' || p1 ELSE p1 END AS phone_raw, CASE WHEN {_draw('eu', 's_suppkey')} < 0.1 THEN upper(e1) ELSE e1 END AS e2, a + to_seconds(CAST(floor({_draw('late', 's_suppkey')} * 864001) AS BIGINT)) AS updated_at FROM r)
 SELECT s_suppkey, country, {_postal_sql()} AS postal, phone_raw, CASE WHEN {_draw('es', 's_suppkey')} < 0.05 THEN ' ' || e2 || ' ' ELSE e2 END AS email_raw, updated_at, strftime(updated_at, '%Y-%m-%d') AS created_date,
  CASE WHEN {_draw('m', 's_suppkey')} < 0.5 THEN substr(p, 1, CAST(floor({_draw('mat', 's_suppkey')} * 10) AS INTEGER)) || translate(substr(p, CAST(floor({_draw('mat', 's_suppkey')} * 10) AS INTEGER) + 1, 1), '0123456789', '1234567890') || substr(p, CAST(floor({_draw('mat', 's_suppkey')} * 10) AS INTEGER) + 2) ELSE p END AS mutated FROM q""")
def synthetic_formats(spark, d):
    key, f = ("s_suppkey",), (lambda n: datagen.draw(n, 42, "s_suppkey"))
    email = F.concat(F.lit("name"), F.col("s_suppkey").cast("string"), F.lit("@x.com"))
    phone = (F.col("s_suppkey") + 2_000_000_000).cast("string")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("s_suppkey") % 300) * 86_400)
    rows = _t(spark, d, "supplier").select("s_suppkey", datagen.choose(COUNTRIES, f("country")).alias("country"), datagen.raw_phone(phone, f("pp"), f("px")).alias("phone_raw"), datagen.raw_email(email, f("ea"), f("eu"), f("es")).alias("email_raw"), datagen.delayed(at, 10, "late", 42, *key).alias("updated_at"), datagen.mutated_phone(phone, 0.5, "m", 42, *key).alias("mutated"))
    return _ntz(rows.withColumns({"postal": datagen.postal_code(F.col("country"), "zip", 42, *key), "created_date": datagen.date_string(F.col("updated_at"))}), "updated_at")


def _retail_count(name: str) -> str:
    return f"(SELECT sum(floor({_draw(name + 'n', 'k')} * {2 * datagen.RETAIL[name][0] + 1}::DOUBLE))::BIGINT FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS k))"


@_query(" UNION ALL ".join(f"SELECT '{n}' AS stage, {_retail_count(n)} AS rows" for n in datagen.RETAIL))
def synthetic_retail_counts(spark, d):
    return Q.stage_counts(datagen.retail(spark, _t(spark, d, "customer").count()))


#: Codes of names, as published for Soundex; Metaphone of the same names as its rules give them.
NAMES = (("Robert", "R163"), ("Rupert", "R163"), ("Rubin", "R150"), ("Ashcraft", "A261"), ("Ashcroft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("Honeyman", "H555"), ("Jackson", "J250"), ("Smith", "S530"), ("Washington", "W252"), ("Lee", "L000"), ("Gutierrez", "G362"))


@_query(_values(NAMES, "name, soundex"))
def soundex_codes(spark, d):
    return spark.createDataFrame([(n,) for n, _ in NAMES], "name string").select("name", F.soundex("name").alias("soundex"))


METAPHONES = (("Phone", "FN"), ("Smith", "SM0"), ("Knuth", "N0"), ("Wright", "RT"), ("Which", "WX"), ("Judge", "JJ"), ("Michael", "MXL"), ("Wayne", "WN"), ("Xavier", "SFR"))


@_query(_values(METAPHONES, "name, metaphone"))
def metaphone_codes(spark, d):
    return spark.createDataFrame([(n,) for n, _ in METAPHONES], "name string").select("name", T.metaphone(F.col("name")).alias("metaphone"))
