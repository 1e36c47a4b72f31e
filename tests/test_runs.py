"""What a run records, options that must have an effect, publication by several writers, and incremental results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinweave.operators import analytics, components, edges, extract
from kinweave.plans.config import Config, ConfigError, Rule, Source, Survivorship, from_dict
from kinweave.plans.engine import Engine, RunConfig
from kinweave.sources import store as st
from kinweave.sources import views
from kinweave.streaming import ingest

NOW = datetime(2024, 5, 1)
SCHEMA = "id int, email string, phone string, name string, at timestamp"
CONFIG = Config(
    (Source("a", "a", "id", (("EMAIL", "email"), ("PHONE", "phone")), (("name", "name"), ("email", "email")), watermark="at", trust_rank=2), Source("b", "b", "id", (("EMAIL", "email"),), (("name", "name"),), watermark="at", trust_rank=1)),
    (Rule("EMAIL", priority=1), Rule("PHONE", "NONE", priority=2)), survivorship=(Survivorship("name", "PRIORITY"), Survivorship("email", "FREQUENCY")),
)


def rows(first, n, day, shift=0):
    at = datetime(2024, 1, 1) + timedelta(days=day)
    return [(i, f"e{(i + shift) % 7}@x" if i % 3 else None, f"p{i % 5}" if i % 4 == 0 else None, f"n{(i * 7 + shift) % 11}", at + timedelta(minutes=i)) for i in range(first, first + n)]


class World:
    def __init__(self, spark, folder, config=CONFIG):
        self.spark, self.tables = spark, {"a": rows(0, 12, 0), "b": rows(0, 6, 1)}
        self.engine = Engine(spark, config, lambda s: spark.createDataFrame(self.tables[s.table], SCHEMA), st.Store(spark, str(folder)))

    def read(self, table, *columns):
        return sorted(map(tuple, self.engine.store.read(table).select(*columns).collect()), key=str)


def test_incremental_clusters_and_profiles_equal_a_full_run(spark, tmp_path):
    w, full = World(spark, tmp_path / "inc"), World(spark, tmp_path / "full")
    assert w.engine.run(now=NOW).status == "SUCCESS"
    old = {r.resolved_id: r.updated_at for r in w.engine.store.read("unified_profile").collect()}
    for step, more in enumerate(({"a": rows(100, 5, 10, 3)}, {"b": [(200, "e1@x", None, "zz", datetime(2024, 3, 1)), (201, None, None, "lone", datetime(2024, 3, 2))]}), 1):
        for t, new in more.items():
            w.tables[t] = w.tables[t] + new
        assert w.engine.run(RunConfig("INCREMENTAL"), NOW + timedelta(hours=step)).status == "SUCCESS"
    full.tables = w.tables
    assert full.engine.run(now=NOW).status == "SUCCESS"
    assert any(r.updated_at == old.get(r.resolved_id) for r in w.engine.store.read("unified_profile").collect())
    for table, columns in {"membership": ["entity_key", "resolved_id"], "clusters": ["resolved_id", "cluster_size", "edge_diversity", "match_density", "confidence_score", "primary_reason", "pair_density"], "unified_profile": ["resolved_id", "name", "email"]}.items():
        assert w.read(table, *columns) == full.read(table, *columns), table
    assert len({r.updated_at for r in w.engine.store.read("clusters").collect()}) > 1  # untouched clusters were not made anew


CHAIN = {"a": [(1, "e1@x", "p1", "n", NOW), (2, "e1@x", "p2", "n", NOW), (3, "e2@x", "p2", "n", NOW), (4, "e2@x", "p3", "n", NOW), (5, "e3@x", "p3", "n", NOW)], "b": [(9, "e3@x", None, "n", NOW)]}


def test_a_run_records_stages_and_rounds(spark, tmp_path):
    w = World(spark, tmp_path / "s")
    w.tables = CHAIN
    result = w.engine.run(now=NOW)
    run = w.engine.store.read("run_history").first()
    assert result.rounds >= 1 and run.rounds == result.rounds and run.config_hash == CONFIG.fingerprint()
    stages = w.engine.store.read("stage_metrics").orderBy("stage_order").collect()
    assert [s.stage_name for s in stages] == ["entities", "identifiers", "edges", "skipped", "components"] and all(s.started_at is not None and s.duration_seconds >= 0 for s in stages)
    assert [s.started_at for s in stages] == sorted(s.started_at for s in stages)


def test_rounds_are_bounded(spark, tmp_path):
    w = World(spark, tmp_path / "s")
    w.tables = CHAIN
    assert w.engine.run(RunConfig(max_iters=0), NOW).status == "FAILED" and w.engine.run(now=NOW).clusters == 1
    w = World(spark, tmp_path / "t", from_dict({"sources": [{"id": "a", "identifiers": {"EMAIL": "email", "PHONE": "phone"}}], "rules": [{"type": "EXACT", "identifiers": ["EMAIL", "PHONE"]}], "settings": {"max_iterations": 0}}))
    w.tables = CHAIN
    assert w.engine.run(now=NOW).status == "FAILED"


def test_trust_rank_orders_sources(spark, tmp_path):
    assert CONFIG.survivorship_rules()[0].priority == ("b", "a")
    w = World(spark, tmp_path / "s")
    w.tables = {"a": [(1, "m@x", None, "from a", NOW)], "b": [(1, "m@x", None, "from b", datetime(2020, 1, 1))]}
    w.engine.run(now=NOW)
    assert w.engine.store.read("unified_profile").first().name == "from b"


def test_null_identifiers_that_a_rule_allows(spark):
    data = [(1, None, "p", "x", NOW), (2, None, "p", "y", NOW)]
    read = lambda s: spark.createDataFrame(data, SCHEMA)
    for require, n in ((True, 2), (False, 4)):
        c = Config((Source("a", "a", "id", (("EMAIL", "email"), ("PHONE", "phone"))),), (Rule("EMAIL", require_non_null=require), Rule("PHONE")))
        ids = extract.identifiers(spark, c, read)
        assert ids.count() == n and edges.anchor_edges(ids).count() == 1


def test_samples_of_oversized_groups_are_limited_before_the_shuffle(spark):
    ids = spark.range(1000).select(F.concat(F.lit("a:"), F.lpad("id", 4, "0")).alias("entity_key"), F.lit("E").alias("identifier_type"), F.lit("v").alias("identifier_value_norm"), F.lit(10).alias("max_group_size"))
    found = edges.skipped_groups(ids, "r", NOW)
    assert found.first().sample_entity_keys == "[" + ",".join(f'"a:{i:04d}"' for i in range(5)) + "]" and found.first().group_size == 1000
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()


def test_latest_run_is_the_one_that_started_last(spark):
    audit = spark.createDataFrame([("zz", "exact_E", 5, datetime(2024, 1, 1)), ("aa", "exact_E", 7, datetime(2024, 2, 1))], "run_id string, rule_id string, edges_created bigint, started_at timestamp")
    rules = spark.createDataFrame([("exact_E", "exact_E", "E", 1), ("exact_P", "exact_P", "P", 2)], "rule_id string, rule_name string, identifier_type string, priority int")
    got = {r.rule_id: r for r in analytics.rule_effectiveness(rules, audit).collect()}
    assert (got["exact_E"].total_edges, got["exact_E"].latest_edges, got["exact_E"].priority) == (12, 7, 1) and got["exact_P"].total_edges == 0


def test_percentiles_by_sketch(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), (F.col("id") / 1000.0).alias("v"))
    exact = {r.g: r for r in analytics.percentiles(df, "v", ["g"]).collect()}
    near = {r.g: r for r in analytics.percentiles(df, "v", ["g"], 1000).collect()}
    assert all(abs(exact[g][p] - near[g][p]) < 0.3 for g in exact for p in ("p50", "p90", "p99"))


def test_one_of_two_writers_wins(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("t", NOW, "r1", NOW)], st.SCHEMAS["run_state"])
    s._fs.create(s._path(f"{s.folder}/_manifests/00000000"), False).close()  # another writer has the next manifest and is not done
    with pytest.raises(st.Conflict):
        s.publish({"run_state": row})
    assert s.read("run_state").count() == 0
    w = World(spark, tmp_path / "s")
    with pytest.raises(ConfigError, match="in progress"):
        w.engine.run(now=NOW)
    import os

    os.utime(tmp_path / "s" / "_manifests" / "00000000", (0, 0))  # it died long ago
    s.publish({"run_state": row})
    assert s.read("run_state").count() == 1
    with pytest.raises(st.Conflict):
        s._create(1, "{}")
    assert st.Store(spark, str(tmp_path / "s")).read("run_state").count() == 1


def test_running_and_stale_runs(spark, tmp_path):
    w = World(spark, tmp_path / "s")
    row = lambda at: spark.createDataFrame([("old", "FULL", "RUNNING", at)], "run_id string, run_mode string, status string, started_at timestamp")
    w.engine.store.publish({"run_history": row(NOW - timedelta(hours=1))})
    with pytest.raises(ConfigError, match="in progress"):
        w.engine.run(now=NOW)
    w.engine.store.publish({"run_history": row(NOW - timedelta(hours=9))})
    assert w.engine.run(now=NOW).status == "SUCCESS" and {r.run_id: r.status for r in w.engine.store.read("run_history").collect()}["old"] == "INTERRUPTED"


def test_initialize_reset_and_evolution(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "s"))
    s.publish({"dry_run_results": spark.createDataFrame([("r", "k")], "run_id string, entity_key string")})
    assert s.read("dry_run_results").columns[-1] == "created_at"  # a column that the schema has gained
    s.initialize()
    assert set(s.current()) == set(st.SCHEMAS) and s.read("dry_run_results").count() == 1
    s.initialize(reset=True)
    assert s.read("dry_run_results").count() == 0


def test_retention(spark, tmp_path):
    rows_ = [("r", "k", NOW - timedelta(days=d)) for d in (0, 6, 8, 100)]
    df = spark.createDataFrame(rows_, "run_id string, entity_key string, created_at timestamp")
    assert st.kept("dry_run_results", df, NOW).count() == 2 and st.kept("membership", df, NOW).count() == 4


def test_failed_batches_are_not_committed(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame(rows(0, 3, 0), SCHEMA).write.parquet(str(folder))
    w = World(spark, tmp_path / "s")
    w.engine.read = lambda s: spark.createDataFrame([], "nothing int")
    with pytest.raises(Exception, match="failed"):
        ingest.on_new_files(w.engine, spark.readStream.schema(SCHEMA).parquet(str(folder)), str(tmp_path / "c"), NOW).awaitTermination(120)
    seen = []
    for _ in range(2):  # the second time there is nothing new, though the failed run stands in every later version
        ingest.run_alerts(spark, str(tmp_path / "s"), str(tmp_path / "alerts"), lambda b: seen.extend(b.collect())).awaitTermination(120)
    assert [r.status for r in seen] == ["FAILED"]


def test_no_local_checkpoints_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        components.ensure_checkpoint_dir(Session())


def test_scratch_is_deleted(spark):
    import os

    components.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    with components.scratch(spark):
        inside = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        assert components.cut(spark.range(10)).count() == 10 and os.path.isdir(inside)
    assert spark.sparkContext.getCheckpointDir() == before and not os.path.exists(inside)


def test_exporters(spark, tmp_path, capsys):
    import http.server
    import json
    import threading

    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = st.Store(spark, str(tmp_path / "s"))
    s.publish({"metrics_export": spark.createDataFrame([(str(i), "r", "edges", float(i), "gauge", "{}", NOW, None) for i in range(3)], st.SCHEMAS["metrics_export"])})
    assert st.export_loop(s, f"http://127.0.0.1:{server.server_port}/m", lambda: NOW, lambda: False, 2) == 3
    server.shutdown()
    assert [len(g["metrics"]) for g in got] == [2, 1]
    st.exporter("prometheus")([{"metric_name": "edges", "metric_value": 1.0, "dimensions": None}])
    assert capsys.readouterr().out.strip() == "edges 1.0" and st.exporter("json:dumps")([]) == "[]"
    with pytest.raises(ValueError):
        st.exporter("nothing")


def test_views_of_a_store(spark, tmp_path):
    w = World(spark, tmp_path / "s")
    w.engine.run(now=NOW)
    found = views.views(w.engine.store, CONFIG)
    assert [(r.rule_id, r.identifier_type, r.priority) for r in found["v_rule_effectiveness"].collect()] == [("exact_EMAIL", "EMAIL", 1), ("exact_PHONE", "PHONE", 2)]
    assert found["v_run_summary"].count() == 1
