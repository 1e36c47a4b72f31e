"""Readers, the store, metric export and the streaming shells."""

import json
import logging
from datetime import datetime

import pytest

from kinweave.functions import text as T
from kinweave.plans.config import Config, ConfigError, Rule, Source
from kinweave.plans.engine import Engine, RunConfig
from kinweave.sources import readers, store
from kinweave.streaming import ingest
from pyspark.sql import functions as F

NOW = datetime(2024, 5, 1)


def test_parts_and_seeds(spark, tmp_path):
    assert readers.grouped_parts(["/x/orders_part_0002.parquet", "/x/orders_part_0001.parquet", "/x/customer.parquet", "/x/notes.txt"]) == {"customer": ["/x/customer.parquet"], "orders": ["/x/orders_part_0001.parquet", "/x/orders_part_0002.parquet"]}
    for i in (1, 2):
        spark.range(i * 10).write.parquet(str(tmp_path / f"t_part_000{i}.parquet"))
    assert readers.read_parts(spark, [str(p) for p in tmp_path.iterdir()])["t"].count() == 30
    (tmp_path / "seed.csv").write_text("rule_id,cap\na,1\nb,2\n")
    assert readers.read_seed(spark, str(tmp_path / "seed.csv"), "rule_id string, cap int").agg(F.sum("cap")).first()[0] == 3
    assert readers.query_one(spark, "SELECT :a + 1", a=1) == 2 and readers.query(spark, "SELECT 'x' AS v WHERE :f = 'x''y'", f="x'y") == [{"v": "x"}]
    assert readers.columns(spark.range(1)) == [{"name": "id", "type": "bigint"}]


def test_preflight(spark):
    c = Config((Source("a", "a", "id", (("E", "e"),)),), (Rule("E"),))
    ok = lambda s: spark.createDataFrame([], "id int, e string")
    assert readers.preflight(spark, c, ok) == []
    with pytest.raises(ConfigError):
        readers.preflight(spark, Config((), (Rule("E"),)), ok)
    assert readers.preflight(spark, c, lambda s: spark.createDataFrame([], "id int")) == ["a: E: e does not fit the table"]


def test_merges_and_retention(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c", True), (3, "d", True)], "k int, v string, fresh boolean")
    assert sorted((r.k, r.v) for r in store.upsert(a, b, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([(datetime(2024, 4, 30),), (datetime(2024, 1, 1),)], "at timestamp")
    assert store.retained(rows, "at", NOW, 7).count() == 1


def test_publication_is_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read("membership").count() == 0
    s.publish({"run_state": spark.createDataFrame([("t", NOW, "r1", NOW)], store.SCHEMAS["run_state"])})
    with pytest.raises(Exception, match="(?i)divide|zero"):
        s.publish({"run_state": spark.createDataFrame([], store.SCHEMAS["run_state"]), "clusters": spark.range(1).select(F.expr("1 / (id - id)").alias("cluster_size"))})
    assert s.read("run_state").first().last_run_id == "r1"
    s.publish({"run_state": store.upsert(s.read("run_state"), spark.createDataFrame([("t", NOW, "r2", NOW)], store.SCHEMAS["run_state"]), ["table_id"])})
    assert [r.last_run_id for r in s.read("run_state").collect()] == ["r2"]


def test_export_marks_what_it_sent(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = [(str(i), "r", "edges", float(i), "gauge", json.dumps({"rule": "E"}), datetime(2024, 1, i + 1), None) for i in range(5)]
    s.publish({"metrics_export": spark.createDataFrame(rows, store.SCHEMAS["metrics_export"])})
    sent = []
    store.EXPORTERS["test"] = sent.extend
    assert store.export(s, "test", NOW, 3) == 3 and [r["metric_id"] for r in sent] == ["0", "1", "2"]
    assert store.export(s, "test", NOW, 3) == 2 and store.export(s, "test", NOW, 3) == 0
    assert store.prometheus_text(sent[:1]) == 'edges{rule="E"} 0.0'
    record = logging.LogRecord("x", logging.INFO, "f", 1, "done", None, None)
    record.run_id = "r1"
    assert json.loads(store.JsonFormatter().format(record))["run_id"] == "r1"


def test_partitioned_write(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("p"), "id")
    store.write_partitioned(df, str(tmp_path / "w"), ["p"], 10, ["id"])
    assert spark.read.parquet(str(tmp_path / "w")).where("p = 1").count() == 33 and (tmp_path / "w" / "p=0").is_dir()


def test_text_functions(spark):
    df = spark.createDataFrame([("ab", "Jim", "James"), ("abcdef", "martha", "marhta"), (None, None, "x"), ("", "", "x")], "v string, a string, b string")
    assert [r[0] for r in df.select(T.mask_pii(F.col("v"), False)).collect()] == ["**", "ab***ef", None, ""]
    got = [r[0] for r in df.select(T.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.6888889, 1e-6) and got[1] == pytest.approx(0.9611111, 1e-6) and got[2] is None and got[3] == 0.0
    assert [r[0] for r in df.select(T.mask_by_role(F.col("v"), "guest", ("admin",))).collect()] == ["***MASKED***"] * 4
    assert df.select(T.contains_literal(F.col("a"), "IM")).first()[0] and not df.select(T.contains_literal(F.col("a"), "%")).first()[0]


def test_sound_codes(spark):
    for word, code in (("Thompson", "0MPSN"), ("Smith", "SM0"), ("Knight", "NT"), ("Physics", "FSKS"), ("Which", "WX"), ("Xavier", "SFR"), ("Dumb", "TM"), ("school", "SKL"), ("nation", "NXN"), ("edge", "EJ"), ("", ""), ("Phone", "FN"), ("fone", "FN"), ("catch", "KX")):
        assert T.metaphone_code(word) == code, (word, T.metaphone_code(word))
    T.register(spark)
    rows = spark.sql("SELECT metaphone(v), soundex(v) FROM VALUES ('Stephen'), ('Steven'), (NULL) t(v)").collect()
    assert rows[0][0] == rows[1][0] == "STFN" and rows[2][0] is None
    for t in T.fuzzy_templates():
        expression = t["sql"].replace("{col}", "v").replace("<a>.", "").replace("<b>.", "")
        assert spark.createDataFrame([("x",)], "v string").selectExpr(expression).first()[0] == 1.0


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "id int, email string, updated_at timestamp"
    spark.createDataFrame([(1, "a@x", datetime(2024, 1, 1)), (2, "a@x", datetime(2024, 1, 1))], schema).write.parquet(str(folder))
    c = Config((Source("t", "t", "id", (("EMAIL", "email"),), watermark="updated_at"),), (Rule("EMAIL"),))
    engine = Engine(spark, c, lambda s: spark.read.schema(schema).parquet(str(folder)), store.Store(spark, str(tmp_path / "s")))

    def turn():
        ingest.on_new_files(engine, spark.readStream.schema(schema).parquet(str(folder)), str(tmp_path / "c"), NOW).awaitTermination(120)

    turn()
    assert {r.resolved_id for r in engine.store.read("membership").collect()} == {"t:1"}
    spark.createDataFrame([(3, "b@x", datetime(2024, 2, 1)), (4, "a@x", datetime(2024, 2, 1))], schema).write.mode("append").parquet(str(folder))
    turn()
    assert sorted((r.entity_key, r.resolved_id) for r in engine.store.read("membership").collect()) == [("t:1", "t:1"), ("t:2", "t:1"), ("t:3", "t:3"), ("t:4", "t:1")]
    engine.read = lambda s: spark.createDataFrame([], "nothing int")
    assert engine.run(RunConfig(), NOW).status == "FAILED"
    seen = []
    ingest.run_alerts(spark, str(tmp_path / "s"), str(tmp_path / "a"), lambda b: seen.extend(b.collect())).awaitTermination(120)
    assert [r.status for r in seen] == ["FAILED"]
