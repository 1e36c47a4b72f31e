"""Generators, the command line, views, and resolution of generated customers against their truth."""

import json

from pyspark.sql import functions as F

from kinweave.__main__ import main
from kinweave.operators import analytics
from kinweave.sources import datagen, views
from kinweave.sources.store import Store


def test_customers_are_stable_and_mixed(spark):
    a = datagen.customers(spark, 2000)
    assert a.exceptAll(datagen.customers(spark, 2000).repartition(7)).count() == 0
    mix = {r["size"]: r.share for r in datagen.cluster_mix(a).collect()}
    assert abs(mix[1] - 0.35) < 0.05 and abs(mix[2] - 0.25) < 0.05 and max(mix) == 10
    first = a.where("customer_id like '%-0'")
    assert first.where("email is null or phone is null or loyalty_id is null").count() == 0
    noisy = datagen.customers(spark, 500, typo_rate=0.5, nickname_rate=0.5)
    assert noisy.select("first_name").distinct().count() > len(datagen.FIRST)
    assert a.where(F.col("email").rlike("[A-Z]")).count() > 0 and a.where(F.col("phone").contains("-")).count() > 0


def test_weighted_choice(spark):
    got = spark.range(4000).select(datagen.weighted(datagen.DOMAINS, datagen.draw("d", 1, "id")).alias("d")).groupBy("d").count().collect()
    assert {r.d: round(r["count"] / 4000, 1) for r in got} == dict(datagen.DOMAINS)


def test_quickstart_and_views(spark, tmp_path, capsys):
    folder = str(tmp_path / "s")
    assert main(["quickstart", "--store", folder, "--persons", "200"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "SUCCESS"
    s = Store(spark, folder)
    people = datagen.customers(spark, 200)
    row = analytics.truth_accuracy(datagen.truth_links(people, "demo"), s.read("membership")).first()
    assert row.persons == 200 and row.in_one_cluster > 40
    wrong = s.read("membership").join(datagen.truth_links(people, "demo"), "entity_key").groupBy("resolved_id").agg(F.count_distinct("person_id").alias("n")).where("n > 1")
    assert wrong.count() == 0
    names = views.register(s)
    assert "v_cluster_health" in names and all(spark.table(n).count() >= 0 for n in names)
    some = s.read("clusters").orderBy(F.desc("cluster_size")).first().resolved_id
    assert "***" in views.golden_profile(s, some).first().email


def test_command_line(spark, tmp_path, capsys):
    assert main(["version"]) == 0 and main(["fuzzy-templates"]) == 0 and main(["schema"]) == 0
    bad = tmp_path / "bad.yaml"
    bad.write_text("sources: []")
    assert main(["validate", str(bad)]) == 2
    good = tmp_path / "good.yaml"
    good.write_text("sources:\n- {id: customer, table: customer, entity_key: c_custkey, identifiers: {CUSTOMER_ID: c_custkey}}\n- {id: orders, table: orders, entity_key: o_orderkey, identifiers: {CUSTOMER_ID: o_custkey}, watermark: o_orderdate}\nrules:\n- {identifier_type: CUSTOMER_ID, canonicalize: NONE}\n")
    capsys.readouterr()
    assert main(["validate", str(good)]) == 0 and len(capsys.readouterr().out.strip()) == 16
    assert main(["run", str(good), "--store", str(tmp_path / "s"), "--folder", "/root/testdata/sf0.001"]) == 0
    assert json.loads(capsys.readouterr().out)["clusters"] == 150
