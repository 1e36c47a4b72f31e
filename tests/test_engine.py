"""Micro-fixtures of the resolution semantics, and runs of the engine."""

import random
from datetime import datetime

import pytest

from kinweave.operators import analytics, components, edges, extract, scoring
from kinweave.plans.config import Config, ConfigError, Exclusion, FuzzyRule, Rule, Source, Survivorship, from_dict
from kinweave.plans.engine import Engine, RunConfig
from kinweave.sources.store import Store

COLUMNS = "entity_id string, email string, phone string, updated_at timestamp"
AT = datetime(2024, 1, 1)


class World:
    def __init__(self, spark, tables, rules=(Rule("EMAIL", "LOWERCASE"), Rule("PHONE", "NONE")), **k):
        self.spark = spark
        self.tables = {n: [(*r, AT)[:4] if len(r) == 3 else r for r in rows] for n, rows in tables.items()}
        sources = tuple(Source(n, n, "entity_id", (("EMAIL", "email"), ("PHONE", "phone")), (("email", "email"), ("phone", "phone")), watermark="updated_at") for n in tables)
        self.config = Config(sources, rules, **k)

    def read(self, source):
        return self.spark.createDataFrame(self.tables[source.table], COLUMNS)

    def resolve(self):
        ids = extract.identifiers(self.spark, self.config, self.read)
        links = edges.anchor_edges(ids)
        nodes = extract.entities(self.spark, self.config, self.read).select("entity_key")
        members = components.resolve(nodes, links)
        return {r.entity_key: r.resolved_id for r in members.collect()}, links, members, ids


def test_same_email(spark):
    members, links, *_ = World(spark, {"source_a": [("A001", "shared@example.com", "5551234567")], "source_b": [("B001", "shared@example.com", "5559999999")]}).resolve()
    assert len(set(members.values())) == 1 and links.count() == 1
    row = links.first()
    assert (row.left_entity_key, row.right_entity_key) == ("source_b:B001", "source_a:A001")


def test_chain_is_transitive(spark):
    members, links, *_ = World(spark, {"a": [("1", "alice@example.com", None)], "b": [("2", "alice@example.com", "555")], "c": [("3", "charlie@example.com", "555")]}).resolve()
    assert set(members.values()) == {"a:1"} and links.count() == 2


def test_disjoint_case_and_singletons(spark):
    members, *_ = World(spark, {"d": [("1", "X@Example.com", None), ("2", "x@example.COM", "1"), ("3", "y@e.com", "2"), ("4", "z@e.com", "2"), ("5", None, None)]}).resolve()
    assert members["d:1"] == members["d:2"] and members["d:3"] == members["d:4"] and members["d:5"] == "d:5"
    assert len(set(members.values())) == 3


def test_cap_and_audit(spark):
    rows = {"l": [(f"L00{i}", None, "SHARED") for i in range(1, 8)]}
    members, links, _, ids = World(spark, rows, (Rule("PHONE", "NONE", 2),)).resolve()
    assert links.count() == 0 and len(set(members.values())) == 7
    row = edges.skipped_groups(ids, "r", AT).first()
    assert row.group_size == 7 and row.max_allowed == 2 and row.sample_entity_keys == '["l:L001","l:L002","l:L003","l:L004","l:L005"]' and row.reason == "EXCEEDED_MAX_GROUP_SIZE"


def test_exclusions(spark):
    rows = {"e": [("EX1", "test@test.com", None), ("EX2", "test@test.com", None), ("V1", "valid@real.com", None), ("V2", "valid@real.com", None), ("I1", "a@example.invalid", None), ("I2", "a@example.invalid", None)]}
    members, *_ = World(spark, rows, exclusions=(Exclusion("EMAIL", "test@test.com"), Exclusion("EMAIL", "%@example.invalid", "LIKE"))).resolve()
    assert members["e:EX1"] != members["e:EX2"] and members["e:V1"] == members["e:V2"] and members["e:I1"] != members["e:I2"]


def test_empty_string_is_a_value(spark):
    members, *_ = World(spark, {"t": [("A", "ab@test.com", ""), ("B", "ab@test.com", "555-0001"), ("C", "", "555-0001")]}).resolve()
    assert len(set(members.values())) == 1


def test_confidence(spark):
    w = World(spark, {"m": [("A", "m@x.com", "1"), ("B", "m@x.com", "1"), ("C", "s@x.com", None), ("D", "s@x.com", None), ("SOLO", None, None)]})
    _, links, members, _ = w.resolve()
    got = {r.resolved_id: r for r in scoring.confidence(members, links).collect()}
    assert got["m:SOLO"].confidence_score == 1.0 and got["m:SOLO"].primary_reason == "SINGLETON_NO_MATCH_REQUIRED"
    assert got["m:A"].edge_diversity == 2 and got["m:A"].confidence_score == 1.0
    assert got["m:C"].edge_diversity == 1 and got["m:C"].confidence_score == 0.75


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150))] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs + [(None, "n1")], "left string, right string")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in list(root)}
    links = df.where("left is not null")
    nodes = links.selectExpr("left as entity_key").union(links.selectExpr("right"))
    both = edges.both_ways(links.selectExpr("left as left_entity_key", "right as right_entity_key"))
    labels, rounds, settled = components.label_propagation(nodes, both, 80)
    assert settled and rounds > 2 and {r.entity_key: r.label for r in labels.collect()} == got


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "left string, right string")).count() == 0


RAW = {
    "sources": [{"id": "crm", "table": "s.crm", "entity_key": "id", "identifiers": [{"type": "EMAIL", "expr": "email"}], "attributes": {"name": "name"}, "watermark": "updated_at", "watermark_lookback": 5}],
    "rules": [{"identifier_type": "EMAIL", "canonicalize": "LOWERCASE", "max_group_size": 50}, {"name": "f", "type": "FUZZY", "blocking_key": "substring(name,1,1)", "score": {"spark": "levenshtein(<a>.name,<b>.name)"}, "threshold": 0.8}],
    "survivorship": {"name": {"strategy": "SOURCE_PRIORITY", "order": "['crm', 'web']"}},
}


def test_config_shapes():
    c = from_dict(RAW)
    assert c.sources[0].lookback_minutes == 5 and c.rules[0].max_group_size == 50 and c.fuzzy[0].threshold == 0.8 and c.survivorship[0].priority == ("crm", "web")
    assert len(c.fingerprint()) == 16 and from_dict(RAW).fingerprint() == c.fingerprint()
    for bad in ({}, {"sources": RAW["sources"]}, RAW | {"generate_evidence": "yes"}, RAW | {"survivorship": {"a": "WHATEVER"}}, RAW | {"rules": [{"identifier_type": "E", "canonicalize": "ROT13"}]},
                RAW | {"sources": [{"id": "x", "table": "a;drop", "identifiers": {"E": "e"}}]}, RAW | {"sources": [{"id": "x", "identifiers": {"E": "e; delete from t"}}]}):
        with pytest.raises(ConfigError):
            from_dict(bad)


def test_runs_full_then_incremental_equals_full(spark, tmp_path):
    first = {"a": [("1", "x@e.com", "1"), ("2", "y@e.com", "2")], "b": [("1", "y@e.com", None), ("9", None, None)]}
    w = World(spark, first, survivorship=(Survivorship("email", "PRIORITY", ("b", "a")),))
    engine = Engine(spark, w.config, w.read, Store(spark, str(tmp_path / "one")))
    r = engine.run(now=AT)
    assert r.status == "SUCCESS" and r.clusters == 3, r.error
    later = datetime(2024, 2, 1)
    w.tables["a"].append(("3", "x@e.com", "2", later))  # joins a:1 with a:2 and b:1
    w.tables["b"][1] = ("9", "new@e.com", None, later)
    dry = engine.run(RunConfig("INCREMENTAL", dry_run=True), later)
    assert dry.status == "DRY_RUN_COMPLETE" and dry.summary["new_entities"] == 1
    r = engine.run(RunConfig("INCR"), later)
    assert r.status == "SUCCESS", r.error
    full = Engine(spark, w.config, w.read, Store(spark, str(tmp_path / "two")))
    full.run(now=later)
    for table, columns in (("membership", ["entity_key", "resolved_id"]), ("edges", ["left_entity_key", "right_entity_key", "identifier_type"]), ("clusters", ["resolved_id", "cluster_size", "confidence_score"])):
        a, b = (sorted(map(tuple, e.store.read(table).select(*columns).collect())) for e in (engine, full))
        assert a == b, table
    assert engine.run(RunConfig("INCR"), later).status == "SUCCESS_NO_CHANGES"
    store = engine.store
    assert store.read("run_history").count() == 4 and store.read("config_snapshot").count() == 1 and store.read("evidence").count() > 0 and store.read("metrics_export").count() == 20
    assert {r.email for r in store.read("unified_profile").collect()} >= {"y@e.com"}
    assert analytics.success_rate(store.read("run_history")).first().success_rate == 75.0


def test_retracted_identifier_splits_a_cluster(spark, tmp_path):
    w = World(spark, {"a": [("1", "x@e.com", None), ("2", "x@e.com", None)]})
    engine = Engine(spark, w.config, w.read, Store(spark, str(tmp_path / "s")))
    engine.run(now=AT)
    w.tables["a"][1] = ("2", "other@e.com", None, datetime(2024, 3, 1))
    assert engine.run(RunConfig("INCR"), datetime(2024, 3, 2)).status == "SUCCESS"
    assert {r.entity_key: r.resolved_id for r in engine.store.read("membership").collect()} == {"a:1": "a:1", "a:2": "a:2"}


def test_failed_run_is_recorded(spark, tmp_path):
    w = World(spark, {"a": [("1", "x@e.com", None)]})
    del w.tables["a"]
    engine = Engine(spark, w.config, w.read, Store(spark, str(tmp_path / "s")))
    r = engine.run(now=AT)
    assert r.status == "FAILED" and engine.store.read("run_history").first().status == "FAILED"


def test_fuzzy_fixture(spark):
    from kinweave.operators import fuzzy

    rows = [("D1", "john", "doe", "jd@gmail.com"), ("D2", "james", "smith", "js@x.com"), ("D3", "mary", "major", "mm@gmail.com"), ("P1", "john", "doe", "jd@gmail.com"), ("P2", "jim", "smith", "zz@y.com"), ("P3", "zed", "major", "mm@gmil.com"), ("P4", None, "solo", None)]
    profile = spark.createDataFrame(rows, "resolved_id string, first_name string, last_name string, email string")
    rules = (FuzzyRule("first", "substring(last_name,1,1)", "jaro_winkler_similarity(<a>.first_name, <b>.first_name)", 0.6), FuzzyRule("mail", "substring(last_name,1,1)", "jaro_winkler_similarity(<a>.email, <b>.email)", 0.8),
             FuzzyRule("bad", "substring(last_name,1,1)", "levenshtein(first_name, email)", 0.8))
    with pytest.warns(UserWarning, match="bad skipped"):
        labels, _ = fuzzy.super_clusters(profile, rules)
    got = {r.resolved_id: r.super_cluster_id for r in labels.collect()}
    assert got["P1"] == "D1" and got["P2"] == "D2" and got["P3"] == "D3" and got["P4"] == "P4"
