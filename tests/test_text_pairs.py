"""Similarities of many pairs at once against one by one, discovery of configurations, and the dashboard."""

import random

import yaml

from kinweave.__main__ import main
from kinweave.functions import text as T
from kinweave.plans.config import from_dict
from kinweave.plans.discover import guessed, template


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé😀") for _ in range(rng.randrange(0, 12)))
    pairs = [(word(), word()) for _ in range(3000)] + [("", ""), ("martha", "marhta"), ("dixon", "dicksonx"), ("a", "a"), ("", "x")]
    for boost in (False, True):
        got = T.jaro_winkler_pairs([a for a, _ in pairs], [b for _, b in pairs], boost)
        assert all(abs(g - T._jaro_winkler(a, b, boost)) < 1e-12 for g, (a, b) in zip(got, pairs))


def test_similarity_of_nulls_long_and_repeated_values(spark):
    long = "x" * 60
    rows = [("martha", "marhta"), (None, "a"), ("a", None), (long, long + "y"), ("martha", "marhta"), ("", "a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(T.jaro_winkler("a", "b")).collect()]
    assert got[1] is None and got[2] is None and got[5] == 0.0 and abs(got[0] - 0.9611111) < 1e-6 and got[4] == got[0] and got[3] > 0.99


def test_guessed_configurations():
    c = from_dict(yaml.safe_load(template()))
    assert [s.table_id for s in c.sources] == ["customers", "orders"] and set(c.rule_of()) == {"EMAIL", "PHONE", "CUSTOMER_ID"}
    found = from_dict(yaml.safe_load(guessed({"t": ["row_key", "Mail_Address", "mobile_no", "name", "ts"]}))).sources[0]
    assert found.key == "row_key" and dict(found.identifiers) == {"EMAIL": "Mail_Address", "PHONE": "mobile_no"} and found.watermark == "ts"


def test_init_run_apply_and_dashboard(spark, tmp_path, capsys):
    path, store = str(tmp_path / "c.yaml"), str(tmp_path / "s")
    assert main(["init", path, "--folder", "/root/testdata/sf0.001", "--tables", "customer,orders"]) == 0
    assert main(["validate", path]) == 0
    assert main(["run", path, "--store", store, "--folder", "/root/testdata/sf0.001"]) == 0
    assert main(["dashboard", "--store", store, "--out", str(tmp_path / "d.html")]) == 0
    page = (tmp_path / "d.html").read_text()
    assert "v_run_summary" in page and "SUCCESS" in page
