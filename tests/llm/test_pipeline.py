"""The pipeline's stages one after the other against the operators' brute force, and every query at a small scale."""

import duckdb
import pytest

import corpus_pipeline
from kinweave.llm import queries
from tests.test_queries import DATA, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(left[name])
        if name != "mix":
            assert docs.columns == columns
    q = duckdb.connect()
    labels = dict(q.execute(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    right = [labels[i] == (i in left["quality"]) for i in labels]
    assert sum(right) >= 0.97 * len(right)
    texts = [" ".join(r.text.split()) for r in left["exact"].values()]
    assert len(set(texts)) == len(texts) and {" ".join(r.text.split()) for r in left["quality"].values()} == set(texts)

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: grams(r.text) for i, r in left["exact"].items()}
    near = set(left["near"])
    for a in near:
        assert not any(b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in near)
    for a in set(sets) - near:
        assert any(b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets)
    items = [t for (t,) in q.execute(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    for i, r in left["near"].items():
        assert (i in left["decontamination"]) != any(t in r.text for t in items)
    mix = left["mix"].values()
    assert set(left["mix"]) == set(left["decontamination"])
    assert abs(sum(r.taken for r in mix) - sum(r.size for r in mix)) < 0.2 * sum(r.size for r in mix)
    assert corpus_pipeline.run(spark, DATA).count() == len(mix)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, an empty table, columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = [(i, None if i % 11 == 0 else f"some words of document number {i} " * 6, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i in range(40)]
    rows += [rows[4], (None, None, None, None, None), (None, "no id here at all", None, "s1", 3), (50, "", "en", "s2", 0), (51, " \t ", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.withColumns({n: F.lit(1) for n in ("unit", "rep", "key", "place", "slot", "size", "going", "__key", "gone", "recipe", "block")})
    for table in (docs, wide, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            path = str(tmp_path / f"{name}{len(table.columns)}{table is docs}{hash(str(table))}")
            out.write.parquet(path)
            back = spark.read.parquet(path)
            if name == "mix":
                assert back.count() == table.count()
            else:
                assert back.columns == table.columns and back.exceptAll(table).count() == 0


def test_stages_give_memory_back(spark, monkeypatch):
    """Each stage gives back what finished work left in the driver, before and after its own jobs."""
    said = []
    real = corpus_pipeline.release
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: said.append(real(s)))
    docs = spark.createDataFrame([(i, f"some words of document number {i}", "en", "s", 30) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, DATA)
        assert len(said) == 2 * n
    assert all(x.startswith("Trim native heap") for x in said)
