"""The learned encoder: labels that shape cannot tell apart, and the registered query."""

import random
import zlib

from kinweave.llm import quality_classifier as q
from tests.llm.fixtures import collected


def anagrams(seed=4, rows=900):
    """Documents of words of the same letters: good ones hold some words spelt backwards in one place, bad
    ones words with their halves exchanged."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    docs, labels = [], []
    for i in range(rows):
        words = [rng.choice(stems) for _ in range(rng.randrange(64, 260))]
        good = rng.random() < 0.5
        at = rng.randrange(0, len(words) - 40)
        words[at : at + 40] = [w[::-1] if good else w[3:] + w[:3] for w in words[at : at + 40]]
        docs.append((i, " ".join(words), 1.5, "x"))
        labels.append((i, int(good)))
    return docs, labels


def accuracy(spark, spread):
    docs, labels = anagrams()
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double, label string")
    old, q.SPREAD = q.SPREAD, spread
    try:
        model = q.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
        raw, offs = q.text_buffers(q.pa.array([d[1] for d in docs]))
        scores = [s for i, j in q.pieces(offs, q.PIECE_BYTES) for s in model.score(*q.encode(q.Words(raw, offs[i : j + 1])))]
    finally:
        q.SPREAD = old
    held = [(s, y) for s, (i, y) in zip(scores, labels) if zlib.crc32(str(i).encode()) % 4 == 2]
    return sum((s >= 0.5) == y for s, y in held) / len(held)


def test_encoder_learns_what_shape_cannot(spark):
    assert accuracy(spark, 0.0) < 0.65 and accuracy(spark, q.SPREAD) > 0.9


def test_registered_query(spark):
    from kinweave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in collected(spark.read.parquet(f"{folder}/labels.parquet"))}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = collected(QUERIES["op6_quality_classifier"](spark, folder))
    assert len(got) == docs.count() and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.7) for g in got)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got)
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert sum(g["predicted"] == truth[g["doc_id"]] for g in held) >= 0.97 * len(held)


def test_clashing_columns_and_odd_rows(spark):
    docs, labels = anagrams(rows=60)
    rows = docs + [(None, None, 0.0, ""), (1000, "", 0.0, None), (1001, "word " * 50_000, 0.0, "k"), docs[3]]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score double, label string, k int, y int")
    model = q.train(frame, spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, t string"))
    got = collected(q.score(frame, model))
    assert len(got) == len(rows) and {g["n_passages"] for g in got if g["doc_id"] == 1001} == {-(-50_000 // 64)}
    assert q.accepted(frame, model).columns == frame.columns
    assert q.accepted(frame, model).count() == sum(g["predicted"] for g in got)


def test_every_labelled_document_is_learned(spark):
    """Label 0 stands only at documents beyond the 3,000 that a fit was once limited to."""
    from pyspark.sql import functions as F

    ids = spark.range(4800).select(F.col("id").alias("k")).where(~q.held_out("k")).orderBy(F.xxhash64("k", F.lit(5)), "k")
    late = [r.k for r in ids.collect()][3000:]
    assert len(late) > 300
    texts = {i: "plain words of a usual kind" for i in range(4800)} | {i: "JUNK!! &&& 0101 JUNK!!" for i in late}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame([(i, int(i not in set(late))) for i in texts], "doc_id long, quality int"))
    kept = {r["doc_id"] for r in collected(q.accepted(docs, model))}
    assert kept == set(texts) - set(late)


def test_shards(spark, monkeypatch):
    """Many shards learn what one does, and the same weights however rows and tasks are dealt and labels joined."""
    docs, labels = anagrams()
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double, label string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.train(frame, known, shard_bytes=1 << 18)
    monkeypatch.setattr(q, "BROADCAST_LABELS", 0)
    again = q.train(frame.repartition(7, "text"), known.repartition(3), shard_bytes=1 << 18)
    assert all((again.w[k] == v).all() for k, v in model.w.items()) and (again.mean == model.mean).all() and (again.scale == model.scale).all()
    truth = dict(labels)
    held = [(g["score"] >= 0.5) == truth[g["doc_id"]] for g in collected(q.score(frame, model)) if g["held_out"]]
    assert sum(held) > 0.9 * len(held)
