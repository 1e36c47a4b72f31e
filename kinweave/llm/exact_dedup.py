"""Exact dedup by content-defined chunk recipes.

Texts are compared after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space. A text is cut where a rolling
hash of its last eight bytes says so; its *recipe* is the ordered list of its chunks' identifiers, and its *proof* the list of
a second, independent digest and the length of each chunk. Texts are read once, where they lie; only recipes and proofs move, 32 bytes
for two KB or so. Recipes that occur more than once name the documents whose chunks must be verified: their
(identifier, proof) pairs are deduplicated, and an identifier with two proofs is a clash: it stands for two contents. Upon a clash,
recipes are completed by the texts' SHA-256. So equal recipes have chunks of equal identifiers, equal second digests and equal
lengths; contents are never shipped to be compared byte by byte.

Edge cases: null text counts as empty; equal rows: one of them stays (a repeated row is a copy of itself);
null doc_id: sorts after every number, so such a row stays only if its whole group has none. Empty table: no
rows. Other columns are ignored.

``deduplicated`` keeps rows where they lie as long as the ids to drop are few (``BROADCAST_IDS``, counted first); beyond that
one equi-join on the id moves each row once. Rows whose id is null or repeated are told apart by their text as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import WHITE, batch, pieces, text_buffers, unused
from kinweave.operators.components import cut, rekeyed

MIN_CHUNK = 256
MEAN_BITS = 11
MAX_CHUNK = 16_384
DIGEST_BYTES = 16
PROOF_BYTES = 12
#: Ids that may be broadcast: 16 MB or so.
BROADCAST_IDS = 500_000


def normalised(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with each run of white space as one space."""
    base = int(offs[0])
    data = raw[base : int(offs[-1])]
    white = WHITE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1])
    rel = offs - base
    inner = rel[:-1][rel[:-1] < len(data)]
    keep[inner] = True
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(white, np.uint8(32), data)[keep], at[rel]


def cut_points(data: np.ndarray, start: int, end: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of data[start:end]; marks: positions after which the rolling hash cuts."""
    points, last = [], start
    for m in marks[np.searchsorted(marks, start + MIN_CHUNK) : np.searchsorted(marks, end)].tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            points.append(last)
        if m - last >= MIN_CHUNK:
            points.append(m)
            last = m
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        points.append(last)
    if last < end:
        points.append(end)
    return points


def chunk_marks(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    for step, k in ((1, 31), (2, 31**2), (4, 31**4)):
        y = x.copy()
        y[step:] += x[:-step] * np.uint32(k)
        x = y
    return np.flatnonzero((x * np.uint32(2654435761)) >> np.uint32(32 - MEAN_BITS) == 0) + 1


def _walk(column: pa.Array) -> Iterator[tuple[int, memoryview, list[int], int]]:
    """(row, normalised chunk of texts, chunk ends, start) of each text."""
    raw, offs = text_buffers(column)
    for i, j in pieces(offs):
        data, at = normalised(raw, offs[i : j + 1])
        marks = chunk_marks(data) if len(data) else np.zeros(0, np.int64)
        view = memoryview(data)
        for k in range(j - i):
            yield i + k, view, cut_points(data, int(at[k]), int(at[k + 1]), marks), int(at[k])


def _digest(part, size: int) -> bytes:
    return hashlib.blake2b(part, digest_size=size).digest()


def _proof(part) -> bytes:
    return hashlib.blake2b(part, digest_size=PROOF_BYTES, key=b"proof").digest() + len(part).to_bytes(4, "big")


def _recipes(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("proof", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas, lists, proofs = [], [], []
            for _, view, points, start in _walk(b.column(1)):
                ends = [start, *points]
                parts = [view[p:q] for p, q in zip(ends, ends[1:])]
                shas.append(hashlib.sha256(view[start : ends[-1]]).hexdigest())
                lists.append(b"".join(_digest(p, size) for p in parts))
                proofs.append(b"".join(map(_proof, parts)))
            yield batch(schema, doc_id=b.column(0), text_sha256=shas, recipe=lists, proof=proofs)

    return run


def _chunks(size: int):
    """(identifier, proof) of each chunk of (recipe, proof), distinct within a batch."""
    schema = pa.schema([("digest", pa.binary()), ("proof", pa.binary())])
    step = PROOF_BYTES + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[bytes, bytes]] = set()
            for recipe, proof in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.update((recipe[k * size : (k + 1) * size], proof[k * step : (k + 1) * step]) for k in range(len(proof) // step))
            rows = list(found)
            yield batch(schema, digest=[r[0] for r in rows], proof=[r[1] for r in rows])

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    recipes = cut(base.mapInArrow(_recipes(digest_bytes), "doc_id long, text_sha256 string, recipe binary, proof binary"))
    # rows with one recipe and proof are one row here, however many: a hot text counts once
    suspects = recipes.groupBy("recipe", "proof").agg(F.count(F.lit(1)).alias("n"))
    several = suspects.groupBy("recipe").agg(F.sum("n").alias("n"), F.min("proof").alias("low"), F.max("proof").alias("high")).where("n > 1")
    chunks = several.select("recipe", F.explode(F.array_distinct(F.array("low", "high"))).alias("proof")).mapInArrow(_chunks(digest_bytes), "digest binary, proof binary").distinct()
    clashes = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.col("recipe")
    if not clashes.isEmpty():  # an identifier stands for two contents: tell texts apart by their SHA-256 as well
        key = F.concat("recipe", F.encode("text_sha256", "UTF-8"))
    n_chunks = (F.octet_length("proof") / (PROOF_BYTES + 4)).cast("int")
    rows = recipes.select(F.md5(key).alias("key"), "text_sha256", "doc_id", n_chunks.alias("n_chunks")).groupBy("key", "text_sha256", "n_chunks", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return (
        rekeyed(rows, "key").join(rekeyed(groups, "key"), "key")
        .select("doc_id", "keep_id", "group_size", "text_sha256", "n_chunks", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256", "n_chunks")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row of ``docs`` for each distinct text, all its columns."""
    rows = exact_duplicates(docs, id_col, text_col)
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kept")).alias("stay"))
    gone, mark = unused(docs, "going"), unused(docs, "__key")
    going = cut(per.where("doc_id is null or n > 1 or stay = 0").select(F.col("doc_id").alias(gone), (F.col("n") > 1).alias("mixed")))
    own = F.col(id_col).cast("long")
    n, mixed = going.agg(F.count(F.lit(1)), F.count_if(F.col("mixed") | F.col(gone).isNull())).first()
    names = going.select(gone)
    out = docs.where(own.isNotNull()).join(F.broadcast(names) if n <= broadcast_ids else names, own == F.col(gone), "left_anti")
    if not mixed:
        return out
    again = docs.where(own.isNull()).unionByName(docs.join(going.where("mixed").select(gone), own == F.col(gone), "left_semi"))
    # rows without an id of their own are told apart by their text too
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    key = F.concat(F.coalesce(own.cast("string"), F.lit("")), F.lit(":"), sha)
    kept = rows.where("kept").select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text_sha256").alias(mark))
    return out.unionByName(again.withColumn(mark, key).join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
