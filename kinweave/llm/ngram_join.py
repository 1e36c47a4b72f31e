"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. A text of fewer than ``n`` words has one shingle, all its
words (an empty or null text: the empty shingle), so that short texts are near each other only if equal.

Plan: texts are read once for signatures; rows with equal word sequences are *copies* (smallest doc_id stands for them);
representatives are shuffled on their band hashes. The smallest representative of a bucket is its *anchor*: each member
is compared with what shares an anchor with it, and nothing is chained before that. Since a pair that shares a bucket shares its anchor, no pair is
lost; a pair with several common anchors is verified at the smallest. The texts of such candidates alone move, once for each of their
anchors (``bands`` at most), and are verified on full n-gram sets. The members of a hot anchor are dealt out over pairs of
blocks, each its own task group: a text then moves once for each block of that one anchor. A task group
returns one row per document with its number of links and one link to its class, never the list of pairs. Candidates'
ids are broadcast to the texts only if they are few (``BROADCAST_IDS``, counted first).

Recall: a pair of similarity s shares a band with chance 1 - (1 - s^rows)^bands; (38, 6) misses one in 100,000 pairs at 0.8 and
compares 3 % of the pairs at 0.3, 45 % at 0.5.

Edge cases: null doc_id: the row comes back with null class and no links. Repeated rows: each
comes back; they are copies of each other (doc_id must otherwise be unique). Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Words, batch, mix, pieces, release, span_hashes, text_buffers, unused
from kinweave.operators.components import connected_components, cut, files_for, rekeyed

NGRAM = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold shares no band.
MISS = 1e-5
MAX_HASHES = 256
#: Documents of one block in verification; a task group holds two blocks.
BLOCK = 128
#: Candidates' ids that may be broadcast to their texts: 16 MB or so.
BROADCAST_IDS = 500_000

_SEQ = np.uint64(0xC2B2AE3D27D4EB4F)
_SEQ2 = np.uint64(0x165667B19E3779F9)


def choose_bands(threshold: float = THRESHOLD, miss: float = MISS, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows per band, so the fewest false candidates, that misses at most ``miss``."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(miss) / math.log1p(-p))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding reaches the target recall")


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """For each text its shingle hashes, with repeats."""
    h = words.hashes()
    grams = words.ngrams(h, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            out.append(grams[a : b - n + 1])
        else:
            out.append(span_hashes(h[a:b], np.array([0]), np.array([b - a]), _SEQ))
    return out


def _signatures(n: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("seq1", pa.int64()), ("seq2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    rng = np.random.default_rng(20240501)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
    fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            for i, j in pieces(offs):
                words = Words(raw, offs[i : j + 1])
                h = words.hashes()
                first = words.first
                seq = [span_hashes(h, first[:-1], first[1:], q).view(np.int64) for q in (_SEQ, _SEQ2)]
                sets = shingles(words, n)
                flat = np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                sig = np.empty((len(sets), bands, rows), dtype=np.uint64)
                for k in range(bands * rows):
                    sig[:, k // rows, k % rows] = np.minimum.reduceat(flat * odd[k], at)
                keys = mix((mix(sig) * fold).sum(axis=2, dtype=np.uint64) + salt)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                yield batch(schema, doc_id=b.column(0).slice(i, j - i), seq1=seq[0], seq2=seq[1], bands=lists)

    return run


def _verify(n: int, threshold: float):
    """Verify the texts of one pair of blocks of an anchor; per document its linked weight, and a link to its group."""
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep = t.column("rep").to_numpy()
        _, order = np.unique(rep, return_index=True)  # a repeated row counts once
        t, rep = t.take(pa.array(order)), rep[order]
        size, block = t.column("size").to_numpy(), t.column("block").to_numpy()
        same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        anchor = t.column("anchor")[0].as_py()
        lists = t.column("anchors").combine_chunks()
        less = np.asarray(lists.flatten())
        whose = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
        before = less < anchor
        names, less = np.unique(less[before], return_inverse=True)
        common = np.zeros((len(rep), len(names)), dtype=np.float32)  # smaller anchors: their pairs are verified there
        common[whose[before], less] = 1
        raw, offs = text_buffers(t.column("text"))
        sets = []
        for i, j in pieces(offs):
            sets += [np.unique(s) for s in shingles(Words(raw, offs[i : j + 1]), n)]
        m = len(sets)
        count = np.array([len(s) for s in sets], dtype=np.float64)
        inter = np.zeros((m, m))
        if m <= 8:
            for i in range(m):
                for j in range(i):
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:  # products of incidence matrices, a few thousand shared shingles at a time
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(m), count.astype(np.int64))
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            code = np.cumsum(new) - 1
            shared = np.bincount(code) > 1
            keep = shared[code]
            code = (np.cumsum(shared) - 1)[code[keep]]
            owner = owner[keep]
            cuts = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + 4096, 4096))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    has = np.zeros((m, 4096), dtype=np.float32)
                    has[owner[a:b], code[a:b] - k * 4096] = 1
                    inter += has @ has.T
        union = count[:, None] + count[None, :] - inter
        link = inter >= threshold * union - 1e-9
        np.fill_diagonal(link, False)
        if len(names):
            link &= common @ common.T == 0
        if not same:
            link &= block[:, None] != block[None, :]
        root = np.arange(m)
        for i in range(m):  # union by smallest index; rep is sorted
            for j in np.flatnonzero(link[i, :i]):
                a, b = i, int(j)
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
        for i in range(m):
            root[i] = root[root[i]]
        linked = link @ size
        some = linked > 0
        return pa.table({"rep": rep[some], "linked": linked[some].astype(np.int64), "root": rep[root[some]]}, schema=schema)

    return run


def _links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD,
    miss: float = MISS, max_hashes: int = MAX_HASHES, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(signatures, word sequences with their smallest doc_id and rows, verified links by document, files a small table is worth)."""
    bands, rows = choose_bands(threshold, miss, max_hashes)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = cut(base.mapInArrow(_signatures(n, bands, rows), "doc_id long, seq1 long, seq2 long, bands array<long>"))
    classes = (
        sigs.where("doc_id is not null").groupBy("seq1", "seq2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    )
    reps = rekeyed(classes, "seq1", "seq2").join(sigs.withColumnRenamed("doc_id", "rep"), ["seq1", "seq2", "rep"]).dropDuplicates(["rep"]).select("rep", "size", "bands")
    files = files_for(sigs.count())
    reps = cut(reps, files)
    keys = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.min("rep").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = cut(keys.join(rekeyed(buckets, "band", "key"), ["band", "key"]).select("rep", "anchor").distinct(), files)
    anchors = stars.groupBy("rep").agg(F.collect_list("anchor").alias("anchors"))  # as many as there are bands at most
    blocks = stars.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = cut(anchors.join(reps.select("rep", "size"), "rep"), files)
    ids = members.select("rep")
    texts = base.where("doc_id is not null").withColumnRenamed("doc_id", "rep").join(F.broadcast(ids) if members.count() <= BROADCAST_IDS else ids, "rep", "left_semi")
    placed = stars.join(rekeyed(blocks, "anchor"), "anchor").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = (
        placed.join(members, "rep").join(texts, "rep")
        .select("rep", "anchor", "anchors", "size", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("rep", "anchor", "anchors", "size", "block", "text", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    found = cut(
        dealt.groupBy("anchor", "bi", "bj").applyInArrow(_verify(n, threshold), "rep long, linked long, root long").repartition(files)
    )
    return sigs, classes, found, files


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of all that links join), n_links (other rows whose
    similarity is at least ``threshold``, copies included), copy_of (smallest doc_id of the same word sequence)
    and n_copies (rows of that sequence). Options: n, threshold, miss, max_hashes, block."""
    sigs, classes, found, files = _links(docs, id_col, text_col, **options)
    groups = connected_components(found, "rep", "root", files=files).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    per_class = (
        classes.join(linked, "rep", "left").join(groups, "rep", "left")
        .select("seq1", "seq2", F.col("rep").alias("copy_of"), F.coalesce("group", "rep").alias("class_id"), F.col("size").alias("n_copies"),
                (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    named = sigs.where("doc_id is not null").select("doc_id", "seq1", "seq2").join(per_class, ["seq1", "seq2"]).select("doc_id", "class_id", "n_links", "copy_of", "n_copies")
    none, nought = F.lit(None).cast("long"), F.lit(0).cast("long")
    unnamed = sigs.where("doc_id is null").select("doc_id", none.alias("class_id"), nought.alias("n_links"), none.alias("copy_of"), nought.alias("n_copies"))
    return named.unionAll(unnamed)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, and those without doc_id; all their columns."""
    sigs, classes, found, files = _links(docs, id_col, text_col, **options)
    gone = unused(docs, "gone")
    release(docs.sparkSession)
    linked = connected_components(found, "rep", "root", files=files).where("node <> component").select(F.col("node").alias(gone))
    copies = sigs.join(rekeyed(classes.where("size > 1"), "seq1", "seq2"), ["seq1", "seq2"]).where("doc_id <> rep").select(F.col("doc_id").alias(gone))
    return docs.join(linked.unionAll(copies), F.col(id_col).cast("long") == F.col(gone), "left_anti")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9),
cc(k, lab) USING KEY (k) AS (SELECT doc_id, doc_id FROM d UNION (SELECT p.a, min(cc.lab) FROM cc JOIN p ON p.b = cc.k JOIN recurring.cc AS u ON u.k = p.a WHERE cc.lab < u.lab GROUP BY p.a)),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS copy_of, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS n_copies FROM d)
SELECT c.doc_id, cc.lab AS class_id, coalesce(l.n, 0) AS n_links, copy_of, n_copies
FROM c JOIN cc ON cc.k = c.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = c.doc_id
"""
