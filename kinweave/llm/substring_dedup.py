"""Substring dedup: words covered by a window of ``window`` words that starts anywhere else are removed.

Documents stream through suffix automata of reference shards for matching statistics, and maximal spans of at least
``window`` matching words go. Here the reference is the corpus itself, whose automata no executor could hold and
which each document would have to pass in full. So a shard is made for each unit of documents (a few MB): it holds the
passages that other units share with it, and reaches its unit by a shuffle instead of a broadcast.

Plan: a unit sends, for each bucket, one row with its distinct window hashes, so a window that a third of the corpus
shares costs one entry a unit. A bucket asks, for each hash of two units and more, the next unit in the ring of its
holders to serve the one before; so no unit serves more than one for any window. A served unit receives the runs
of windows asked for as text, builds the automaton of these, and streams its documents through it. Windows that repeat inside a
unit have an automaton of their own, of the unit's runs of windows whose hashes repeat, with counts of occurrences. Both automata read
the words themselves: hashes only choose what is sent and streamed, words decide. All three passes over the texts use one
exchange.

Bounds: a unit is ``unit_bytes`` of text on average, whatever the size of the corpus, and at least one document; automata take
345 bytes or so for each word of the passages sent to a unit and of the runs that repeat inside it. Rows of hashes number units times
buckets at most, and never more than windows.

Edge cases: null text: no words. Null doc_id: such rows are handled as any other, and spread over the units by a row number. Repeated
rows: copies, so all of their windows repeat. A repeated doc_id with other texts: spread by text. Texts shorter than a
window stay whole. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Words, pieces, span_hashes, text_buffers
from kinweave.llm.suffix_automaton import Automaton, covered

WINDOW = 35
UNIT_BYTES = 4 << 20

_A = np.uint64(0x8CB92BA72F3D8DD7)
_B = np.uint64(0xAEF17502108EF2D9)


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indexes where a window of one text starts, and two hashes of each."""
    first = words.first
    n = np.diff(first)
    begins = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(first[:-1], first[1:]) if b - a >= window] or [np.zeros(0, np.int64)])
    if not len(begins):
        z = np.zeros(0, np.uint64)
        return begins, z, z
    h = words.hashes()
    return begins, span_hashes(h, begins, begins + window, _A), span_hashes(h, begins, begins + window, _B)


def _send(window: int, units: int):
    schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int32()), ("hashes", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        unit = t.column("unit")[0].as_py()
        raw, offs = text_buffers(t.column("text"))
        keys, buckets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for i, j in pieces(offs):
            _, a, b = _windows(Words(raw, offs[i : j + 1]), window)
            keys.append(a)
            buckets.append((b % np.uint64(units)).astype(np.int32))
        key, bucket = np.concatenate(keys), np.concatenate(buckets)
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        if len(key):
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            key, bucket = key[fresh], bucket[fresh]
        names, at = np.unique(bucket, return_index=True)
        ends = np.append(at[1:], len(key))
        return pa.table({"bucket": names, "unit": np.full(len(names), unit, np.int32), "hashes": [key[a:b].tobytes() for a, b in zip(at, ends)]}, schema=schema)

    return run


def _ask(t: pa.Table) -> pa.Table:
    """For each hash of several units, the next of its units in the ring is asked to serve each: a row for each unit asked."""
    parts = [np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()]
    key = np.concatenate(parts)
    unit = np.repeat(t.column("unit").to_numpy(), [len(p) for p in parts])
    order = np.lexsort((unit, key))
    key, unit = key[order], unit[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    holder = np.append(unit[1:], 0)[: len(unit)].astype(np.int32)
    holder[heads + size - 1] = unit[heads]
    several = np.repeat(size > 1, size)
    key, unit, holder = key[several], unit[several], holder[several]
    order = np.lexsort((unit, holder))
    key, unit, holder = key[order], unit[order], holder[order]
    names, at = np.unique(holder, return_index=True)
    ends = np.append(at[1:], len(key))
    return pa.table({"unit": names.astype(np.int32), "askers": [unit[a:b].astype(np.int32).tobytes() for a, b in zip(at, ends)], "hashes": [key[a:b].tobytes() for a, b in zip(at, ends)]}, schema=pa.schema([("unit", pa.int32()), ("askers", pa.binary()), ("hashes", pa.binary())]))


def _serve(window: int):
    schema = pa.schema([("unit", pa.int32()), ("passages", pa.list_(pa.binary()))])

    def run(docs: pa.Table, requests: pa.Table) -> pa.Table:
        wanted = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in requests.column("hashes").to_pylist())])
        askers = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(b, np.int32) for b in requests.column("askers").to_pylist())])
        order = np.argsort(wanted)
        wanted, askers = wanted[order], askers[order]
        open_ = np.ones(len(wanted), dtype=bool)
        out: dict[int, list[bytes]] = {}
        raw, offs = text_buffers(docs.column("text")) if docs.num_rows and len(wanted) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        for i, j in pieces(offs):
            words = Words(raw, offs[i : j + 1])
            begins, key, _ = _windows(words, window)
            if not len(begins):
                continue
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = np.flatnonzero((wanted[at] == key) & open_[at])
            _, once = np.unique(at[hit], return_index=True)  # each window is served once
            hit = hit[np.sort(once)]
            if not len(hit):
                continue
            open_[at[hit]] = False
            begin, to = begins[hit], askers[at[hit]]
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(begin) != 1) | (to[1:] != to[:-1])]))
            last = np.append(heads[1:], len(begin)) - 1
            view = memoryview(words.bytes)
            for unit, p, q in zip(to[heads].tolist(), words.start[begin[heads]].tolist(), words.end[begin[last] + window - 1].tolist()):
                out.setdefault(unit, []).append(bytes(view[p:q]))
        return pa.table({"unit": list(out), "passages": list(out.values())}, schema=schema)

    return run


def _repeats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the windows, named by two hashes, occur twice here."""
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    if (b[order[1:]][same] != b[order[:-1]][same]).any():  # the first hash stands for two windows: order by both
        order = np.lexsort((b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    twice = np.zeros(len(a), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _spelt(words: Words, p: int, q: int) -> list[bytes]:
    """Words p to q as they stand."""
    base = int(words.start[p])
    data = words.bytes[base : int(words.end[q - 1])].tobytes()
    return [data[a:b] for a, b in zip((words.start[p:q] - base).tolist(), (words.end[p:q] - base).tolist())]


def _runs(begins: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of words of the runs of neighbouring windows."""
    if not len(begins):
        return []
    cuts = np.flatnonzero(np.diff(begins) != 1)
    return list(zip(begins[np.append(0, cuts + 1)].tolist(), (begins[np.append(cuts, len(begins) - 1)] + window).tolist()))


def _shard(passages: pa.ChunkedArray, window: int) -> tuple[Automaton, np.ndarray] | None:
    """The automaton of the passages and the sorted hashes of their windows."""
    rows = [p for cell in passages.to_pylist() for p in cell]
    if not rows:
        return None
    automaton, keys = Automaton(), []
    raw, offs = text_buffers(pa.array(rows, pa.binary()))
    for i, j in pieces(offs):
        words = Words(raw, offs[i : j + 1])
        for p, q in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            automaton.add(_spelt(words, p, q))
        keys.append(_windows(words, window)[1])
    return automaton, np.unique(np.concatenate(keys))


def _within(raw: np.ndarray, offs: np.ndarray, parts: list, twice: np.ndarray, window: int) -> Automaton | None:
    """The automaton of the unit's runs of windows whose hashes repeat in it."""
    if not twice.any():
        return None
    automaton, done = Automaton(), 0
    for (i, j), (begins, _, _) in zip(pieces(offs), parts):
        words = Words(raw, offs[i : j + 1])
        for p, q in _runs(begins[twice[done : done + len(begins)]], window):
            automaton.add(_spelt(words, p, q))
        done += len(begins)
    automaton.count_occurrences(window)
    return automaton


def _remove(window: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def run(docs: pa.Table, shard: pa.Table) -> pa.Table:
        shard_of = _shard(shard.column("passages"), window)
        raw, offs = text_buffers(docs.column("text")) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        parts = [_windows(Words(raw, offs[i : j + 1]), window) for i, j in pieces(offs)]
        none = [np.zeros(0, np.uint64)]
        twice = _repeats(np.concatenate(none + [p[1] for p in parts]), np.concatenate(none + [p[2] for p in parts]))
        within = _within(raw, offs, parts, twice, window)
        done = 0
        total, removed, shas, spans, texts = [], [], [], [], []
        for (i, j), (begins, key, _) in zip(pieces(offs), parts):
            words = Words(raw, offs[i : j + 1])
            first, count = words.first, len(words.start)
            kept = np.ones(count, dtype=bool)
            for p, q in _runs(begins[twice[done : done + len(begins)]], window):
                again = [window * r for r in within.repeated(_spelt(words, p, q), window)]
                kept[p:q] &= ~covered([again], window)
            done += len(begins)
            if shard_of is not None and len(begins):
                # a match of a window's length is made of windows of the shard: only their runs need streaming
                automaton, known = shard_of
                hits = begins[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key]
                for p, q in _runs(hits, window):
                    if kept[p:q].any():
                        kept[p:q] &= ~covered([automaton.statistics(_spelt(words, p, q))], window)
            kept_sum = np.concatenate([[0], np.cumsum(kept)])
            n = np.diff(first)
            k = kept_sum[first[1:]] - kept_sum[first[:-1]]
            total.append(n)
            removed.append(n - k)
            opens = np.concatenate([[True], kept[:-1]])[:count]
            opens[first[:-1][n > 0]] = True
            span_sum = np.concatenate([[0], np.cumsum(opens & ~kept)])
            spans.append(span_sum[first[1:]] - span_sum[first[:-1]])
            # the kept words, each but the last of a text followed by one space
            ids = np.flatnonzero(kept)
            text_of = np.searchsorted(first, ids, side="right") - 1
            last = np.append(text_of[1:] != text_of[:-1], True) if len(ids) else np.zeros(0, bool)
            take = np.zeros(len(words.bytes) + 1, dtype=np.int8)
            take[words.start[ids]] += 1
            take[words.end[ids]] -= 1
            take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
            gaps = words.end[ids[~last]]
            data = words.bytes.copy()
            data[gaps] = 32
            take[gaps] = True
            at = np.concatenate([[0], np.cumsum(take)])[offs[i : j + 1] - offs[i]]
            out = memoryview(data[take])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                shas.append(hashlib.sha256(out[a:b]).hexdigest())
                if with_text:
                    texts.append(str(out[a:b], "utf-8"))
        zero = [np.zeros(0, np.int64)]
        columns = {"doc_id": docs.column("doc_id"), "n_words": np.concatenate(zero + total), "n_removed": np.concatenate(zero + removed), "kept_sha256": shas, "n_spans": np.concatenate(zero + spans)}
        return pa.table(columns | ({"kept_text": texts} if with_text else {}), schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit_bytes: int = UNIT_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, n_spans and, if asked, kept_text."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(-(-size // unit_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = base.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(units)).cast("int"))
    sent = base.groupBy("unit").applyInArrow(_send(window, units), "bucket int, unit int, hashes binary")
    asked = sent.groupBy("bucket").applyInArrow(_ask, "unit int, askers binary, hashes binary")
    shards = base.groupBy("unit").cogroup(asked.groupBy("unit")).applyInArrow(_serve(window), "unit int, passages array<binary>")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text
    return base.groupBy("unit").cogroup(shards.groupBy("unit")).applyInArrow(_remove(window, with_text), out)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) t(i)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM win JOIN twice USING (h)),
words AS (SELECT r, j AS k, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) t(j)),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.k) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.k = gone.k GROUP BY words.r),
spans AS (SELECT gone.r, count(*) AS n FROM gone ANTI JOIN gone g ON g.r = gone.r AND g.k = gone.k - 1 GROUP BY gone.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(spans.n, 0) AS n_spans
FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN spans ON spans.r = d.r
"""
