"""Matching statistics of documents against broadcast suffix automata of bounded reference shards.

The reference is cut into shards of at most ``shard_words`` words; each becomes one suffix automaton over word hashes,
packed into flat arrays, and is broadcast. A document streams once through each shard: at every word the length of the
longest match that ends there. Words of maximal spans of at least ``window`` words are removed. Work is documents times
shards and memory is the automata's, so the reference must be bounded: its words are counted first, and above
``max_words`` the operator refuses (corpora against themselves go through ``substring_dedup``).

Edge cases: null texts: no words. Null ids pass through. Repeated rows: each handled. Empty tables: no rows, or nothing
removed. Matches never cross reference texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Words, batch, pieces, text_buffers

WINDOW = 35
SHARD_WORDS = 200_000
MAX_WORDS = 4_000_000


class Automaton:
    """Suffix automaton of several sequences of words, as hashes or as bytes; each state has a dict of transitions.

    ``ends`` counts at how many places the sequences read so far end in a state, before ``count_occurrences`` sums them.
    """

    def __init__(self):
        self.length, self.link, self.next, self.ends = [0], [-1], [{}], [0]

    def add(self, words: list) -> None:
        last, ends = 0, self.ends
        for w in words:
            last = self._extend(last, w)
            ends[last] += 1

    def count_occurrences(self, window: int) -> None:
        """Let ``ends`` be the number of places of a state's words, and ``at`` the state of their last ``window`` words."""
        length, link, ends = self.length, self.link, self.ends
        order = sorted(range(1, len(length)), key=length.__getitem__, reverse=True)
        for s in order:
            ends[link[s]] += ends[s]
        self.at = list(range(len(length)))
        for s in reversed(order):
            if length[link[s]] >= window:
                self.at[s] = self.at[link[s]]

    def repeated(self, words: list, window: int) -> list[bool]:
        """For each position of a sequence that was added, whether its last ``window`` words stand at two places or more."""
        step, ends, at = self.next, self.ends, self.at
        state, out = 0, []
        for n, w in enumerate(words, 1):
            state = step[state][w]
            out.append(n >= window and ends[at[state]] > 1)
        return out

    def _extend(self, last: int, w) -> int:
        length, link, step = self.length, self.link, self.next
        if w in step[last]:  # the generalised automaton: the state may exist from an earlier sequence
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        self.ends.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w, q: int) -> int:
        length, link, step = self.length, self.link, self.next
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        self.ends.append(0)
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list) -> list[int]:
        """For each position the length of the longest match that ends there."""
        length, link, step = self.length, self.link, self.next
        state, n, out = 0, 0, []
        for w in words:
            while w not in step[state]:
                state = link[state]
                if state < 0:
                    state, n = 0, 0
                    break
                n = length[state]
            else:
                state = step[state][w]
                n += 1
            out.append(n)
        return out


def covered(lengths: list[list[int]], window: int) -> np.ndarray:
    """Which words lie in a match of at least ``window`` words, over the statistics of all shards."""
    best = np.max(np.array(lengths, dtype=np.int64), axis=0) if lengths and lengths[0] else np.zeros(0, np.int64)
    change = np.zeros(len(best) + 1, dtype=np.int64)
    ends = np.flatnonzero(best >= window)
    np.add.at(change, ends - best[ends] + 1, 1)
    np.add.at(change, ends + 1, -1)
    return np.cumsum(change)[: len(best)] > 0


def _remove(shards, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
    known: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known:
            for shard in shards:
                one = Automaton()
                for words in shard.value:
                    one.add(words.tolist())
                known.append(one)
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            for i, j in pieces(offs):
                words = Words(raw, offs[i : j + 1])
                h = words.hashes().tolist()
                total, gone, kept = [], [], []
                for p, q in zip(words.first[:-1], words.first[1:]):
                    drop = covered([a.statistics(h[p:q]) for a in known], window) if q - p >= window else np.zeros(q - p, bool)
                    kept.append(" ".join(str(memoryview(words.bytes[words.start[k] : words.end[k]]), "utf-8") for k in range(p, q) if not (len(drop) and drop[k - p])))
                    total.append(int(q - p))
                    gone.append(int(drop.sum()))
                yield batch(schema, doc_id=b.column(0).slice(i, j - i), n_words=total, n_removed=gone, kept_text=kept, kept_sha256=[hashlib.sha256(k.encode()).hexdigest() for k in kept])

    return run


def remove_reference(
    docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, max_words: int = MAX_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: the words of ``docs`` outside spans that the reference holds."""
    spark = docs.sparkSession
    texts = reference.select(F.col(reference_col).cast("string").alias("t")).where("t is not null").distinct()
    size = texts.agg(F.sum(F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > max_words:
        raise ValueError(f"the reference has {size} words; {max_words} may be broadcast")
    shards, open_, n = [], [], 0
    for row in texts.toLocalIterator():  # at most max_words
        raw, offs = text_buffers(pa.array([row["t"]]))
        h = Words(raw, offs).hashes()
        for k in range(0, max(len(h) - window + 1, 0), shard_words):  # a long text is cut with the overlap of a window
            part = h[k : k + shard_words + window - 1]
            if open_ and n + len(part) > shard_words:
                shards.append(spark.sparkContext.broadcast(open_))
                open_, n = [], 0
            open_.append(part)
            n += len(part)
    if open_:
        shards.append(spark.sparkContext.broadcast(open_))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_remove(shards, window), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
