"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded by what it holds: its words and its byte trigrams are hashed
to ``WORD_BUCKETS`` and ``GRAM_BUCKETS``, whose learned vectors are averaged, beside a few shape features (shares of character
classes, repetition, word lengths, distinct words), into a tanh layer. Gated attention, tanh(V h) * sigmoid(U h), weighs the
passages; a logistic unit scores the weighted representation. All weights, the buckets' vectors too, are learned from document
labels alone: of every labelled document outside the held-out fold, whole texts. These are dealt by a hash into shards of about
``SHARD_BYTES`` of text, encoded once; in each of ``ROUNDS`` rounds every shard trains the common weights for some epochs and the
results are averaged by documents, in whole numbers, so that the model does not depend on the order of tasks. A single shard trains
all epochs in one round. Every passage of every document is scored, in Arrow batches.

Edge cases: null and empty texts are one empty passage. Without labelled rows of both classes each score is the
smoothed share of label 1. Labels that are null, or of unknown documents, are not used; of repeated labels of a
document the largest counts. Null doc_id: scored, held_out null. Repeated rows: each scored. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Words, batch, one_thread, pieces, text_buffers
from kinweave.operators.components import cut, scratch

PASSAGE_WORDS = 64
#: Text of one shard of the labelled documents; a task trains on one shard at a time.
SHARD_BYTES = 4 << 20
ROUNDS = 6
#: Labelled documents whose ids and labels may be broadcast to the texts: 16 MB or so.
BROADCAST_LABELS = 500_000
#: Documents of one step of the optimiser, if there is a single shard and if the results of several are averaged.
BATCH, SHARED_BATCH = 256, 64
#: Sums over shards are whole numbers of these parts, of features and of weights.
FEATURE_PART, WEIGHT_PART = 2.0**-22, 2.0**-50
#: Bytes of text encoded at once; bounds the temporary arrays of a task.
PIECE_BYTES = 1 << 18
THRESHOLD = 0.7
HIDDEN = 16
ATTENTION = 8
EPOCHS = 30
WORD_BUCKETS = 256
GRAM_BUCKETS = 256
#: What a bucket's standardised share counts beside a shape feature's.
SPREAD = 0.1
DECAY = 1e-4

_UPPER, _LOWER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])
_SIGNS = np.zeros(256, bool)
_SIGNS[33:48] = _SIGNS[58:65] = _SIGNS[91:97] = _SIGNS[123:127] = True
_SIGNS &= ~_STOPS
_CLASSES = (_UPPER, _LOWER, _DIGIT, _HIGH, _STOPS, _SIGNS)
SHAPE = len(_CLASSES) + 8
WIDTH = SHAPE + WORD_BUCKETS + GRAM_BUCKETS


def encode(words: Words, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features of passages, text of each passage); a text without words is one passage of zeros."""
    x, text, full, begin, end = shape(words, size)
    if len(full):
        x[full, SHAPE : SHAPE + WORD_BUCKETS], x[full, SHAPE + WORD_BUCKETS :] = buckets(words, begin, end)
    return x, text


def buckets(words: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the hashed words and byte trigrams of passages, words begin:end of each, as square roots."""
    n = len(begin)
    where, place = _spread(begin, end)
    word = (words.hashes()[where] >> np.uint64(40)).astype(np.int32) % WORD_BUCKETS
    counts = np.bincount(place * WORD_BUCKETS + word, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS).astype(np.float32)
    data = words.bytes.astype(np.uint32)
    key = np.zeros(len(data), dtype=np.uint32)
    key[:-2] = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    key = ((key * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) % GRAM_BUCKETS
    low, high = words.start[begin], words.end[end - 1]
    at, spot = _spread(low, high)
    grams = np.bincount(spot * GRAM_BUCKETS + key[at], minlength=n * GRAM_BUCKETS).reshape(n, GRAM_BUCKETS).astype(np.float32)
    return np.sqrt(counts / (end - begin)[:, None]), np.sqrt(grams / (high - low)[:, None])


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges begin:end, and the range of each."""
    size = (end - begin).astype(np.int32)
    place = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return np.arange(len(place), dtype=np.int32) + np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size), place


def shape(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of passages, the first of them filled, text of each passage, passages with words and these words' range)."""
    first = words.first
    n = np.diff(first)
    per = np.maximum(-(-n // size), 1)
    text = np.repeat(np.arange(len(n)), per)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][text] + inside * size
    end = np.minimum(begin + size, first[1:][text])
    count = end - begin
    x = np.zeros((len(text), WIDTH), dtype=np.float32)
    full = np.flatnonzero(count > 0)
    if not len(full):
        return x, text, full, begin[full], end[full]
    begin, end, count = begin[full], end[full], count[full].astype(np.float32)
    f = np.zeros((len(full), SHAPE), dtype=np.float32)
    low, high = words.start[begin], words.end[end - 1]
    span = (high - low).astype(np.float32)
    for k, kind in enumerate(_CLASSES):
        sums = np.zeros(len(words.bytes) + 1, dtype=np.int32)
        np.cumsum(kind[words.bytes], out=sums[1:])
        f[:, k] = (sums[high] - sums[low]) / span
    h = words.hashes()
    length = (words.end - words.start).astype(np.float64)
    again = np.zeros(len(h), dtype=np.float64)
    again[1:] = h[1:] == h[:-1]
    head, tail = words.bytes[words.start], words.bytes[words.end - 1]
    total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[np.stack([begin, end])], axis=0)[0]
    again[begin] = 0
    place = np.repeat(np.arange(len(full)), count.astype(np.int64))
    where = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count.astype(np.int64)).astype(np.int64) + np.repeat(begin, count.astype(np.int64))
    key = np.lexsort((h[where], place))
    fresh = np.ones(len(key), dtype=np.float64)
    fresh[1:] = (h[where][key][1:] != h[where][key][:-1]) | (place[key][1:] != place[key][:-1])
    distinct = np.add.reduceat(fresh, np.cumsum(count).astype(np.int64) - count.astype(np.int64))
    mean = total(length) / count
    k = len(_CLASSES)
    f[:, k] = total(again) / count
    f[:, k + 1] = distinct / count
    f[:, k + 2] = np.log1p(mean)
    f[:, k + 3] = np.log1p(np.maximum(total(length**2) / count - mean**2, 0))
    f[:, k + 4] = total(_UPPER[head]) / count
    f[:, k + 5] = total(_STOPS[tail]) / count
    f[:, k + 6] = total(_SIGNS[tail]) / count
    f[:, k + 7] = np.log1p(count) / np.log1p(size)
    x[full, :SHAPE] = f
    return x, text, full, begin, end


class Model:
    """Gated-attention network over bags; plain numpy, so that it travels inside a task's closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray], prior: float):
        self.mean, self.scale, self.w, self.prior = mean, scale, weights, prior

    def forward(self, x: np.ndarray, at: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z[:, SHAPE:] *= SPREAD
        h = np.tanh(z @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        p = np.exp(e - np.maximum.reduceat(e, at)[bag])
        p /= np.add.reduceat(p, at)[bag]
        m = np.add.reduceat(p[:, None] * h, at, axis=0)
        s = 1 / (1 + np.exp(-np.clip(m @ w["o"] + w["c"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "p": p, "m": m, "s": s}

    def score(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        if not self.w:
            return np.full(len(at), self.prior)
        return self.forward(x, at, text - text[0])["s"].astype(np.float64)


SHAPES = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "c": (1,)}


class State:
    """Weights, Adam's two moments and the number of steps, as one vector and back."""

    def __init__(self, w: dict[str, np.ndarray], m1: dict[str, np.ndarray], m2: dict[str, np.ndarray], step: float):
        self.w, self.m1, self.m2, self.step = w, m1, m2, step

    @classmethod
    def first(cls, seed: int) -> State:
        rng = np.random.default_rng(seed)
        w = {k: np.zeros(s, np.float32) if k in "bc" else rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in SHAPES.items()}
        return cls(w, *({k: np.zeros(s, np.float32) for k, s in SHAPES.items()} for _ in range(2)), 0.0)

    def vector(self) -> np.ndarray:
        return np.concatenate([*(part[k].ravel() for part in (self.w, self.m1, self.m2) for k in SHAPES), [self.step]]).astype(np.float64)

    @classmethod
    def of(cls, v: np.ndarray) -> State:
        parts, at = [], 0
        for _ in range(3):
            parts.append({})
            for k, s in SHAPES.items():
                n = int(np.prod(s))
                parts[-1][k] = v[at : at + n].reshape(s).astype(np.float32)
                at += n
        parts[2] = {k: np.maximum(m, 0) for k, m in parts[2].items()}
        return cls(*parts, float(v[-1]))


def descend(state: State, mean: np.ndarray, scale: np.ndarray, x: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: range, size: int, rng: np.random.Generator) -> State:
    """Train ``state`` for ``epochs``, of EPOCHS in all. bag: for each passage its document's place in label, ascending."""
    w, m1, m2, step = state.w, state.m1, state.m2, state.step
    model = Model(mean, scale, w, 0.0)
    first = np.searchsorted(bag, np.arange(len(label) + 1))
    for epoch in epochs:
        order = rng.permutation(len(label))
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for k in range(0, len(order), size):
            ids = order[k : k + size]
            n = first[ids + 1] - first[ids]
            at = np.cumsum(n) - n
            local = np.repeat(np.arange(len(ids)), n)
            rows = np.arange(len(local)) - at[local] + first[ids][local]
            f = model.forward(x[rows], at, local)
            ds = (f["s"] - label[ids]) / len(ids)
            dm = ds[:, None] * w["o"][None, :]
            dh = f["p"][:, None] * dm[local]
            dp = (f["h"] * dm[local]).sum(axis=1)
            de = f["p"] * (dp - np.add.reduceat(f["p"] * dp, at)[local])
            tg = f["t"] * f["g"]
            dtg = de[:, None] * w["a"][None, :]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (dh + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
            grads = {"W": f["z"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": tg.T @ de, "o": f["m"].T @ ds, "c": np.array([ds.sum()])}
            step += 1
            for name, g in grads.items():
                g = (g + DECAY * w[name]).astype(np.float32)
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                w[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return State(w, m1, m2, step)


def held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _pack(found: pa.Table) -> pa.Table:
    """One row of a shard: its documents and passages, the sums and sums of squares of its features, and the features."""
    order = np.lexsort((np.array([zlib.crc32((t or "").encode()) for t in found.column("t").to_pylist()], dtype=np.int64), found.column("k").to_numpy()))
    found = found.take(pa.array(order))
    raw, offs = text_buffers(found.column("t"))
    parts = [(i, *encode(Words(raw, offs[i : j + 1]))) for i, j in pieces(offs, PIECE_BYTES)]
    bag = np.concatenate([text + i for i, _, text in parts])
    x = np.concatenate([p[1] for p in parts])
    sums = np.concatenate([sum(p[1].sum(axis=0, dtype=np.float64) for p in parts), sum(np.einsum("ij,ij->j", p[1], p[1], dtype=np.float64) for p in parts)])
    del parts
    return pa.table({
        "shard": found.column("shard").slice(0, 1), "docs": [found.num_rows], "passages": [len(x)], "sums": [np.rint(sums / FEATURE_PART).astype(np.int64).tobytes()],
        "x": [pa.compress(x, codec="zstd", asbytes=True)], "bag": [bag.astype(np.int32).tobytes()], "y": [found.column("y").to_numpy().astype(np.int8).tobytes()],
    }, schema=_PACKED)


_PACKED = pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("passages", pa.int64()), ("sums", pa.binary()), ("x", pa.binary()), ("bag", pa.binary()), ("y", pa.binary())])


def _sum(parts: DataFrame) -> np.ndarray:
    """Sum of the vectors of int64 in (shard long, sums binary); a few partial sums reach the driver, whatever the number of shards."""

    def total(t: pa.Table) -> pa.Table:
        out = np.frombuffer(t.column("sums")[0].as_py(), dtype=np.int64).copy()
        for v in t.column("sums")[1:]:
            out += np.frombuffer(v.as_py(), dtype=np.int64)
        return pa.table({"sums": [out.tobytes()]}, schema=pa.schema([("sums", pa.binary())]))

    rows = parts.groupBy(F.pmod("shard", F.lit(16))).applyInArrow(total, "sums binary").toArrow()
    return sum(np.frombuffer(v, dtype=np.int64) for v in rows.column("sums").to_pylist())


def _train_shards(state: np.ndarray, mean: np.ndarray, scale: np.ndarray, docs: int, epochs: range, size: int, seed: int):
    schema = pa.schema([("shard", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            for k in range(b.num_rows):
                shard, n, passages, packed, bag, y = (b.column(c)[k].as_py() for c in range(6))
                x = np.frombuffer(pa.decompress(packed, decompressed_size=passages * WIDTH * 4, codec="zstd"), dtype=np.float32).reshape(-1, WIDTH)
                rng = np.random.default_rng([seed, epochs.start, shard])
                after = descend(State.of(state), mean, scale, x, np.frombuffer(bag, np.int32), np.frombuffer(y, np.int8).astype(np.float64), epochs, size, rng)
                yield batch(schema, shard=[shard], sums=[np.rint(after.vector() * (n / docs) / WEIGHT_PART).astype(np.int64).tobytes()])

    return run


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS, seed: int = 11,
) -> Model:
    """Fit on the texts of all labelled documents outside the held-out fold."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
        .where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    )
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null").where(~held_out("k"))
    found = rows.join(known, "k").select("k", "y", "t")
    n, good, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    prior = (good + 1) / (n + 2)
    if good in (0, n):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
    shards = -(-max(size, 1) // shard_bytes)
    with scratch(docs.sparkSession):
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("k", "t"), F.lit(shards))).repartition(shards, "shard")
        packed = cut(dealt.groupBy("shard").applyInArrow(_pack, "shard long, docs long, passages long, sums binary, x binary, bag binary, y binary"))
        passages = packed.agg(F.sum("passages")).first()[0]
        mean, square = _sum(packed.select("shard", "sums")).reshape(2, -1) * (FEATURE_PART / passages)
        scale = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3
        mean, scale = mean.astype(np.float32), scale.astype(np.float32)  # as the passages are
        rounds, batch_size = (rounds, SHARED_BATCH) if shards > 1 else (1, BATCH)
        state = State.first(seed).vector()
        for some in np.array_split(np.arange(EPOCHS), rounds):
            run = _train_shards(state, mean, scale, n, range(int(some[0]), int(some[-1]) + 1), batch_size, seed)
            state = _sum(packed.select("shard", "docs", "passages", "x", "bag", "y").mapInArrow(run, "shard long, sums binary")) * WEIGHT_PART
    return Model(mean, scale, State.of(state).w, prior)


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            for i, j in pieces(offs, PIECE_BYTES):
                x, text = encode(Words(raw, offs[i : j + 1]))
                yield batch(schema, doc_id=b.column(0).slice(i, j - i), score=model.score(x, text), n_passages=np.bincount(text, minlength=j - i))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double, n_passages long")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def _keep(model: Model, place: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_buffers(b.column(place))
            found = [model.score(*encode(Words(raw, offs[i : j + 1]))) for i, j in pieces(offs, PIECE_BYTES)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *found]) >= threshold))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model predicts as 1, all their columns; rows never move."""
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col), threshold), docs.schema)
