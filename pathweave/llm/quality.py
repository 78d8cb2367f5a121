"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer numpy network with temperature-calibrated probabilities.

Tokens are runs of letters and digits (A-Z lower-cased, bytes over 0x7F are letters)
and runs of other marks; a run in capitals is followed by a token for that, a run equal
to the one before by a token for that. Every token has a sparse index vector of ``NONZERO``
entries of +1 or -1 among ``DIM``, drawn by its hash. Words are hashed to ``ROWS`` rows
of a table of fixed size (64 MB at most in a task); a row's context vector is the sum
of the index vectors of the tokens up to ``REACH`` places away in the same document,
over every occurrence in all documents. A row's vector is its context vector at length 1
plus its tokens' own index vector at length 1/2.

A document is the mean of its tokens' vectors, and the share of each kind of token (marks, capitals, repeats). The network (tanh layer, then a logistic unit)
is trained on a sample of at most about ``sample_rows`` labelled documents, drawn by a
hash of the id; a fifth of it is kept out to fit the temperature, by which scores are
calibrated. Without labels of both kinds every score is the label's share (0.5 without
any). Context vectors and pooled documents cover all rows and whole texts.

Null and empty texts pool to zeros and are scored like all others. Equal texts get equal
scores. Null ids are not labelled. Repeated ids: each row has its score; labels that
contradict each other are averaged and rounded half up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, SPACE, Powers, estimated_bytes, lowered, mix, seeds, stage, text_bytes, windows

ROWS, DIM, NONZERO, REACH = 1 << 15, 64, 4, 2
KINDS = 3  # shares that stand beside the vector: marks, capitals, repeats
PARTS = 64  # the table travels in so many blocks of rows
WINDOW = 1 << 20
SAMPLE_ROWS, HIDDEN, EPOCHS, BATCH, RATE = 20_000, 32, 40, 128, 0.01
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
CAPITALS, REPEAT = (seeds(2, 71) >> np.uint64(1)).tolist()  # hashes of the tokens for capitals and repeats


class Tokens:
    """Token hashes of windows of text."""

    def __init__(self):
        self.powers = Powers(0x9E3779B97F4A7C15)

    def read(self, data: np.ndarray, begin: int, own: int, end: int, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(hash, document, kind) of the tokens of a window and the number of its own."""
        part = data[begin:end]
        word, letter = ~SPACE[part], LETTER[part]
        inner = off[np.searchsorted(off, begin) : np.searchsorted(off, end)] - begin
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | (letter[1:] != letter[:-1])
        first[inner] = word[inner]
        last[:-1] &= first[1:] | ~word[1:]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            return np.zeros(0, np.uint64), start, np.zeros(0, np.int8), 0
        h = mix(self.powers.between(self.powers.prefix(BYTE_CODE[lowered(part)]), start, stop))
        doc = np.searchsorted(off, start + begin, side="right") - 1
        up, low = (np.concatenate([[0], np.cumsum(x[part])]) for x in (UPPER, LOWER))
        capitals = (up[stop] - up[start] >= 2) & (low[stop] == low[start])
        repeat = np.zeros(len(h), bool)
        repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & letter[start[1:]]
        mine = start < own - begin
        kind = np.where(letter[start], -1, 0).astype(np.int8)
        size = 1 + capitals + repeat
        at = np.cumsum(size) - size
        out, docs, kinds = np.repeat(h, size), np.repeat(doc, size), np.repeat(kind, size)
        out[at[capitals] + 1], kinds[at[capitals] + 1] = CAPITALS, 1
        where = at[repeat] + size[repeat] - 1
        out[where], kinds[where] = REPEAT, 2
        return out, docs, kinds, int(size[mine].sum())


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (tokens, NONZERO) and signs of the index vectors of token hashes."""
    at = np.stack([(h >> np.uint64(7 * k)) & np.uint64(DIM - 1) for k in range(NONZERO)], 1).astype(np.int64)
    sign = np.stack([((h >> np.uint64(7 * k + 6)) & np.uint64(1)).astype(np.int64) * 2 - 1 for k in range(NONZERO)], 1)
    return at, sign


def rows_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


def _contexts(spread: int):
    """Arrow batches of text -> the task's table in blocks: context sums and, in the last
    DIM columns, the sums of the own index vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total, some = Tokens(), np.zeros((ROWS * 2 * DIM), np.int64), False
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for _, _, begin, own, end in windows(data, off, SPACE, REACH, WINDOW):
                h, doc, _, mine = tokens.read(data, begin, own, end, off)
                if not mine:
                    continue
                some = True
                row = rows_of(h) * 2 * DIM
                at, sign = index_entries(h)
                cells, signs = [(row[:mine, None] + DIM + at[:mine]).ravel()], [sign[:mine].ravel()]
                for d in range(1, REACH + 1):
                    i = np.arange(min(mine, max(0, len(h) - d)))
                    i = i[doc[i] == doc[i + d]]
                    for a, b in ((i, i + d), (i + d, i)):
                        cells.append((row[a][:, None] + at[b]).ravel())
                        signs.append(sign[b].ravel())
                cell, sg = np.concatenate(cells), np.concatenate(signs)
                total += np.bincount(cell[sg > 0], minlength=len(total))
                total -= np.bincount(cell[sg < 0], minlength=len(total))
        if some:
            task = TaskContext.get().partitionId() % spread
            blocks = total.reshape(PARTS, -1)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), task, np.int32)), pa.array([packed(blocks[k]) for k in used.tolist()], pa.binary())], names=["block", "task", "sums"])

    return run


def packed(x: np.ndarray) -> bytes:
    """Nonzero entries: places as 32 bits, then values as 64 bits."""
    at = np.flatnonzero(x)
    return at.astype(np.int32).tobytes() + x[at].astype(np.int64).tobytes()


def unpacked(raw: bytes, into: np.ndarray) -> None:
    n = len(raw) // 12
    into[np.frombuffer(raw, np.int32, n)] += np.frombuffer(raw, np.int64, n, 4 * n)


def _add(f: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(ROWS * 2 * DIM // PARTS, np.int64)
    for raw in f["sums"]:
        unpacked(raw, total)
    return pd.DataFrame({"block": f["block"].iloc[:1], "task": [0], "sums": [packed(total)]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """docs(text) -> the table of ROWS vectors, from all texts. Sums meet in two steps
    (by block and a share of the tasks, then by block), so that no group holds more than
    the root of the number of tasks."""
    d = docs.select(F.col("text").cast("string").alias("text"))
    spread = max(1, math.isqrt(estimated_bytes(d) // (16 << 20)))
    kind = "block int, task int, sums binary"
    sums = d.mapInArrow(_contexts(spread), kind).groupBy("block", "task").applyInPandas(_add, kind)
    sums = stage(sums.groupBy("block").applyInPandas(_add, kind), "quality-vectors")
    total = np.zeros((PARTS, ROWS * 2 * DIM // PARTS), np.int64)
    for r in sums.toLocalIterator():  # PARTS rows
        unpacked(bytes(r["sums"]), total[r["block"]])
    context, own = np.split(total.reshape(ROWS, 2 * DIM).astype(np.float32), 2, axis=1)
    return unit(context) + 0.5 * unit(own)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _pooled(table):
    """Arrow batches of (id, text) -> id, pooled vector as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, vectors = Tokens(), table.value
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            sums, n = np.zeros((len(off) - 1, DIM + KINDS)), np.zeros(len(off) - 1)
            for _, _, begin, own, end in windows(data, off, SPACE, 0, WINDOW):
                h, doc, kind, mine = tokens.read(data, begin, own, end, off)
                row, doc, kind = rows_of(h[:mine]), doc[:mine], kind[:mine]
                if not mine:
                    continue
                head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                who = doc[head]
                sums[who, :DIM] += np.add.reduceat(vectors[row], head, axis=0)
                for k in range(KINDS):
                    sums[who, DIM + k] += np.add.reduceat((kind == k).astype(float), head)
                n[who] += np.diff(np.append(head, mine))
            mean = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array([x.tobytes() for x in mean], pa.binary())], names=["id", "row", "pooled"])

    return run


class Network:
    """Two layers on standardised inputs, with a temperature."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / math.sqrt(size), (size, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, decay: float = 1e-4, seed: int = 7) -> None:
        """Mini-batch Adam on the logistic loss, x standardised."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(seed)
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for s in range(0, len(order), BATCH):
                b = order[s : s + BATCH]
                h = np.tanh(z[b] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -500, 500)))
                e = (p - y[b]) / len(b)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                grads = [z[b].T @ back, back.sum(axis=0), h.T @ e, np.array([e.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least logistic loss, by golden-section search on its logarithm."""
        z = self.logits(x)

        def loss(u: float) -> float:
            s = z / math.exp(u)
            return float(np.mean(np.logaddexp(0, s) - y * s))

        a, b, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
        for _ in range(60):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) <= loss(d) else (c, b)
        self.temperature = math.exp((a + b) / 2)


class Constant:
    """The model without labels of both kinds."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 3; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(sample: list[tuple[bytes, float, bool]]) -> Network | Constant:
    """(pooled vector, label, kept out for the temperature) -> model."""
    if not sample:
        return Constant(0.5)
    x, y = np.stack([np.frombuffer(r[0], np.float32) for r in sample]).astype(float), np.array([r[1] for r in sample], float)
    if y.min() == y.max():
        return Constant(float(y[0]))
    out = np.array([r[2] for r in sample])
    if len(set(y[~out])) < 2 or len(set(y[out])) < 2:
        out = np.zeros(len(y), bool)
    net = Network(x.shape[1])
    net.fit(x[~out], y[~out])
    net.calibrate(*((x[out], y[out]) if out.any() else (x, y)))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(word_vectors(d))
    rows = d.select(F.col("doc_id").alias("id"), (fold(F.col("doc_id")) == 1).alias("row"), "text")
    id_type = d.schema["doc_id"].dataType.simpleString()
    pooled = stage(rows.mapInArrow(_pooled(table), f"id {id_type}, row boolean, pooled binary").select(F.col("id").alias("doc_id"), F.col("row").alias("held_out"), "pooled"), "quality-pooled")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    usable = pooled.where(~F.col("held_out")).join(known, "doc_id").select(F.xxhash64(F.lit(17), "doc_id").alias("u"), "pooled", (F.col("q") >= 0.5).cast("double").alias("y"))
    usable = stage(usable, "quality-labelled")
    share = min(1.0, sample_rows / max(1, usable.count()))
    drawn = F.pmod("u", F.lit(1 << 30)) < int(share * (1 << 30))
    # bounded: about sample_rows rows of DIM + KINDS numbers
    sample = usable.where(drawn).select("pooled", "y", (F.pmod(F.shiftrightunsigned("u", 32), F.lit(5)) == 0).alias("kept")).orderBy("pooled", "y").collect()
    model = spark.sparkContext.broadcast(train([(bytes(r[0]), r[1], r[2]) for r in sample]))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        # rounded: the last bits of a matrix product depend on the rows beside
        return pd.Series(np.round(model.value.scores(np.stack([np.frombuffer(b, np.float32) for b in x]).astype(float)), 9))

    return pooled.select("doc_id", "held_out", score("pooled").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
