"""Shared helpers of the training-data operators: tables, staged results, byte
kernels for whole Arrow batches, and connected components.

Conventions that hold for every operator unless its docstring says otherwise:
a null text counts as empty; rows are never dropped for their size; a null
``doc_id`` is an ordinary value; only the columns an operator names are read,
so further columns (whatever their names) do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import ensure_checkpoint_dir

# bytes [\x20\x09-\x0D]: the white space that separates words
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE = 2 << 20  # bytes of a long text that make a window
CACHED = 1 << 18  # bytes of text that a kernel holds expanded at once: its arrays are some ten times as large and stay in a core's cache
FEW = 100_000  # nodes of a graph whose labels (two short values a row) may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: a cut in the lineage
    that outlives lost executors and lets Spark drop the shuffle files before it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, whereupon Spark deletes the shuffle
    files of finished stages (it would do so later by itself)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; used to size tasks, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, bytes_each: int, least: int = 8, most: int = 100_000) -> int:
    return max(least, min(most, -(-estimated_bytes(df) // bytes_each)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# ---------------------------------------------------------------- byte kernels
def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h = h ^ (h >> np.uint64(27))
    h = h * M2
    return h ^ (h >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x) | np.uint64(1)


BYTE_CODE = seeds(256, 11)
WORD_BASE = 1024  # position powers are made up to this length, then per word


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    else:
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if len(col) == 0 or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII A-Z to lower case."""
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


def doc_slices(off: np.ndarray, limit: int = CACHED) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``limit`` bytes (a longer one is alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _cuts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that end at a word's end, about CACHED long."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(n, pos + CACHED)
        if end < n:
            back = np.flatnonzero(SPACE[data[pos:end]])
            k = int(np.searchsorted(off, end, side="right")) - 1
            end = max(pos + int(back[-1]) + 1 if len(back) else 0, int(off[k]) if k >= 0 else 0)
            if end <= pos:  # one huge word: take all of it
                end = n
                for s in range(pos, n, CACHED):
                    more = np.flatnonzero(SPACE[data[s : s + CACHED]])
                    if len(more):
                        end = s + int(more[0])
                        break
                nxt = int(off[np.searchsorted(off, pos, side="right")])
                end = min(end, nxt) if nxt > pos else end
        yield pos, end
        pos = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every white-space word, and the word range of each document:
    words of document i are hashes[first[i]:first[i + 1]]."""
    out, starts_all = [], []
    power = np.cumprod(np.full(WORD_BASE, BYTE_CODE[7], np.uint64))
    for a, b in _cuts(data, off):
        part = data[a:b]
        word = ~SPACE[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
        begin[inner] = word[inner]  # a document's first byte begins a word
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        at = np.flatnonzero(word)
        which = np.cumsum(begin)[at] - 1
        k = at - starts[which]
        if k.max() < WORD_BASE:
            p = power[k]
        else:
            p = power[k % WORD_BASE] * mix((k // WORD_BASE).astype(np.uint64) + np.uint64(1))
            p[k < WORD_BASE] = power[k[k < WORD_BASE]]
        vals = BYTE_CODE[part[at]] * p
        firsts = np.searchsorted(at, starts)
        out.append(mix(np.add.reduceat(vals, firsts)))
        starts_all.append(starts + a)
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    s = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off)


def windows(data: np.ndarray, off: np.ndarray, gap: np.ndarray, ahead: int, limit: int = SLICE) -> Iterator[tuple[int, int, int, int, int]]:
    """(first, last, begin, own, end): documents first:last in the bytes begin:end. A
    document of over 2 x limit bytes comes in several windows cut at gap bytes: words
    that start before ``own`` belong to the window, ``ahead`` more words follow them."""
    for i, j in doc_slices(off, limit):
        a, e = int(off[i]), int(off[j])
        if e - a <= 2 * limit:
            yield i, j, a, e, e
            continue
        while a < e:
            own = _next_gap(data, a + limit, e, gap)
            end, size = own, 4096
            while own < e:
                word = ~gap[data[own : min(e, own + size)]]
                starts = np.flatnonzero(word[1:] & ~word[:-1])
                if len(starts) > ahead or own + size >= e:
                    end = own + 1 + int(starts[ahead]) if len(starts) > ahead else e
                    break
                size *= 4
            yield i, j, a, own, end
            a = own


def _next_gap(data: np.ndarray, at: int, end: int, gap: np.ndarray) -> int:
    for s in range(at, end, 1 << 16):
        found = np.flatnonzero(gap[data[s : min(end, s + (1 << 16))]])
        if len(found):
            return s + int(found[0])
    return end


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            n = 1 << (n + 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (self.base, self.inverse))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix polynomials: entry i is the sum of codes[j] * base**j over j < i."""
        self.reach(len(codes))
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches start:end, wherever they stand."""
        return (prefix[end] - prefix[start]) * self.down[start]


# ---------------------------------------------------------------- screens
class Screen:
    """A bitmap over 64-bit keys: says no only to keys that it was not built from."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.shift = bits, np.uint64(64 - size)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> self.shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def screen(keys: DataFrame, col: str, count: int, most: int = 29) -> Screen:
    """The bitmap of a long column, about 64 bits a key and at most 2**most bits (64
    MB); beyond that more keys pass by chance, which callers count or join exactly."""
    size = min(most, max(15, (64 * max(1, count) - 1).bit_length()))
    slot = F.shiftrightunsigned(F.col(col), 64 - size) + 1
    got = keys.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    bits = np.zeros((1 << size) // 8, np.uint8)
    for r in got.toLocalIterator():
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return Screen(bits, size)


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """Connected components by minimum labels with pointer jumping.

    edges(a, b) of any orderable type -> (node, label), label the least node of
    the component. Every round is staged; rounds grow with the logarithm of a
    component's diameter. Isolated nodes do not appear. Null ends are ignored. Labels of at most
    ``FEW`` nodes (counted) are broadcast, so that a round of a small graph has one shuffle.
    ``known``: the result for earlier edges; the new ones then join its components, and only what
    they join is worked on.
    """
    if known is not None:
        near = side(known, FEW)
        for end in ("a", "b"):
            own = near.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
            edges = edges.join(own, F.col(end) == F.col("__node"), "left").withColumn(end, F.coalesce("__label", end)).select("a", "b")
        merged = components(edges, name)
        to = side(merged, FEW)
        moved = known.join(to.select(F.col("node").alias("__node"), F.col("label").alias("__label")), F.col("label") == F.col("__node"), "left")
        moved = moved.select("node", F.coalesce("__label", "label").alias("label"))
        # a label is a node of its component, so the other nodes are new
        return stage(moved.unionByName(merged.join(near.select("node"), "node", "left_anti").select("node", "label")), f"{name}-labels")
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    few = labels.limit(FEW + 1).count() <= FEW
    while True:
        labels = F.broadcast(labels) if few else labels
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near.select(F.col("a").alias("node"), "l"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stage(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-labels")
        done = new.where("label <> old").limit(1).count() == 0
        labels = new.select("node", "label")
        if done:
            return labels


def side(df: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if it has at most so many (short) rows, as counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def discard(staged: DataFrame) -> None:
    """Delete a staged result that later stages have consumed."""
    spark = staged.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
