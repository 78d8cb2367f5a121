"""Benchmark decontamination by spaced seeds.

Texts are word sequences (ASCII case folded, punctuation at a word's ends
ignored). The unit of evidence is a window of ``window`` words: a document is
contaminated by a benchmark item if some window of it agrees with a window of the
item in all but at most ``errors`` positions. An item shorter than the window
counts whole and without substitutions, if it has ``least`` words or more; shorter
items name nothing in particular and never match.

Spaced seeds find such windows: the window is cut into blocks, and each mask
ignores ``errors`` of the blocks and keeps the rest. Up to ``errors`` substitutions
touch at most that many blocks, so one of the masks ignores them all and its hash
of the kept positions is the same on both sides: no match is lost. Hashes of the
test windows and hashes of the training windows are joined; every hit is verified
by comparing the two windows word by word.

The benchmark side is aggregated to distinct windows first (its repeats cost
nothing). Its hashes go to the tasks that read the documents as a sorted array if
they fit ``side_bytes``, measured, so that only training windows with a known hash
are sent on; beyond that, all training hashes go into the join. The join is an
ordinary one that Spark can split when a window is hot. Results are sums per document, combined before the shuffle.

One row per distinct doc_id: repeats of an id are one document (any of its rows
contaminates it). Null and empty texts, and an empty benchmark, match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, lowered, mix, seeds, stage, text_bytes, word_hashes

WINDOW, ERRORS, BLOCKS, LEAST = 13, 2, 5, 8
SIDE_BYTES = 64 << 20
# ASCII punctuation counts as white space, so "word," and "word" are equal
DROP = np.zeros(256, dtype=bool)
DROP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def masks(window: int = WINDOW, errors: int = ERRORS, blocks: int = BLOCKS) -> list[tuple[int, ...]]:
    """Kept positions of each mask."""
    edges = [round(i * window / blocks) for i in range(blocks + 1)]
    cut = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return [tuple(p for i, b in enumerate(cut) if i not in out for p in b) for out in combinations(range(blocks), errors)]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    return word_hashes(np.where(DROP[data], np.uint8(32), data), off)


def windows(first: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` words of one document stand."""
    ok = np.zeros(int(first[-1]) + 1, np.int32)
    long = np.diff(first) >= length
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - length + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def seed_hashes(words: np.ndarray, at: np.ndarray, kept: tuple[int, ...], salt: int) -> np.ndarray:
    code = seeds(len(kept), salt)
    h = np.zeros(len(at), np.uint64)
    for c, p in zip(code, kept, strict=True):
        h += words[at + p] * c
    return mix(h)


def plans(window: int, errors: int, blocks: int, short: list[int]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(salt, window length, kept positions): the masks, and whole short items by their length."""
    return [(100 + i, window, m) for i, m in enumerate(masks(window, errors, blocks))] + [(10_000 + n, n, tuple(range(n))) for n in short]


def _seeds_of(batches: Iterator[pa.RecordBatch], todo: list, known=None) -> Iterator[pa.RecordBatch]:
    """(id, h, at, words of the window) of every seed hash, or of those in ``known``."""
    for b in batches:
        data, off = text_bytes(b.column(1))
        for i, j in doc_slices(off):
            w, first = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cols = [[], [], [], []]
            for salt, n, kept in todo:
                at = windows(first, n)
                if not len(at):
                    continue
                h = seed_hashes(w, at, kept, salt).view(np.int64)
                if known is not None:
                    k = np.searchsorted(known, h)
                    k[k == len(known)] = 0
                    hit = np.flatnonzero(known[k] == h) if len(known) else np.zeros(0, int)
                    at, h = at[hit], h[hit]
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, side="right") - 1
                cols[0].append(i + doc)
                cols[1].append(h)
                cols[2].append(at - first[doc])
                cols[3].append(w[at[:, None] + np.arange(n)])
            for d, h, at, win in zip(*cols, strict=True):
                flat = pa.array(win.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, win.size + 1, win.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(h), pa.array(at.astype(np.int64)), lists], names=["id", "h", "at", "win"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, errors: int = ERRORS, blocks: int = BLOCKS, least: int = LEAST, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """A row per contaminated doc_id: n_windows (pairs of a document position and a
    distinct benchmark window verified), first_item, first_word, best (most equal
    words of a window divided by its length)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t"))
    lengths = items.select(F.size(F.regexp_extract_all(F.regexp_replace("t", r"[!-/:-@\[-`{-~]", " "), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n"))
    short = sorted(r["n"] for r in lengths.where(F.col("n").between(least, window - 1)).distinct().collect())  # fewer than `window` numbers
    todo = plans(window, errors, blocks, short)
    schema = "id long, h long, at long, win array<long>"

    def item_seeds(batches):
        # a short item is matched whole: its only window of its own length is itself
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                data, off = text_bytes(one.column(1))
                n = len(tokens(data, off)[0])
                yield from _seeds_of([one], [p for p in todo if p[1] == (n if n < window else window)])

    test = items.mapInArrow(item_seeds, schema).groupBy("h", "win").agg(F.min("id").alias("item"))
    test = stage(test.withColumnRenamed("win", "item_win"), "decon-test")
    typed = docs.schema[doc_id].dataType.simpleString()
    hashes = test.select("h").distinct()
    shared = None
    if 8 * hashes.count() <= side_bytes:
        shared = spark.sparkContext.broadcast(np.sort(hashes.toPandas()["h"].to_numpy(np.int64)))

    def doc_seeds(batches):
        yield from _seeds_of(batches, todo, None if shared is None else shared.value)

    hits = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(doc_seeds, f"id {typed}, h long, at long, win array<long>")
    equal = F.aggregate(F.zip_with("win", "item_win", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = hits.join(test, "h").where("size(win) = size(item_win)").withColumn("same", equal)
    allowed = F.when(F.size("win") < window, F.lit(0)).otherwise(F.lit(errors))
    good = pairs.where(F.col("same") >= F.size("win") - allowed).select("id", "at", "item", F.xxhash64("item_win").alias("w"), (F.col("same") / F.size("win")).alias("share"))
    good = good.groupBy("id", "at", "w").agg(F.min("item").alias("item"), F.max("share").alias("share"))  # a window hit by several masks counts once
    return good.groupBy("id").agg(F.count("*").alias("n_windows"), F.min("item").alias("first_item"), F.min("at").alias("first_word"), F.round(F.max("share"), 6).alias("best")).withColumnRenamed("id", "doc_id")
