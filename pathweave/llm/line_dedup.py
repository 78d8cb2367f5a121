"""Line deduplication with a deletion-neighbourhood join.

Lines are split at line feeds and normalised (lower case, runs of white space to
one blank, trimmed). Lines of fewer than ``least`` characters are no evidence of
copying: they are neither removed nor a reason to remove. Of the rest, a line is
removed if an earlier line (smaller doc_id, then line number, then hash of the
text) is equal or within one edit (insertion, deletion, substitution of a
character). Lines are judged on the input, so in a chain a ~ b ~ c both b and c go.

Equal lines: the earliest position per line hash, by a combined aggregate.

Near lines: every variant within the edit bound is a hashed key, and lines that
share a key are within the bound: two lines that agree after deletion of their
character at the same position (a substitution), or a line that equals another
one's deletion variant (an insertion). All members of such a group are near its
earliest member, so each group is one aggregate, not its pairs; a hit is then
verified with the exact edit distance. Variants are made for lines that can have
a partner at all: a line is cut into ``BLOCKS`` blocks, an edit falls into one, and
what stands outside it must be some other line's too. That test is exact (a line
that fails it has no partner), and the shared block says where to delete.

Null and empty texts have no line; a null id is the smallest. Rows with the same
id and text share their decisions; rows with the same id and other text do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, release, seeds, side, stage

LEAST, BLOCKS = 12, 3
BASE = int(seeds(1, 77)[0])
BACK = pow(BASE, -1, 1 << 64)
TAGS = seeds(64, 5)
PART = 1 << 17  # characters hashed at once: a line's hashes don't depend on it, a worker's memory does


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def edges(n: np.ndarray | int, b: int):
    """Begin and end of block b of a line of n characters."""
    return n * b // BLOCKS, n * (b + 1) // BLOCKS


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


class Prefixes:
    """Hashes of substrings of many lines laid end to end."""

    def __init__(self, lines: list[str]):
        self.len = np.fromiter(map(len, lines), np.int64, len(lines))
        self.at = np.concatenate([[0], np.cumsum(self.len)])
        code = mix(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(9))
        n = len(code)
        self.back = powers(BACK, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code * powers(BASE, n), out=self.sums[1:])

    def of(self, a, b) -> np.ndarray:
        """Hash of the characters [a, b), positions over all lines; concatenations are
        told apart by mixing in lengths."""
        return (self.sums[b] - self.sums[a]) * self.back[a]


def joined(p: Prefixes, start, cut_a, cut_b, end) -> np.ndarray:
    """Hash of [start, cut_a) followed by [cut_b, end)."""
    left, right = p.of(start, cut_a), p.of(cut_b, end)
    return mix(left + mix(right) + (np.asarray(end - cut_b).astype(np.uint64) << np.uint64(32)) + np.asarray(cut_a - start).astype(np.uint64))


def line_keys(p: Prefixes) -> np.ndarray:
    """(lines, 2 * BLOCKS): what stands outside block b of a line, first as a line of
    its own length, then as one with a character more than its partner."""
    out = np.zeros((len(p.len), 2 * BLOCKS), np.uint64)
    s, e = p.at[:-1], p.at[1:]
    for role in (0, 1):
        n = p.len - role
        for b in range(BLOCKS):
            lo, hi = edges(n, b)
            h = joined(p, s, s + lo, e - (n - hi), e)
            out[:, role * BLOCKS + b] = mix(h * TAGS[b] + n.astype(np.uint64))
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ths, texts = batch.column(0), batch.column(1), batch.column(2)
        rows, nos, norms, size = [], [], [], 0
        for r in range(batch.num_rows + 1):
            if r == batch.num_rows or size > PART:
                if norms:
                    p = Prefixes(norms)
                    h = mix(p.of(p.at[:-1], p.at[1:]) + p.len.astype(np.uint64)).view(np.int64)
                    k = line_keys(p).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32)), pa.array(k.ravel()))
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([ids.take(take), ths.take(take), pa.array(nos, pa.int32()), pa.array(h), pa.array(norms), lists], names=["doc_id", "th", "line_no", "h", "norm", "keys"])
                rows, nos, norms, size = [], [], [], 0
            if r < batch.num_rows:
                text = texts[r].as_py()
                for i, line in enumerate((text or "").split("\n")):
                    x = normal(line)
                    if len(x) >= LEAST:
                        rows.append(r)
                        nos.append(i)
                        norms.append(x)
                        size += len(x)


def _variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, idx, h): substitutions idx >= 0 (the deleted position), insertions -1 (the
    variants of the longer line) and -2 (the shorter line whole)."""
    for f in frames:
        for at in range(0, len(f), 256):
            part = f.iloc[at : at + 256]
            p = Prefixes(list(part["norm"]))
            keys, idx, owner = [], [], []
            for r, (n, js) in enumerate(zip(p.len.tolist(), part["js"], strict=True)):
                s, e = int(p.at[r]), int(p.at[r + 1])
                for j in sorted(js):
                    role, b = divmod(int(j), BLOCKS)
                    lo, hi = edges(n - role, b)
                    pos = np.arange(lo, hi + role)
                    # the deletion variant, hashed as one string: the right part moves one to the left
                    left, right = p.of(s, s + pos), p.sums[e] - p.sums[s + pos + 1]
                    v = left + right * p.back[s + 1]
                    keys.append(mix(v + np.uint64(n - 1)))
                    idx.append(pos if role == 0 else np.full(len(pos), -1))
                    owner.append(np.full(len(pos), r))
                whole = p.of(s, e)
                keys.append(mix(np.array([whole]).ravel() + np.uint64(n)))
                idx.append(np.array([-2]))
                owner.append(np.array([r]))
            h = part["h"].to_numpy()
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "idx": np.concatenate(idx).astype(np.int32), "h": h[np.concatenate(owner)]}).drop_duplicates()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, drops): the line numbers to remove."""
    spark = docs.sparkSession
    lines = stage(docs.where("text is not null and text <> ''").mapInArrow(_lines, "doc_id long, th long, line_no int, h long, norm string, keys array<long>"), "lines")
    place = F.struct("doc_id", "line_no", "th")
    firsts = stage(lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines-first")
    again = firsts.where("n > 1").select("h", "first")
    equal = lines.select("doc_id", "th", "line_no", "h").join(again, "h").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "line_no")
    # lines that agree with another line outside some block
    keyed = lines.select("h", F.posexplode("keys").alias("j", "key"))
    shared = stage(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"), "lines-shared")
    chosen = stage(keyed.join(side(shared, 1_000_000), "key", "left_semi").groupBy("h").agg(F.collect_set("j").alias("js")), "lines-chosen")
    chosen = chosen.join(firsts.select("h", "first"), "h")
    own = lines.select("h", "norm", place.alias("first"))
    texts = own.join(side(stage(chosen, "lines-able"), 200_000).withColumnRenamed("h", "h2").withColumnRenamed("first", "f2"), F.expr("h = h2 and first <=> f2")).select("h", "norm", "first", "js").dropDuplicates(["h"])
    texts = stage(texts, "lines-texts")
    release(spark)
    variants = texts.mapInPandas(_variants, "key long, idx int, h long").join(texts.select("h", "first"), "h")
    variants = stage(variants, "lines-variants")
    best = F.min(F.struct("first", "h")).alias("w")
    subs = variants.where("idx >= 0")
    a = subs.join(subs.groupBy("key", "idx").agg(best, F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key", "idx", "w"), ["key", "idx"])
    long, whole = variants.where("idx = -1"), variants.where("idx = -2")
    b = long.join(whole.groupBy("key").agg(best), "key")
    c = whole.join(long.groupBy("key").agg(best), "key")
    hits = None
    for x in (a, b, c):
        x = x.where("w.first < first").select("h", "first", F.col("w.h").alias("other"))
        hits = x if hits is None else hits.unionByName(x)
    hits = hits.distinct()
    t = texts.select("h", "norm")
    checked = hits.join(t, "h").join(t.select(F.col("h").alias("other"), F.col("norm").alias("other_norm")), "other").where(F.levenshtein("norm", "other_norm", 1).between(0, 1))
    near = checked.select("first").distinct().select("first.doc_id", "first.th", "first.line_no")
    drops = stage(equal.unionByName(near).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("drops")), "lines-drops")
    for used in (lines, firsts, shared, texts, variants):
        discard(used)
    return drops


def _keeper():
    @F.pandas_udf("string")
    def keep(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for t, d in zip(texts, drops, strict=True):
            if t is None or d is None or not len(d):
                out.append(t)
            else:
                d = set(d.tolist() if hasattr(d, "tolist") else d)
                out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in d))
        return pd.Series(out, dtype=object)

    return keep


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, the text without its repeated lines, and __n_removed."""
    spark = docs.sparkSession
    th = F.xxhash64(F.col(text).cast("string"))
    drops = repeated_lines(docs.select(F.col(doc_id).cast("long").alias("doc_id"), th.alias("th"), F.col(text).cast("string").alias("text")))
    release(spark)
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("drops").alias("__drops"))
    d = docs.select(F.struct("*").alias("__row"), F.col(doc_id).cast("long").alias("__key"), th.alias("__h"))
    got = d.join(drops, F.expr("__key <=> __id and __h = __th"), "left")
    cols = [(_keeper()(F.col("__row")[c].cast("string"), "__drops") if c == text else F.col("__row")[c]).alias(c) for c in docs.columns]
    return got.select(*cols, F.coalesce(F.when(F.col("__drops").isNotNull(), F.size("__drops")), F.lit(0)).cast("long").alias("__n_removed"))
