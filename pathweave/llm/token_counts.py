"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole. A longer text is cut into
chunks that overlap; every chunk is encoded with offsets by itself, anywhere in
the cluster, and neighbours are spliced where both see the same *stable*
boundary. A boundary is the start of a pre-token. The pre-tokenizer scans from
left to right without looking back, merges never cross a pre-token, and a
decision looks at most two characters beyond the pre-token's end, or as far as
the longest special string. So a boundary of the left chunk that lies ``margin``
characters before its end is one of the whole text (by induction from the text's
start), and from a boundary common to both chunks on, the right chunk's encoding
is the whole text's. If two neighbours share none (a run of letters without end),
the text is tried again with chunks and overlaps four times as large, until at
last one chunk holds it whole; the count is exact in every case.

Nulls and empty texts have 0 tokens; equal long texts are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

CHUNK, OVERLAP = 32768, 512
_CACHE: dict[str, tuple] = {}


def load(path: str):
    """(tokenizer, margin), once per Python worker."""
    if path not in _CACHE:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        longest = max([len(str(x)) for x in t.get_added_tokens_decoder().values()] or [0])
        _CACHE[path] = (t, longest + 4)
    return _CACHE[path]


def boundaries(tok, text: str, head: int, tail: int) -> tuple[np.ndarray, np.ndarray, int]:
    """((position, tokens before it) of every pre-token start before ``head``, the same from
    ``tail`` on, number of tokens). Only the tokens of these two stretches are looked at."""
    e = tok.encode(text, add_special_tokens=False)
    n = len(e)

    def starts(i: int, j: int) -> np.ndarray:
        rows, last = [], e.token_to_word(i - 1) if i else object()
        for k in range(i, j):
            w = e.token_to_word(k)
            if w is None or w != last:
                rows.append((e.token_to_chars(k)[0], k))
            last = w
        return np.array(rows, dtype=np.int64).reshape(-1, 2)

    i, j = 0, n
    while i < n and e.token_to_chars(i)[0] < head:
        i += 1
    while j and e.token_to_chars(j - 1)[0] >= tail:
        j -= 1
    return starts(0, i), starts(j, n), n


def splice(left: np.ndarray, right: np.ndarray) -> int | None:
    """Tokens that the left chunk counts up to a common boundary less those that the
    right one counts before it; None without a common boundary."""
    common, i, j = np.intersect1d(left[:, 0], right[:, 0], assume_unique=False, return_indices=True)
    return int(left[i[0], 1] - right[j[0], 1]) if len(common) else None


def _counter(path: str):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok, _ = load(path)
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        for s in texts:
            which, every = pd.factorize(s.fillna(""))  # equal texts of a batch are encoded once
            out = []
            for i in range(0, len(every), 256):  # encodings are larger than texts
                out += [len(e) for e in encode(every[i : i + 256].tolist(), add_special_tokens=False)]
            yield pd.Series(np.array(out, np.int64)[which], dtype="int64")

    return count


def _cutter(chunk: int, overlap: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, text in zip(f["key"], f["text"], strict=True):
                step = chunk - overlap
                n = max(1, -(-(len(text) - overlap) // step))
                for i in range(n):
                    yield pd.DataFrame({"key": [key], "idx": [i], "start": [i * step], "last": [i == n - 1], "part": [text[i * step : i * step + chunk]]})

    return cut


def _encoder(path: str, chunk: int, overlap: int):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, margin = load(path)
        for f in frames:
            rows = []
            for key, idx, start, last, part in zip(f["key"], f["idx"], f["start"], f["last"], f["part"], strict=True):
                head, tail, total = boundaries(tok, part, overlap, len(part) - overlap)
                head = head + [start, 0]
                tail = tail[tail[:, 0] <= len(part) - margin] + [start, 0]
                rows.append((key, idx, total if last else 0, bool(last), head.tobytes(), tail.tobytes()))
            yield pd.DataFrame(rows, columns=["key", "idx", "total", "last", "head", "tail"])

    return encode


def _splicer():
    @F.pandas_udf("long")
    def delta(left: pd.Series, right: pd.Series) -> pd.Series:
        read = lambda b: np.frombuffer(b, np.int64).reshape(-1, 2)
        return pd.Series([None if b is None else splice(read(a), read(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")

    return delta


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep columns + n_bytes, n_tokens for every row of docs."""
    d = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    size = F.coalesce(F.octet_length("__text").cast("long"), F.lit(0).cast("long"))
    whole = F.coalesce(F.length("__text"), F.lit(0)) <= chunk
    small = d.where(whole).select(*keep, size.alias("n_bytes"), _counter(path)("__text").alias("n_tokens"))
    big = d.where(~whole).select(*keep, size.alias("n_bytes"), F.sha2("__text", 256).alias("__key"), F.col("__text").alias("text"))
    texts = big.select(F.col("__key").alias("key"), "text").dropDuplicates(["key"])
    texts = stage(texts, "tokens-long")
    counted, todo, c, o = None, texts, chunk, overlap
    while True:
        parts = todo.mapInPandas(_cutter(c, o), "key string, idx long, start long, last boolean, part string")
        parts = parts.repartition(F.col("key"), F.col("idx")).mapInPandas(_encoder(path, c, o), "key string, idx long, total long, last boolean, head binary, tail binary")
        parts = stage(parts, "tokens-chunks")
        right = parts.select("key", (F.col("idx") - 1).alias("idx"), F.col("head").alias("next"))
        pairs = parts.join(right, ["key", "idx"], "left").select("key", "last", "total", F.when(~F.col("last"), _splicer()("tail", "next")).alias("delta"))
        sums = stage(pairs.groupBy("key").agg((F.sum("total") + F.coalesce(F.sum("delta"), F.lit(0))).alias("n_tokens"), F.max(F.expr("not last and delta is null")).alias("failed")), "tokens-sums")
        good = sums.where("not failed").select("key", "n_tokens")
        counted = good if counted is None else counted.union(good)
        failed = sums.where("failed").select("key")
        if failed.limit(1).count() == 0:
            break
        todo, c, o = todo.join(failed, "key", "left_semi"), c * 4, o * 4
    long_rows = big.drop("text").join(counted.withColumnRenamed("key", "__key"), "__key").select(*keep, "n_bytes", "n_tokens")
    return small.unionByName(long_rows)
