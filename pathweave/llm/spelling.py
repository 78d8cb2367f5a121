"""Spelling variants: rare words linked to a frequent word one edit away, by
reduced-alphabet generation.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with only A-Z lower-cased. A
known error model can be planted: with h the unsigned crc32 of ``<id>:<run>``, runs
whose h is divisible by ``every`` lose the code point h % length. Words of at least
``shortest`` code points that occur ``least`` times overall make the vocabulary.

Every letter is hashed to one of a few symbols (the sixth root of the vocabulary's
size, 4 at least). For each word the full one-edit neighbourhood of its reduced word
is generated: all deletions, replacements, insertions and the reduced word itself (an
edit between letters of one symbol). Prefix polynomials give each neighbour's key
in constant time. Neighbours join the reduced vocabulary by key, and pairs are
verified on the original strings: exactly one inserted, deleted or replaced code point.
One edit between words is at most one edit between their reduced words, so no pair
is lost. A bitmap of the reduced vocabulary (bounded, see ``screen``) spares the
shuffle most neighbours that no word has; the join decides.

A word's form is its near word of largest n (ties: smallest in code-point order) if that
is at least ``ratio`` times its own n; its root is the end of the chain of forms, found
by pointer doubling (n grows tenfold a step, so chains are short).

Null texts hold no words, null ids count as empty text in the error model, repeated
rows count each, no documents give no rows. Texts are read whole, words of any
length are taken (neighbours are made in blocks of bounded size).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Screen, mix, screen, seeds, stage

EVERY, SHORTEST, LEAST, RATIO = 31, 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"
LONG = 4_000_000  # characters from which words are taken one by one
BLOCK = 1 << 18  # letters whose neighbours are made at once
BASE = 0x9E3779B97F4A7C15


def _tally(shortest: int, every: int):
    """Arrow batches of (id, text) -> words and their number; ``every`` 0: no planted errors."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")  # shorter runs can't become longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                text = text.encode().lower().decode()  # bytes: A-Z only
                own = Counter(runs.findall(text) if len(text) < LONG else (m.group() for m in runs.finditer(text)))
                if not every:
                    total.update(own)
                    continue
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), seed)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    total[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return run


class Reduced:
    """Keys of reduced words and of their neighbours."""

    def __init__(self, symbols: int):
        self.symbols, self.codes, self.powers = symbols, seeds(symbols, 53), Powers(BASE)

    def read(self, words: list[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.symbol = (mix(points.astype(np.uint64)) % np.uint64(self.symbols)).astype(np.int64)
        self.c = self.codes[self.symbol]
        self.first = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(words)), size)
        self.at = np.arange(len(points)) - self.first[self.word]
        self.powers.reach(int(size.max(initial=0)) + 1)
        self.up = self.powers.up[self.at]
        # prefix sums of c * base**at within each word
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.c * self.up, dtype=np.uint64)])
        self.before = run[:-1] - run[self.first][self.word]
        self.total = run[self.first + size] - run[self.first]
        self.size = size

    def own(self) -> np.ndarray:
        return mix(self.total)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key), edit by edit; repeats are possible."""
        base, inverse = self.powers.base, self.powers.inverse
        rest = self.total[self.word] - self.before  # from this letter on
        yield np.arange(len(self.total)), mix(self.total)
        yield self.word, mix(self.before + (rest - self.c * self.up) * inverse)
        for s in range(self.symbols):
            other = self.symbol != s
            yield self.word[other], mix((self.total[self.word] + (self.codes[s] - self.c) * self.up)[other])
            yield self.word, mix(self.before + self.codes[s] * self.up + rest * base)
            yield np.arange(len(self.total)), mix(self.total + self.codes[s] * self.powers.up[self.size])


def _own_keys(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for batch in batches:
            words = batch.column("word").to_pylist()
            if words:
                reduced.read(words)
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(reduced.own().view(np.int64))], names=["word", "n", "key"])

    return run


def _neighbour_keys(symbols: int, known: Screen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for batch in batches:
            words = batch.column("word").to_pylist()
            i = 0
            while i < len(words):
                j, letters = i, 0
                while j < len(words) and (j == i or letters + len(words[j]) <= BLOCK):
                    letters += len(words[j])
                    j += 1
                reduced.read(words[i:j])
                who, keys = [], []
                for w, k in reduced.neighbours():
                    hit = known(k)
                    who.append(w[hit])
                    keys.append(k[hit])
                w, k = np.concatenate(who), np.concatenate(keys)
                order = np.lexsort((k, w))
                w, k = w[order], k[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
                w, k = w[new], k[new]
                part = pa.array(words[i:j], pa.string())
                for a in range(0, len(w), BLOCK):
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(w[a : a + BLOCK])), pa.array(k[a : a + BLOCK].view(np.int64))], names=["word", "key"])
                i = j

    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> (word, n), staged."""
    d = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    words = d.mapInArrow(_tally(shortest, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(words.where((F.length("word") >= shortest) & (F.col("n") >= least)), "spelling-words")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n) with distinct words -> (word, near, m): both directions of every pair of
    words exactly one edit apart, m the near word's n."""
    size = words.count()
    symbols = symbols or max(4, int(np.ceil(size ** (1 / 6))))
    keyed = stage(words.select("word", "n").mapInArrow(_own_keys(symbols), "word string, n long, key long"), "spelling-keys")
    known = screen(keyed, "key", size)
    hits = words.select("word").mapInArrow(_neighbour_keys(symbols, known), "word string, key long")
    # a word has many neighbours, but Spark sizes them like the words: neither side may be broadcast by that size
    pairs = hits.hint("merge").join(keyed.select(F.col("word").alias("near"), F.col("n").alias("m"), "key").hint("merge"), "key")
    return pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "m")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without circles -> (word, root), by pointer doubling."""
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(at.join(up.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return at


def spelling_forms(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = vocabulary(docs, shortest, least, every)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("top"))
    judged = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.near").alias("near"), (-F.col("top.less")).alias("m"))
    big = F.col("m") >= ratio * F.col("n")
    judged = stage(judged.select("word", "n", "n_near", F.when(big, F.col("near")).alias("form"), F.when(big, F.col("m")).alias("form_n")), "spelling-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def forms_sql(shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, ratio: int = RATIO) -> str:
    """DuckDB: crc32 by its bitwise definition, near words by words with one code point left
    out (inserted: equal to the shorter word; replaced: equal at the same place)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = "case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end"
    return f"""
with recursive bits(b, x, i) as (select b, b, 0 from range(256) t(b) union all select b, {step}, i + 1 from bits where i < 8),
crc as materialized (select list(x::bigint order by b) as t from bits where i = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
own as materialized (select doc_id, run, count(*) as c from runs where length(run) >= {shortest} group by all),
hexed as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from own),
hashed as (select run, c, xor(list_reduce(list_prepend(4294967295::bigint,
  list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint)),
  lambda h, y: xor(h // 256, t[(xor(h, y) % 256)::bigint + 1])), 4294967295) as h from hexed, crc),
spoilt as (select case when h % {every} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from hashed),
words as materialized (select word, sum(c)::bigint as n from spoilt group by word having sum(c) >= {least} and length(word) >= {shortest}),
less as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, b.word as near, b.n as m from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.v = b.word
  union select b.word, a.word, a.n from less a join words b on a.v = b.word),
best as (select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from near group by word),
judged as materialized (select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.m >= {ratio} * w.n then b.near end as form, case when b.m >= {ratio} * w.n then b.m end as form_n
  from words w left join best b using (word)),
chain(word, root) as (select word, word from judged union all select c.word, j.form from chain c join judged j on j.word = c.root where j.form is not null)
select j.word, j.form, c.root, j.n, j.n_near, j.form_n from judged j
join chain c on c.word = j.word join judged e on e.word = c.root and e.form is null"""
