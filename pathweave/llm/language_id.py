"""Language identification by segmentation-marginalised unigrams.

The piece vocabulary is fixed: the letter pieces of a public vocabulary plus
every letter seen alone. A language is a unigram distribution over pieces, and a
word's probability is the sum over all its segmentations into pieces, computed by
the forward algorithm; a text's is the product over its words. The prediction is
the language with the highest posterior and the score is that posterior.

Words are the runs of letters of the lower-cased text, each with the vocabulary's
word-start mark, whole whatever their length. Pieces of every length that the
vocabulary holds are used. They never cross words, so the sum over a word's
segmentations depends on the word alone and is cached per Python worker (when the
cache is full, the words of the texts at hand stay), while every word of every text counts. Words of over ``WORD`` characters are summed with
rescaling (no underflow) in memory that does not grow with the segmentations, and
are not cached.

Training: expectation maximisation on the word counts of a sample of about
``sample_rows`` labelled rows per language (drawn by a hash of the id; rows of over
``sample_chars`` characters are taken only where shorter ones don't suffice).
Expected piece counts come from forward and backward sums; for these counts alone,
words are cut every WORD characters. Piece probabilities are smoothed towards the
pool of all languages, and no letter's falls below that of an unknown letter. Labels
used are whatever non-null values ``lang`` holds; with no labelled row, every text is
``und``.

Null or letterless texts: ``und`` with score 0. Ties: the smaller label. Equal
rows get equal results; nothing is shuffled for scoring.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stage

MARK = "▁"
WORD, ROUNDS, SAMPLE_ROWS, SAMPLE_CHARS = 32, 3, 1500, 8000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7  # probability of a letter that no piece covers, alike in all languages
SLAB, RESCALE = 1 << 17, 16  # places looked up at once; letters between two rescalings of a long word
CACHE_WORDS, CACHE_NUMBERS = 200_000, 4_000_000  # words and numbers that a worker keeps
UND = "und"


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces (with or without the mark) of a public vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    else:
        from tokenizers import Tokenizer

        names = [x.replace("</w>", "") for x in Tokenizer.from_file(path).get_vocab()]
    names = {x for x in names if x and x == x.lower() and (x.lstrip(MARK) == "" or x.lstrip(MARK).isalpha()) and x.count(MARK) <= 1 and MARK not in x[1:]}
    return sorted(names | {MARK})


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def cut(words: list[str]) -> list[str]:
    """Words in runs of at most WORD characters, for the training counts."""
    if max(map(len, words), default=0) <= WORD:
        return words
    return [w[i : i + WORD] for w in words for i in range(0, len(w), WORD)]


class PieceTable:
    """Numbers of pieces by the hash of their characters: a large table of single
    slots and a small one for the pieces that fall into a slot already taken."""

    BASE, BITS = np.uint64(0x9E3779B97F4A7C15), (20, 16)

    def __init__(self, pieces: list[str]):
        self.longest, self.unknown = max(map(len, pieces)), len(pieces)
        h, size = np.zeros(len(pieces), np.uint64), np.array([len(x) for x in pieces])
        for k in range(self.longest):
            on = np.flatnonzero(size > k)
            h[on] = h[on] * self.BASE + mix(np.array([ord(pieces[i][k]) + 1 for i in on], np.uint64))
        h = mix(h)
        self.tables, left = [], np.arange(len(pieces))
        for bits in self.BITS:
            size = bits
            while True:
                slot = (h[left] >> np.uint64(64 - size)).astype(np.int64) if not self.tables else (h[left] & np.uint64((1 << size) - 1)).astype(np.int64)
                _, first = np.unique(slot, return_index=True)
                if not self.tables or len(first) == len(left):
                    break
                size += 1
            keys, ids = np.zeros(1 << size, np.uint64), np.full(1 << size, -1, np.int32)
            keys[slot[first]], ids[slot[first]] = h[left[first]], left[first]
            self.tables.append((size, keys, ids))
            left = np.delete(left, first)
            if not len(left):
                break

    def find(self, h: np.ndarray) -> np.ndarray:
        h = mix(h)
        size, keys, ids = self.tables[0]
        slot = (h >> np.uint64(64 - size)).astype(np.int64)
        got = np.where(keys[slot] == h, ids[slot], np.int32(-1))
        if len(self.tables) > 1:
            size, keys, ids = self.tables[1]
            slot = (h & np.uint64((1 << size) - 1)).astype(np.int64)
            hit = np.flatnonzero(keys[slot] == h)
            got[hit] = np.maximum(got[hit], ids[slot[hit]])
        return got


class Lattice:
    """For words of one length: which piece stands where. pieces[i] lists (length,
    words or None for all, piece numbers); one letter that is no piece is 'unknown'."""

    def __init__(self, words: list[str], table: PieceTable):
        n, self.size = len(words[0]) + 1, len(words)
        self.n = n
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(self.size, n)
        codes = np.ascontiguousarray(mix(codes.T.astype(np.uint64) + np.uint64(1)))
        self.pieces: list[list[tuple[int, np.ndarray | None, np.ndarray]]] = []
        for i in range(n):
            row, h = [], np.zeros(self.size, np.uint64)
            for ln in range(1, min(table.longest, n - i) + 1):
                h = h * table.BASE + codes[i + ln - 1]
                ids = table.find(h)
                if ln == 1:
                    ids[ids < 0] = table.unknown
                    row.append((ln, None, ids))
                    continue
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    row.append((ln, at, ids[at]))
            self.pieces.append(row)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[i] (words, languages); p has a row per piece and one for unknown."""
        alpha = np.zeros((self.n + 1, self.size, p.shape[1]))
        alpha[0] = 1.0
        for i, row in enumerate(self.pieces):
            for ln, at, ids in row:
                if at is None:
                    alpha[i + ln] += alpha[i] * p[ids]
                else:
                    alpha[i + ln][at] += alpha[i][at] * p[ids]
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n + 1, self.size, p.shape[1]))
        beta[self.n] = 1.0
        for i in range(self.n - 1, -1, -1):
            for ln, at, ids in self.pieces[i]:
                if at is None:
                    beta[i] += beta[i + ln] * p[ids]
                else:
                    beta[i][at] += beta[i + ln][at] * p[ids]
        return beta


def long_forward(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """Log of the forward sum (words, languages) for words of one length, however long:
    only the sums that pieces may still reach are kept, rescaled every few letters."""
    n, size, reach = len(words[0]) + 1, len(words), table.longest + 1
    codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(size, n).T
    ring, logs = np.zeros((reach, size, p.shape[1])), np.zeros((size, p.shape[1]))
    ring[0] = 1.0
    slab = max(1, SLAB // size)
    for begin in range(0, n, slab):
        end = min(n, begin + slab)
        part = mix(codes[begin : end + table.longest].astype(np.uint64) + np.uint64(1))
        h, rows = np.zeros((end - begin, size), np.uint64), [[] for _ in range(end - begin)]
        for ln in range(1, min(table.longest, n - begin) + 1):
            m = min(end, n - ln + 1) - begin
            h = h[:m] * table.BASE + part[ln - 1 : ln - 1 + m]
            ids = table.find(h.ravel()).reshape(h.shape)
            if ln == 1:
                ids[ids < 0] = table.unknown
            for i in np.flatnonzero((ids >= 0).any(axis=1)).tolist():
                rows[i].append((ln, ids[i]))
        for i, row in enumerate(rows, begin):
            here = ring[i % reach].copy()
            ring[i % reach] = 0.0
            for ln, ids in row:
                at = np.flatnonzero(ids >= 0)
                ring[(i + ln) % reach][at] += here[at] * p[ids[at]]
            if i % RESCALE == 0:
                top = ring.max(axis=0)
                ring /= top
                logs += np.log(top)
    return np.log(ring[n % reach]) + logs


def by_length(words: list[str], block: int = 4096) -> Iterator[list[int]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and j - i < block and len(words[order[j]]) == len(words[order[i]]):
            j += 1
        yield order[i:j]
        i = j


def em(counts: list[tuple[str, float]], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Expected piece counts of one language after ``rounds`` rounds (last entry: unknown letters)."""
    v, table = len(pieces), PieceTable(pieces)
    words, weights = [w for w, _ in counts], np.array([c for _, c in counts], float)
    blocks = [(Lattice([words[i] for i in idx], table), weights[idx]) for idx in by_length(words)]
    expected = np.ones(v + 1)
    for _ in range(rounds):
        p = 0.9 * expected / expected.sum() + 0.1 / (v + 1)
        p[v] = UNKNOWN
        expected = np.zeros(v + 1)
        for lat, w in blocks:
            a, b = lat.forward(p[:, None])[:, :, 0], lat.backward(p[:, None])[:, :, 0]
            scale = w / a[lat.n]
            for i, row in enumerate(lat.pieces):
                for ln, at, ids in row:
                    s = slice(None) if at is None else at
                    expected += np.bincount(ids, a[i][s] * p[ids] * b[i + ln][s] * scale[s], v + 1)
    return expected


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    prob: np.ndarray  # (pieces + unknown, languages)
    prior: np.ndarray


def make_model(expected: dict[str, np.ndarray], rows: dict[str, int], pieces: list[str], smooth: float = 200.0) -> Model:
    langs = sorted(expected)
    v = len(pieces)
    if not langs:
        return Model([], pieces, np.zeros((v + 1, 0)), np.zeros(0))
    e = np.stack([expected[x] for x in langs], axis=1)[:v]
    pool = e.sum(axis=1, keepdims=True) + 0.5
    pool /= pool.sum()
    p = (e + smooth * pool) / (e.sum(axis=0, keepdims=True) + smooth)
    letters = [i for i, x in enumerate(pieces) if len(x) == 1]
    p[letters] = np.maximum(p[letters], UNKNOWN)
    p = np.vstack([p, np.full((1, len(langs)), UNKNOWN)])
    n = np.array([rows[x] for x in langs], float) + 1
    return Model(langs, pieces, p, np.log(n / n.sum()))


class Scorer:
    """Log probabilities of words per language, cached."""

    def __init__(self, model: Model):
        self.m, self.pieces = model, PieceTable(model.pieces)
        self.room = max(1024, min(CACHE_WORDS, CACHE_NUMBERS // max(1, len(model.langs))))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.m.langs)))

    def keep(self, words: set[str]) -> None:
        """Forget all other words; what is cached of these need not be summed again."""
        held = [w for w in words if w in self.at]
        rows = self.table[[self.at[w] for w in held]]
        self.clear()
        self.table = np.concatenate([rows, self.table])
        self.at.update(zip(held, range(len(held)), strict=True))

    def learn(self, words: list[str]) -> None:
        """Sum over the segmentations of words not seen yet."""
        n = len(self.at)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for idx in by_length(words):
            lat = Lattice([words[i] for i in idx], self.pieces)
            self.table[n + np.array(idx)] = np.log(lat.forward(self.m.prob)[lat.n])
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def loglik(self, words: list[str]) -> np.ndarray:
        """Summed over the words, in blocks that bound what is cached at once."""
        total = np.zeros(len(self.m.langs))
        long = Counter(w for w in words if len(w) > WORD)
        if long:
            words = [w for w in words if len(w) <= WORD]
            for idx in by_length(each := sorted(long), 256):
                total += np.array([long[each[i]] for i in idx], float) @ long_forward([each[i] for i in idx], self.pieces, self.m.prob)
        for i in range(0, len(words), self.room // 2):
            part = words[i : i + self.room // 2]
            new = sorted(w for w in set(part) if w not in self.at)
            if new:
                if len(self.at) + len(new) > self.room:
                    self.keep(set(part))
                self.learn(new)
            total += self.table[np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        split = [words_of(t) if t else [] for t in texts]
        if self.m.langs:
            # words of many texts are learned together, which is what makes the forward sums cheap
            short = {w for w in set().union(*split) if len(w) <= WORD}
            fresh = {w for w in short if w not in self.at}
            if len(self.at) + len(fresh) > self.room:
                self.keep(short)
            if len(self.at) + len(fresh) <= self.room:  # else text by text
                self.learn(sorted(fresh))
        for words in split:
            if not self.m.langs or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
                langs.append(UND)
                scores.append(0.0)
                continue
            z = self.m.prior + self.loglik(words)
            z = np.exp(z - z.max())
            best = int(z.argmax())
            langs.append(self.m.langs[best])
            scores.append(float(z[best] / z.sum()))
        return langs, scores


_SCORER: dict[str, Scorer] = {}


def predictor(model: Model, key: str):
    """Column function text -> struct(lang_pred, score); the model (at most pieces x
    languages numbers) travels once per executor as a broadcast variable."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _SCORER:
            _SCORER.clear()
            _SCORER[key] = Scorer(shared.value)
        scorer = _SCORER[key]
        for s in texts:
            langs, scores = [], []
            texts_, size, begin = list(s), 0, 0
            for i, t in enumerate(texts_):
                size += len(t or "")
                if size > 3_000_000 or i + 1 == len(texts_):
                    a, b = scorer.predict(texts_[begin : i + 1])
                    langs += a
                    scores += b
                    size, begin = 0, i + 1
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4; null ids are fold 0 (crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fold_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def train(labelled: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """labelled(id, text, lang) -> Model. One task per language runs EM on that
    language's word counts, bounded by the sample; the driver gets a number per piece."""
    d = labelled.where("lang is not null and text is not null").select(
        "text", F.col("lang").cast("string").alias("lang"), (F.length("text") > sample_chars).alias("big"),
        (F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = {(r["lang"], r["big"]): r["n"] for r in d.groupBy("lang", "big").agg(F.count("*").alias("n")).collect()}  # two rows per language
    langs = sorted({x for x, _ in counts})
    pieces = vocabulary(path)
    if not langs:
        return make_model({}, {}, pieces)
    share = {}
    for x in langs:
        short, long = counts.get((x, False), 0), counts.get((x, True), 0)
        share[x, False] = min(1.0, sample_rows / max(1, short))
        share[x, True] = min(1.0, max(0, sample_rows - short) / max(1, long))
    pick = F.create_map(*[F.lit(v) for (x, big), s in share.items() for v in (f"{int(big)}{x}", s)])
    sample = d.where(F.col("u") < pick[F.concat(F.col("big").cast("int").cast("string"), "lang")])

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(words_of(t)) for t in texts])

    words = sample.select("lang", F.explode(split("text")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    words = stage(words, "langid-words")
    letters = words.select(F.explode(F.split("w", "")).alias("w")).distinct()
    pieces = sorted({*pieces, *[r["w"] for r in letters.collect() if r["w"]]})

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        e = em(sorted(zip(f["w"], f["c"], strict=True)), pieces)
        return pd.DataFrame({"lang": [f["lang"].iloc[0]], "expected": [e.tobytes()]})

    got = words.groupBy("lang").applyInPandas(fit, "lang string, expected binary").collect()
    rows = {x: counts.get((x, False), 0) + counts.get((x, True), 0) for x in langs}
    return make_model({r["lang"]: np.frombuffer(r["expected"]) for r in got}, rows, pieces)


def identify(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, held_out, lang_pred, score for every row; fold 2 is never trained on."""
    out = fold(F.col(doc_id)) == 2
    labelled = docs.where(~out).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    model = train(labelled, path)
    import uuid

    p = predictor(model, uuid.uuid4().hex)
    return docs.select(*keep, out.alias("held_out"), p(F.col(text).cast("string")).alias("__p")).select(*keep, "held_out", "__p.*")
