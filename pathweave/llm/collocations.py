"""Phrase collocations: frequent phrases per language by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and the bytes 0x0A to 0x0D into
pieces, and those at spaces and tabs into words. Prefix polynomials over the bytes
give every word a fingerprint, prefix polynomials over the words every n-gram one.
Each level n (1 to ``LONGEST``) is a pass over all texts: a shuffle sums the
occurrences by fingerprint (of language and phrase). From level 2 on, an n-gram is only
counted if both its (n-1)-grams may be frequent: a phrase occurs no more often than its
parts, so nothing frequent is lost. The test is a bitmap of bounded size; what passes
by chance is counted like all else. Then pointers (document, byte offset, length) to the
fingerprints found frequent are shuffled, one per task, and one is kept: first from a share
of the documents, which holds nearly all (a phrase occurs ``least`` times), then from
all documents for the fingerprints still without one.

Collisions: 31 bits of a second, independent fingerprint ride along. Where the occurrences
of one fingerprint disagree in it, their phrases are counted by their text instead. Only
frequent phrases are materialised, by their pointers, and their fingerprints
are taken again from the text.

Candidates have 2 to LONGEST words and a = f(phrase) >= ``least``. Cutting after
the first k words gives l, r = f of both parts and floor(1000 * a * n / (l * r)), n
the words of the language; the lowest-scoring cut counts (ties: smallest k). Numbers are
exact (decimals of 38 digits). A candidate goes if a longer phrase that holds it is as
frequent; it is enough to look one word further, since frequencies only fall.

Null language: ``und``; null text: empty; null ids are an ordinary value. Repeated
rows count each. Texts of any length come in windows of bounded size (a single
word is never cut). No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODE, Powers, Screen, lowered, mix, release, screen, seeds, stage, text_bytes, windows

LONGEST, LEAST, TOP, UND = 5, 100, 2000, "und"
WINDOW = 1 << 19  # bytes of text expanded at once
PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
GAP = PIECE.copy()
GAP[[9, 32]] = True
CODES = (BYTE_CODE, seeds(256, 29))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # of bytes; words use these plus 2
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
NEAR = 100_000  # pointers that are broadcast, as counted; more are joined by a shuffle
FEW = 32  # a phrase is looked for in one of so many documents first, then in all
TEXTS = "lang string, phrase string, c long"


class Grams:
    """Fingerprints of the n-grams of windows of text."""

    def __init__(self, mask: int = int(ALL)):
        self.mask = np.uint64(mask)  # fewer bits in tests, to force collisions
        self.of_bytes = [Powers(b) for b in BASES]
        self.of_words = [Powers(b + 2) for b in BASES]

    def read(self, data: np.ndarray, begin: int, own: int, end: int, off: np.ndarray) -> None:
        """Words of the window (byte ranges from ``begin``), their documents and hashes."""
        part = data[begin:end]
        word = ~GAP[part]
        inner = off[np.searchsorted(off, begin) : np.searchsorted(off, end)] - begin
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        first[inner] = word[inner]
        last[:-1] &= first[1:] | ~word[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.own = int(np.searchsorted(self.start, own - begin))
        self.doc = np.searchsorted(off, self.start + begin, side="right") - 1
        breaks = np.cumsum(PIECE[part])
        # run[i]: the first word after i that belongs to another piece
        cut = np.ones(len(self.start), bool)
        cut[:-1] = (self.doc[1:] != self.doc[:-1]) | (breaks[self.start[1:]] != breaks[self.end[:-1] - 1])
        at = np.flatnonzero(cut) + 1
        self.run = at[np.searchsorted(at, np.arange(len(self.start)), side="right")] if len(at) else at
        self.prefix = []
        for codes, b, w in zip(CODES, self.of_bytes, self.of_words, strict=True):
            h = mix(b.between(b.prefix(codes[part]), self.start, self.end))
            self.prefix.append(w.prefix(h))

    def firsts(self, n: int) -> np.ndarray:
        """Where the n-grams of the window's own words begin."""
        i = np.arange(self.own)
        return i[self.run[: self.own] >= i + n] if self.own else i

    def prints(self, i: np.ndarray, n: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both fingerprints of the n-grams at i; salts: a number per document's language."""
        salt = salts[self.doc[i]] + np.uint64(n)
        a, b = (mix(w.between(p, i, i + n) ^ salt) for w, p in zip(self.of_words, self.prefix, strict=True))
        return (a if self.mask == ALL else mix(a & self.mask)), b


def _salts(langs: list[str]) -> np.ndarray:
    """A number per row's language."""
    at = {x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.fromiter((at[x] for x in langs), np.uint64, len(langs))


def _passes(grams: Grams, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray, int]]:
    data, off = text_bytes(batch.column("text"))
    low, langs = lowered(data), batch.column("lang").to_pylist()
    salts = _salts(langs)
    for _, _, begin, own, end in windows(low, off, GAP, LONGEST, WINDOW):
        grams.read(low, begin, own, end, off)
        yield low, off, langs, salts, begin


def _count(n: int, before: Screen | None, mask: int):
    """Arrow batches of (lang, text) -> the n-grams of each window, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(mask)
        for batch in batches:
            for _, _, _, salts, _ in _passes(grams, batch):
                i = grams.firsts(n)
                if before is not None and len(i):
                    i = i[before(grams.prints(i, n - 1, salts)[0])]
                    i = i[before(grams.prints(i + 1, n - 1, salts)[0])]
                if not len(i):
                    continue
                fp, other = grams.prints(i, n, salts)
                order = np.argsort(fp)
                fp, other = fp[order], (other[order] >> np.uint64(33)).astype(np.int32)
                head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(fp[head].view(np.int64)), pa.array(np.diff(np.append(head, len(fp)))),
                    pa.array(np.minimum.reduceat(other, head)), pa.array(np.maximum.reduceat(other, head)),
                ], names=["fp", "c", "lo", "hi"])

    return run


def _point(frequent: list[Screen], wanted: list[Screen], mask: int):
    """Arrow batches of (lang, text, doc) -> a pointer to an occurrence of every n-gram that
    passes its level's screen of wanted ones, once per task. Prefixes of frequent n-grams
    are frequent, so what the other screens stop isn't looked at further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(mask), [np.zeros(0, np.uint64) for _ in frequent]
        for batch in batches:
            docs = np.asarray(batch.column("doc"))
            for _, off, _, salts, begin in _passes(grams, batch):
                i = grams.firsts(1)
                for n, (known, sought) in enumerate(zip(frequent, wanted, strict=True), 1):
                    i = i[grams.run[i] >= i + n]
                    fp = grams.prints(i, n, salts)[0]
                    hit = known(fp)
                    i, fp = i[hit], fp[hit]
                    hit = sought(fp)
                    new, at = np.unique(fp[hit], return_index=True)
                    at = i[hit][at]
                    old = np.searchsorted(seen[n - 1], new)
                    fresh = np.ones(len(new), bool)
                    inside = old < len(seen[n - 1])
                    fresh[inside] = seen[n - 1][old[inside]] != new[inside]
                    new, at = new[fresh], at[fresh]
                    if not len(new):
                        continue
                    seen[n - 1] = np.insert(seen[n - 1], old[fresh], new)
                    doc = grams.doc[at]
                    start = grams.start[at] + begin - off[doc]
                    size = grams.end[at + n - 1] - grams.start[at]
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.full(len(new), n, np.int32)), pa.array(docs[doc]), pa.array(start << 32 | size)], names=["fp", "words", "doc", "place"])

    return run


def _spell(n: int, wanted: np.ndarray, mask: int):
    """The occurrences of some fingerprints by their text (for those that collide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(mask)
        for batch in batches:
            for low, _, langs, salts, begin in _passes(grams, batch):
                i = grams.firsts(n)
                fp = grams.prints(i, n, salts)[0]
                hit = np.isin(fp, wanted)
                if not hit.any():
                    continue
                i = i[hit]
                texts = [" ".join(bytes(low[begin + grams.start[k] : begin + grams.end[k]]).decode() for k in range(j, j + n)) for j in i.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in grams.doc[i].tolist()], pa.string()), pa.array(texts), pa.array(np.ones(len(i), np.int64))], names=["lang", "phrase", "c"])

    return run


def _read(longest: int, mask: int):
    """(lang, text, pointers) -> the phrases pointed at whose fingerprint is the pointer's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(mask)
        for batch in batches:
            found = []
            for lang, text, points in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("points").to_pylist(), strict=True):
                raw = (text or "").encode()
                parts = [raw[p["place"] >> 32 : (p["place"] >> 32) + (p["place"] & 0xFFFFFFFF)].lower() for p in points]
                off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                data = np.frombuffer(b"".join(parts), np.uint8)
                grams.read(data, 0, len(data), len(data), off)
                salts = np.repeat(_salts([lang]), len(parts))
                size = np.bincount(grams.doc, minlength=len(parts))
                first = np.cumsum(size) - size
                for n in range(1, longest + 1):
                    k = np.array([j for j, p in enumerate(points) if p["words"] == n and size[j] == n], np.int64)
                    k = k[grams.run[first[k]] == first[k] + n] if len(k) else k
                    fp = grams.prints(first[k], n, salts)[0].view(np.int64) if len(k) else k
                    found += [(lang, n, b" ".join(parts[j].split()).decode(), points[j]["c"], points[j]["fp"]) for j, x in zip(k.tolist(), fp.tolist(), strict=True) if points[j]["fp"] == x]
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "words", "phrase", "f", "fp"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, mask: int = int(ALL)) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, lang) -> (lang, words, phrase, f) of every phrase of up to
    ``longest`` words with f >= least, and (lang, n) the words of each language."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("doc"))
    totals = stage(d.mapInArrow(_words(), "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    out, levels, screens, many = None, [], [], 0
    for n in range(1, longest + 1):
        rows = d.select("lang", "text").mapInArrow(_count(n, screens[-1] if screens else None, mask), "fp long, c long, lo int, hi int")
        sums = rows.groupBy("fp").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        level = stage(sums.where(F.col("c") >= least), f"phrases-{n}")
        size = level.count()
        del rows, sums  # else their shuffle files stay
        release(spark)
        if not size:
            break
        wrong = _collisions(level)
        if wrong is not None:
            spelt = d.select("lang", "text").mapInArrow(_spell(n, wrong, mask), TEXTS).groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
            spelt = stage(spelt.select("lang", F.lit(n).alias("words"), "phrase", "f", F.lit(None).cast("long").alias("fp")), f"phrases-spelt-{n}")
            out = spelt if out is None else out.unionByName(spelt)
        levels.append(level.where("lo = hi").select("fp", F.lit(n).alias("words"), "c"))
        screens.append(screen(level, "fp", size))
        many += size
    if not levels:
        return spark.createDataFrame([], "lang string, words int, phrase string, f long"), totals
    wanted = levels[0]
    for x in levels[1:]:
        wanted = wanted.unionByName(x)
    sought = screens
    for part in (d.where(F.pmod("doc", F.lit(FEW)) == 0), d):
        read = stage(_materialised(part, wanted, screens, sought, longest, mask, many), "phrases-read")
        out = read if out is None else out.unionByName(read)
        wanted = stage(wanted.join(read.select("fp", "words"), ["fp", "words"], "left_anti"), "phrases-left")
        left = {r["words"]: r["n"] for r in wanted.groupBy("words").agg(F.count("*").alias("n")).collect()}
        if not left:
            break
        many = sum(left.values())
        sought = [screen(wanted.where(F.col("words") == n), "fp", left.get(n, 0)) for n in range(1, len(screens) + 1)]
    return out.select("lang", "words", "phrase", "f"), totals


def _materialised(d: DataFrame, wanted: DataFrame, screens: list[Screen], sought: list[Screen], longest: int, mask: int, many: int) -> DataFrame:
    """(lang, words, phrase, f, fp) of the wanted (fp, words, c) that occur in d."""
    # one buffer per group: both first() values are of one row
    points = d.mapInArrow(_point(screens, sought, mask), "fp long, words int, doc long, place long").groupBy("fp", "words").agg(F.first("doc").alias("doc"), F.first("place").alias("place"))
    points = stage(points.join(wanted, ["fp", "words"]), "phrases-points")
    points = points.groupBy("doc").agg(F.collect_list(F.struct("fp", "words", "place", "c")).alias("points"))
    points = F.broadcast(points) if many <= NEAR else points
    read = d.join(points, "doc").select("lang", "text", "points").mapInArrow(_read(longest, mask), "lang string, words int, phrase string, f long, fp long")
    return read.dropDuplicates(["lang", "words", "phrase"])


def _words():
    """Words of each language, per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            at: dict[str, int] = {}
            langs = batch.column("lang").to_pylist()
            word = np.zeros(len(data) + 1, bool)
            word[1:] = ~GAP[data]
            first = word[1:] & ~word[:-1]
            starts = off[:-1][off[:-1] < off[1:]]
            first[starts] = word[1:][starts]
            each = np.diff(np.concatenate([[0], np.cumsum(first)])[off])
            for x, n in zip(langs, each.tolist(), strict=True):
                at[x] = at.get(x, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.string()), pa.array(list(at.values()), pa.int64())], names=["lang", "n"])

    return run


def _collisions(level: DataFrame, most: int = 1_000_000) -> np.ndarray | None:
    """Fingerprints whose occurrences differ in the second one: none in practice."""
    wrong = [r["fp"] for r in level.where("lo <> hi").select("fp").limit(most + 1).collect()]
    if len(wrong) > most:
        raise ValueError("fingerprints collide too often to be told apart")
    return np.array(wrong, np.int64).view(np.uint64) if wrong else None


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, mask: int = int(ALL)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` candidates by
    score, a (both descending) and phrase."""
    phrases, totals = frequent_phrases(docs, least, longest, mask)
    candidates = phrases.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # a phrase without its last or its first word, as frequent as the phrase that holds it
    longer = candidates.where("words >= 3").select("lang", "a", F.explode(F.array(F.expr("slice(w, 1, words - 1)"), F.expr("slice(w, 2, words - 1)"))).alias("inner"))
    longer = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("held"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where("held is null or held < a")
    cuts = kept.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right"))
    f = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    wide = "cast({} as decimal(38,0))".format
    score = F.expr(f"({wide(f'1000 * {wide('a')}')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """DuckDB: every n-gram as text, no fingerprints; ``longer`` phrases of any length are looked at."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with pieces as materialized (
  select coalesce(lang, '{UND}') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces where regexp_matches(piece, '[^\\x20\\x09]')),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, m.m as words, array_to_string(w[i.i : i.i + m.m - 1], ' ') as phrase
  from words, range(1, {longest + 1}) m(m), lateral (select unnest(range(1, greatest(len(w) - m.m + 2, 1))) as i) i),
f as materialized (select lang, words, phrase, count(*)::bigint as f from grams group by all having count(*) >= {least}),
cand as materialized (select lang, words, phrase, f as a, string_split(phrase, ' ') as w from f where words >= 2),
inside as (select c.lang, array_to_string(c.w[s.s : s.s + z.z - 1], ' ') as phrase, max(c.a) as held
  from cand c, range(2, {longest}) z(z), lateral (select unnest(range(1, greatest(c.words - z.z + 2, 1))) as s) s where z.z < c.words group by all),
kept as (select c.* from cand c left join inside i on i.lang = c.lang and i.phrase = c.phrase where i.held is null or 100 * i.held < 100 * c.a),
cuts as (select c.lang, c.phrase, c.a, k.k, array_to_string(c.w[1 : k.k], ' ') as lw, array_to_string(c.w[k.k + 1 :], ' ') as rw
  from kept c, lateral (select unnest(range(1, c.words)) as k) k),
scored as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n, (1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.lw join f y on y.lang = c.lang and y.phrase = c.rw join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank::bigint as rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= {top}"""
