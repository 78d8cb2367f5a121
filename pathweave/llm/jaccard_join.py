"""N-gram Jaccard join: a size-aware heavy-light join, and its components.

A document's set holds its distinct ``shingle``-word shingles (ASCII case folded,
words separated by ASCII white space; with fewer words the whole sequence as one).
Two documents link when 100 * intersection >= ``percent`` * union. Shingles are
compared by 64-bit hashes, sets by 128 bits.

1. Screening. Each set sends its ``n - o + c`` least shingles (o = ceil(percent * n /
   100), c = min(o, n - o + 1), any order common to all sets). Two linked sets with
   overlap a then share at least min(a - o + c) of them, the lesser of the two sides.
   A set whose prefix holds fewer shingles known to any other document than the least
   such number over all partner sizes links with nobody and leaves here; nearly all do.
   Which shingles are
   shared is found by exchanging packed hashes: a pack of documents sends each
   distinct hash once per bucket, so a hot shingle is one entry per pack.
2. Equal sets become one class, by a combined aggregate.
3. Frequencies of shingles among the classes are counted by the same exchange;
   prefixes then take the rarest first, so passages that many documents share
   come last and hardly ever reach a prefix.
4. Heavy-light join. Light sets enumerate the fixed-size subsets (c = 2) of their
   (n - o + 2)-prefix as keys; heavy sets scan the inverted lists of the single
   shingles of their (n - o + 1)-prefix. The boundary is the size at which the
   number of subsets passes the expected cost of the list entries, from the measured
   mean length of a list. Light sets that may link with heavy ones (size at least
   percent of the boundary) are in the lists too.
5. In rounds each class is compared with one centre: of its keys' centres (first the
   member with most shared shingles, so the least edited one; then a seeded draw) the one
   with which it shares most keys. Links among the verified pairs give components; a key
   whose members then all lie in one needs no more, so a group of n near copies costs a
   few n pairs. Rounds go on while they link at least a quarter of what they compare.
6. Keys that stay open hold sets that are near one another and yet do not link. They are
   joined by their differences from a centre c: with D(x) = x xor c, |x & y| = |c| -
   |c - x| - |c - y| + |D(x) & D(y)|, so x and y link only if D(x) and D(y) share t = (least
   overlap) - |c| + |c - x| + |c - y| entries. If t <= 0 both link with c itself. Else
   they share one of the |D| - t + 1 first entries of either, in an order that begins with the
   entries that sets of one component only have (which no open pair shares), then the rarest:
   these are new keys, per pair of levels of |c - x| so that t is known. This is
   repeated while it halves the pairs to compare; what remains is verified. Every link is
   either verified or lies within a component, so the components are exact.

Every input row gives a row. Null ids: rows are kept, component_id is the least
non-null id of the component, if any. Null or empty texts: empty set, own component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, components, discard, doc_slices, lowered, mix, pieces, release, seeds, side, stage, text_bytes, word_hashes

SHINGLE, PERCENT = 4, 85
OPEN = 6.0  # entries of a list that stay open at most, for the choice of the boundary (never for results)
ORDER = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    code = seeds(shingle + 1, 3)
    for i, j in doc_slices(off):
        w, first = word_hashes(lowered(data[off[i] : off[j]]), off[i : j + 1] - off[i])
        n = len(w)
        h = np.zeros(max(0, n - shingle + 1), np.uint64)
        for k in range(shingle):
            h += w[k : n - shingle + 1 + k] * code[k] if len(h) else h
        h = mix(h)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(h[a : b - shingle + 1])
            elif b > a:
                yield mix((w[a:b] * code[: b - a]).sum(dtype=np.uint64, keepdims=True) + code[shingle] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(n, percent: int = PERCENT):
    return -(-percent * n // 100)


@lru_cache(maxsize=100_000)
def least_shared(n: int, percent: int = PERCENT) -> int:
    """How many shingles of its screening prefix a set of n shares at least with the prefix of any set it links with."""
    o = int(least_overlap(n, percent))
    if not o:
        return 0
    m = np.arange(o, 100 * n // percent + 1)  # sizes of partners
    a = -(-percent * (n + m) // (100 + percent))  # least overlap that links
    om = least_overlap(m, percent)
    beyond = np.minimum(min(o, n - o + 1) - o, np.minimum(om, m - om + 1) - om)
    return int((a + beyond)[a <= np.minimum(n, m)].min())


def _bucketed(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of hashed keys."""
    b = (mix(keys ^ ORDER) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, order[cut[k] : cut[k + 1]]


def _screen(percent: int, shingle: int, buckets: int):
    """Per pack and bucket: its distinct prefix hashes (32 bits within the bucket) and
    their owner (row in the pack; -1: several, so known to be shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                ids, rows, need = part.column(0), [], []
                keys = []
                for r, s in enumerate(shingle_sets(*text_bytes(part.column(1)), shingle)):
                    o = int(least_overlap(len(s), percent))
                    c = min(o, len(s) - o + 1)
                    keys.append(s[: len(s) - o + c])
                    rows.append(np.full(len(keys[-1]), r, np.int32))
                    need.append(least_shared(len(s), percent))
                keys, rows = np.concatenate(keys), np.concatenate(rows)
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                keys, rows = keys[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                many = np.diff(np.concatenate([first, [len(keys)]])) > 1
                known = np.bincount(rows[np.repeat(many, np.diff(np.concatenate([first, [len(keys)]])))], minlength=part.num_rows)
                owner = np.where(many, -1, rows[first])
                keys = keys[first]
                doc = pa.array(np.arange(part.num_rows, dtype=np.int32))
                here = {"id": ids.cast(pa.int64()), "need": pa.array(np.array(need, np.int32)), "known": pa.array(known.astype(np.int32))}
                packed = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.StructArray.from_arrays([doc, *here.values()], names=["row", *here]))
                uid = blake2b(keys.tobytes() + repr(ids.to_pylist()).encode(), digest_size=16).digest()
                out = {"pack": [uid], "bucket": [-1], "keys": [None], "owner": [None]}
                for k, at in _bucketed(keys, buckets):
                    out["pack"].append(uid)
                    out["bucket"].append(k)
                    out["keys"].append(keys[at].astype(np.uint32).tobytes())
                    out["owner"].append(owner[at].astype(np.int32).tobytes())
                n = len(out["pack"])
                docs = pa.concat_arrays([packed, pa.nulls(n - 1, packed.type)])
                yield pa.RecordBatch.from_arrays([pa.array(out["pack"], pa.binary()), pa.array(out["bucket"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["owner"], pa.binary()), docs], names=["pack", "bucket", "keys", "owner", "docs"])

    return run


def _meet(f: pd.DataFrame) -> pd.DataFrame:
    """A bucket: per pack, the rows whose hashes another pack has too, one entry per hash."""
    keys = [np.frombuffer(x, np.uint32) for x in f["keys"]]
    size = [len(k) for k in keys]
    _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = np.split(n[inverse] > 1, np.cumsum(size)[:-1])
    out = []
    for pack, owner, ok in zip(f["pack"], f["owner"], shared, strict=True):
        who = np.frombuffer(owner, np.int32)
        out.append((pack, who[ok & (who >= 0)].tobytes()))
    return pd.DataFrame(out, columns=["pack", "rows"])


def _count(f: pd.DataFrame) -> pd.DataFrame:
    """A pack: how many shared hashes the buckets found for each of its rows."""
    rows, more = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in f["rows"]]), return_counts=True)
    return pd.DataFrame({"pack": [f["pack"].iloc[0]] * len(rows), "row": rows, "more": more.astype(np.int32)})


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(*text_bytes(b.column(1)), shingle))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
            sid = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sid, pa.binary()), pa.array(np.diff(at)), lists], names=["id", "th", "sid", "n", "s"])

    return run


def _sizes(shingle: int):
    @F.pandas_udf("long")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            arr = pa.array(s, pa.large_string(), from_pandas=True)
            yield pd.Series([len(x) for x in shingle_sets(*text_bytes(arr), shingle)], dtype="int64")

    return size


def _send(buckets: int):
    """A pack of classes: its distinct shingles per bucket with their count in the pack."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([np.asarray(s, np.int64) for s in f["s"]]).view(np.uint64), return_counts=True)
        rows = [(int(f["pack"].iloc[0]), k, keys[at].tobytes(), n[at].astype(np.int32).tobytes()) for k, at in _bucketed(keys, buckets)]
        return pd.DataFrame(rows, columns=["pack", "bucket", "keys", "counts"])

    return run


def _frequencies(f: pd.DataFrame) -> pd.DataFrame:
    """Shingles of a pack that several classes have, with their frequency."""
    keys = [np.frombuffer(x, np.uint64) for x in f["keys"]]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in f["counts"]])
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts, len(every)).astype(np.int64)[inverse]
    rows, at = [], 0
    for pack, k in zip(f["pack"], keys, strict=True):
        t = total[at : at + len(k)]
        at += len(k)
        ok = t > 1
        rows.append((pack, k[ok].tobytes(), t[ok].tobytes()))
    return pd.DataFrame(rows, columns=["pack", "keys", "freq"])


def _prefixes(percent: int):
    """Classes with the shingles of their prefix that others share, rarest first; the
    places tell which of them each prefix length includes. A class with too few shared
    shingles for any link is left out."""

    def run(_, sets: pd.DataFrame, freqs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=["sid", "n", "rare", "place"], dtype=object)
        if not len(freqs) or not len(sets):
            return empty
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in freqs["keys"]])
        freq = np.concatenate([np.frombuffer(x, np.int64) for x in freqs["freq"]])
        order = np.argsort(keys)
        keys, freq = keys[order], freq[order]
        rows = []
        for sid, s in zip(sets["sid"], sets["s"], strict=True):
            s = np.asarray(s, np.int64).view(np.uint64)
            at = np.searchsorted(keys, s)
            at[at == len(keys)] = 0
            f = np.where(keys[at] == s, freq[at], 1) if len(keys) else np.ones(len(s), np.int64)
            o = int(least_overlap(len(s), percent))
            if (f > 1).sum() < o:
                continue
            by = np.lexsort((s, f))[: len(s) - o + 2]
            ok = np.flatnonzero(f[by] > 1)
            rows.append((sid, len(s), s[by[ok]].view(np.int64).tolist(), ok.astype(np.int32).tolist()))
        return pd.DataFrame(rows, columns=["sid", "n", "rare", "place"]) if rows else empty

    return run


def _keys(percent: int, boundary: int):
    """(key, sid, n, w, rest): w counts the set's shared shingles in its prefix, rest is the overlap that is still possible if the key's shingles
    are the first that two sets share (positional bound)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 64):
                out = {"key": [], "sid": [], "n": [], "w": [], "rest": []}
                for sid, n, rare, place in zip(*(f[c].iloc[at : at + 64] for c in ("sid", "n", "rare", "place")), strict=True):
                    rare, place = np.asarray(rare, np.int64).view(np.uint64), np.asarray(place, np.int64)
                    o = int(least_overlap(n, percent))
                    light = n < boundary
                    if light and o >= 2:  # subsets of two
                        i, j = np.triu_indices(len(rare), 1)
                        a, b = np.minimum(rare[i], rare[j]), np.maximum(rare[i], rare[j])
                        out["key"].append(mix(a * np.uint64(3) + mix(b)))
                        out["rest"].append(n - place[j] + 1)
                    single = place < n - o + 1
                    if not light or o < 2 or 100 * n >= percent * boundary:
                        out["key"].append(mix(rare[single] ^ ORDER))
                        out["rest"].append(n - place[single])
                    m = sum(map(len, out["key"])) - sum(map(len, out["sid"]))
                    out["sid"].append([sid] * m)
                    out["n"].append([n] * m)
                    out["w"].append([len(rare)] * m)
                key = np.concatenate(out["key"]) if out["key"] else np.zeros(0, np.uint64)
                rest = np.concatenate(out["rest"]) if out["rest"] else np.zeros(0, np.int64)
                flat = lambda c: [x for y in out[c] for x in y]
                yield pd.DataFrame({"key": key.view(np.int64), "sid": flat("sid"), "n": flat("n"), "w": flat("w"), "rest": rest}).drop_duplicates(["key", "sid"])

    return run


def _differences(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs(sid, psid) -> with the size n, the entries d in which the two sets differ, whether
    they link, and the level: t of two sets is at least the sum of their levels times ``grain``."""
    left = classes.select("sid", "n", "s")
    right = classes.select(F.col("sid").alias("psid"), F.col("n").alias("pn"), F.col("s").alias("ps"))
    both = pairs.join(left, "sid").join(right, "psid").withColumn("less", F.array_except("ps", "s")).withColumn("more", F.array_except("s", "ps"))
    q, r = 100 + percent, F.size("less")
    common = F.col("pn") - r
    grain = F.greatest(F.lit(1), F.expr("cast(pn div 100 as int)"))
    level = F.floor((2 * (percent * F.col("n") + q * r) - q * F.col("pn")) / (2 * q * grain)).cast("int")
    return both.select("sid", "psid", "n", (100 * common >= percent * (F.col("n") + F.col("pn") - common)).alias("link"), F.concat("less", "more").alias("d"), level.alias("level"), grain.alias("grain"))


def _difference_keys(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, sid, n, rest, role) that any two sets of different components (``labels``) share
    which link and do not both link with their centre by their levels; role 1 is the lower level
    of a key, 2 the higher, 0 if equal."""
    labels = side(labels, FEW)
    named = star.join(labels, star.sid == labels.node, "left").withColumn("label", F.coalesce("label", "sid"))
    entries = named.select("sid", "psid", "label", "level", F.explode("d").alias("e"))
    often = entries.groupBy("psid", "e").agg(F.count("*").alias("f"), F.min("label").alias("x"), F.max("label").alias("y"), F.collect_set("level").alias("levels"))
    often = stage(often.where("x <> y").select("psid", "e", "f", "levels"), "join-often")
    # entries of one component only come first in the order: they are counted, not carried
    shared = entries.select("sid", "psid", "e").join(often.select("psid", "e", "f"), ["psid", "e"]).groupBy("sid", "psid").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("es"))
    low = star.groupBy("psid").agg(F.min("level").alias("low"))
    rows = star.select("sid", "psid", "n", "level", "grain").join(shared, ["sid", "psid"]).join(low, "psid")
    rows = rows.select("sid", "psid", "n", "level", "grain", "low", F.size("es").alias("m"), F.posexplode("es").alias("pos", "x"))
    rows = rows.where("greatest(1, (level + low) * grain) <= m - pos").select("sid", "psid", "n", "level", "grain", F.expr("m - pos").alias("room"), F.col("x.e").alias("e"))
    # a pair's levels meet at entries that sets of both levels have
    rows = rows.join(often.select("psid", "e", "levels"), ["psid", "e"])
    rows = rows.select("sid", "psid", "n", "level", "e", F.explode(F.expr("filter(levels, l -> greatest(1, (level + l) * grain) <= room)")).alias("l"))
    key = F.xxhash64("psid", "e", F.least("level", "l"), F.greatest("level", "l"))
    return rows.select(key.alias("key"), "sid", "n", F.col("n").alias("rest"), F.expr("case when level = l then 0 when level < l then 1 else 2 end").alias("role")).distinct()


def classes_and_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, light_below: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(id, text) -> (members(id, th, sid, n) of documents that passed the screening,
    th the xxhash64 of the text, verified links (a, b) of classes, labels (node, label))."""
    spark = docs.sparkSession
    buckets = pieces(docs, 4 << 20)
    sent = docs.mapInArrow(_screen(percent, shingle, buckets), "pack binary, bucket int, keys binary, owner binary, docs array<struct<row:int,id:long,need:int,known:int>>")
    sent = stage(sent, "join-sent")
    more = sent.where("bucket >= 0").select("pack", "bucket", "keys", "owner").groupBy("bucket").applyInPandas(_meet, "pack binary, rows binary")
    more = more.groupBy("pack").applyInPandas(_count, "pack binary, row int, more int")
    rows = sent.where("bucket < 0").select("pack", F.explode("docs").alias("d")).select("pack", "d.row", "d.id", "d.need", "d.known").distinct()
    able = rows.join(more, ["pack", "row"], "left").where(F.expr("need > 0 and known + coalesce(more, 0) >= need")).select("id").distinct()
    able = stage(able, "join-able")
    discard(sent)
    release(spark)
    chosen = docs.join(side(able, 1_000_000).withColumnRenamed("id", "__able"), F.expr("id <=> __able"), "left_semi")
    chosen = chosen.select("id", "text", F.xxhash64("text").alias("th"))
    sets = stage(chosen.mapInArrow(_sets(shingle), "id long, th long, sid binary, n int, s array<long>"), "join-sets")
    release(spark)
    members = stage(sets.select("id", "th", "sid", "n"), "join-members")
    classes = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("s").alias("s")).where("n > 0")
    n = members.agg(F.approx_count_distinct("sid")).first()[0]
    classes = stage(classes.withColumn("pack", F.pmod(F.xxhash64("sid"), F.lit(max(1, n // 1000)))), "join-classes")
    discard(sets)
    release(spark)
    freqs = classes.groupBy("pack").applyInPandas(_send(buckets), "pack long, bucket int, keys binary, counts binary")
    freqs = stage(freqs.groupBy("bucket").applyInPandas(_frequencies, "pack long, keys binary, freq binary"), "join-frequencies")
    prefixes = classes.select("pack", "sid", "s").groupBy("pack").cogroup(freqs.groupBy("pack")).applyInPandas(_prefixes(percent), "sid binary, n int, rare array<long>, place array<int>")
    prefixes = stage(prefixes, "join-prefixes")
    discard(freqs)
    release(spark)
    if light_below is None:
        r = prefixes.select(F.explode("rare").alias("t")).groupBy("t").count().agg(F.avg("count")).first()[0] or 1.0  # mean length of an inverted list
        # (m + 2)(m + 1) / 2 subsets against m + 1 lists, m = n - o: an entry of a list costs its own row, a
        # candidate with the list's least member, and what stays open, which is the mean list but hardly more
        # than a few entries as near copies close a list at once
        light_below = int(2 * (2 + min(r, OPEN)) * 100 / (100 - percent)) + 1
    keys = stage(prefixes.mapInPandas(_keys(percent, light_below), "key long, sid binary, n int, w int, rest int"), "join-keys")
    # a pair that links passes both bounds at the key of its first shared shingles
    fits = f"100 * least(n, pn) >= {percent} * greatest(n, pn) and {100 + percent} * least(rest, prest) >= {percent} * (n + pn)"

    def verify(pairs: DataFrame) -> DataFrame:
        left = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        right = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(left, "a").join(right, "b").withColumn("i", both).select("a", "b", F.expr(f"100 * i >= {percent} * (na + nb - i)").alias("link"))

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the keys whose members lie in several components and, if they have roles, in both."""
        labels = side(labels, FEW)
        named = rows.drop("label").join(labels, rows.sid == labels.node, "left").select(*[c for c in rows.columns if c != "label"], F.coalesce("label", "sid").alias("label"))
        met = F.bool_or(F.col("role") == 1) == F.bool_or(F.col("role") == 2) if "role" in rows.columns else F.lit(True)
        several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), met.alias("met")).where("x <> y and met").select("key")
        return stage(named.join(several, "key", "left_semi"), "join-open")

    def centres(rows: DataFrame, draw) -> DataFrame:
        centre = rows.groupBy("key").agg(F.min(F.struct(draw.alias("d"), "sid", "n", "rest", "label")).alias("p"))
        return centre.select("key", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("sid", "n", "rest", "label")])

    rows, tested, labels, r = keys.withColumn("label", F.col("sid")), None, None, 0
    while True:
        draw = F.xxhash64(F.lit(r), "sid") if r else -F.col("w").cast("long")
        pairs = rows.join(centres(rows, draw), "key").where(f"label <> plabel and {fits}").groupBy("sid", "psid").agg(F.count("*").alias("c"))
        pairs = pairs.groupBy("sid").agg(F.max(F.struct("c", "psid"))["psid"].alias("psid")).select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        seen = stage(verify(pairs), "join-star")
        tested = seen if tested is None else tested.unionByName(seen)
        compared, linked = seen.agg(F.count("*"), F.count_if("link")).first()
        if linked:
            labels = components(seen.where("link").select("a", "b"), "join", labels)
        elif labels is None:
            labels = tested.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
        release(spark)
        rows = still_open(rows, labels)
        r += 1
        if 4 * linked <= compared:
            break

    rows, last = rows.withColumn("role", F.lit(0)), None
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("x"), F.count_if(F.col("role") == 1).alias("y"), F.count_if(F.col("role") == 2).alias("z"))
        number, open_pairs = sizes.agg(F.coalesce(F.sum(F.expr("x + y + z")), F.lit(0)), F.coalesce(F.sum(F.expr("x * (x - 1) div 2 + y * z")), F.lit(0))).first()
        if open_pairs <= number or (last is not None and 2 * open_pairs > last):
            break
        last = open_pairs
        star = stage(_differences(rows.join(centres(rows, -F.col("w").cast("long")), "key").select("sid", "psid").distinct(), classes, percent), "join-differences")
        found = star.where("link and sid <> psid").select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b"), "link").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = stage(found, "join-found")
        if found.limit(1).count():
            tested = tested.unionByName(found)
            labels = components(found.select("a", "b"), "join", labels)
        near = stage(_difference_keys(star, labels).join(rows.select("sid", "w").distinct(), "sid"), "join-near")
        discard(star)
        release(spark)
        rows = still_open(near, labels)
    other = rows.select("key", F.col("sid").alias("psid"), F.col("n").alias("pn"), F.col("rest").alias("prest"), F.col("label").alias("plabel"), F.col("role").alias("prole"))
    across = rows.join(other, "key").where(f"label <> plabel and (role = 0 and prole = 0 and sid < psid or role = 1 and prole = 2) and {fits}")
    across = across.select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")).distinct()
    across = across.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more_links = stage(verify(across), "join-across").where("link").select("a", "b")
    links = tested.where("link").select("a", "b")
    if more_links.limit(1).count():
        links = links.unionByName(more_links)
        labels = components(more_links, "join", labels)
    return members, links, labels


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, light_below: int | None = None) -> DataFrame:
    """doc_id, n_shingles, n_verified_links (links of its class that were verified; links that
    components already imply are not counted), component_id."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    members, links, labels = classes_and_links(d, shingle, percent, light_below)
    degree = links.select("a", "b").union(links.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_verified_links"))
    m = members.where("n > 0").select("id", "sid")
    node = m.join(labels, m.sid == labels.node, "left").select("id", "sid", F.coalesce("label", "sid").alias("label"))
    node = stage(node, "join-nodes")
    least = node.groupBy("label").agg(F.min("id").alias("component_id"))
    # an id with several texts belongs to the least of their components
    found = node.join(least, "label").join(degree, node.sid == degree.a, "left").groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("n_verified_links").alias("n_verified_links"))
    sized = d.select("id", _sizes(shingle)("text").alias("n_shingles"))
    got = sized.join(found.withColumnRenamed("id", "__id"), F.expr("id <=> __id"), "left")
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("n_verified_links", F.lit(0)).alias("n_verified_links"), F.coalesce("component_id", "id").alias("component_id"))


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, th (xxhash64 of the text): the distinct (id, text) of each component but its least, by id
    (null last) and then th. Rows of one id with different texts are judged apart."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    members, _, labels = classes_and_links(d, shingle, percent)
    m = members.where("n > 0").select("id", "th", "sid").distinct()
    node = stage(m.join(labels, m.sid == labels.node, "left").select("id", "th", F.coalesce("label", "sid").alias("label")), "join-nodes")
    first = node.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th")).alias("f"))
    first = first.select(F.col("f.id").alias("__id"), F.col("f.th").alias("__th"))
    return node.select("id", "th").join(first, F.expr("id <=> __id and th = __th"), "left_anti")
