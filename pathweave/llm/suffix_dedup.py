"""Removal of byte strings that an earlier document holds, by suffix arrays.

Every byte covered by a ``length``-byte string that also starts in a document with
a smaller doc_id is removed; strings are judged on the input and never cross
documents. The work is cut into shards so that equal strings meet:

1. Exact copies of a text are known from its hash; all but the smallest id are
   covered whole and leave here.
2. Each string (a window of the text) has an anchor: the least hash among its
   16-byte grams. Equal strings have equal anchors, and neighbouring windows mostly
   share one, so a text falls into runs of windows with one anchor (about one per
   18 bytes). Packs of documents exchange the distinct anchors they hold; a run
   whose anchor no other document has can't repeat and is dropped. A hot anchor is
   one entry per pack.
3. The other runs, as short pieces of text, are dealt to shards by anchor. A shard
   sorts all suffixes of its pieces with Larsson-Sadakane refinement in numpy (ranks
   of eight bytes, doubled until every suffix stands alone or ``length`` bytes are in order);
   neighbours are compared by words for the common prefixes. Neighbours in the order with ``length`` common bytes are the same
   string; its smallest doc_id decides.
4. An anchor with very many runs is spread over several shards. Each sends the
   sorted distinct strings that are still unremoved there, dealt to parts by a hash of
   the whole string; each part is merged by binary search, and what a smaller doc_id holds in another shard is
   removed too.
5. Removed intervals are joined back to the texts.

Null and empty texts have no string. A null id is the smallest. Rows with equal id
are the same document for "smaller": they do not remove from each other.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_slices, mix, pieces, release, side, stage, text_bytes

LENGTH, GRAM, RUN = 50, 16, 64
SHARD_BYTES, HOT = 4 << 20, 4096
FIRST = -(2**63)  # the id that stands for null


def loads(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position (zeros after the end), as integers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), dtype=kind, buffer=padded, strides=(1,)).astype(np.uint64)


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor) of the runs of each document."""
    out = []
    width = length - GRAM + 1  # grams in a window
    for i, j in doc_slices(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(d) < length:
            continue
        x = loads(d)
        n = len(d) - GRAM + 1
        m = mix(x[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(x[GRAM - 8 : GRAM - 8 + n]))
        w = 1
        while 2 * w <= width:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < width:
            m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
        # windows that lie within a document: o[k] .. o[k + 1] - length
        begin, count = o[:-1], np.maximum(0, np.diff(o) - length + 1)
        inside = np.zeros(len(m) + 1, np.int32)
        some = count > 0
        np.add.at(inside, begin[some], 1)
        np.add.at(inside, (begin + count)[some], -1)
        inside = np.cumsum(inside[:-1]) > 0
        new = np.empty(len(m), bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        new[begin[some]] = True
        new[1:] |= inside[1:] != inside[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(m)))
        ok = inside[start]
        start, size = start[ok], size[ok]
        if size.max(initial=0) > RUN:  # long runs of periodic text
            k = -(-size // RUN)
            base = np.repeat(start, k)
            step = np.arange(len(base)) - np.repeat(np.cumsum(k) - k, k)
            left = np.repeat(size, k) - step * RUN
            start, size = base + step * RUN, np.minimum(left, RUN)
        doc = np.searchsorted(o, start, side="right") - 1
        out.append((doc + i, start - o[doc], size, m[start]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def code_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2**32 + 32 bits: what is exchanged of an anchor."""
    h = mix(anchor)
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) + (h & np.uint64(0xFFFFFFFF))


# ------------------------------------------------------------- exchange of anchors
def _send(buckets: int, length: int = LENGTH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, _, _, anchor = runs(*text_bytes(part.column(1)), length)
                if not len(doc):
                    continue
                code = code_of(anchor, buckets)
                distinct, who = np.unique(ids, return_inverse=True)
                order = np.lexsort((who[doc], code))
                code, owner = code[order], who[doc][order]
                keep = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
                code, owner = code[keep], owner[keep]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                n = np.diff(np.append(first, len(code)))
                many = np.repeat(n > 1, n)
                out = {"bucket": [], "ids": [], "codes": [], "owners": []}
                # anchors that several documents of the pack hold are known to be shared
                by = np.argsort(owner[many], kind="stable")
                known = code[many][by]
                cut = np.searchsorted(owner[many][by], np.arange(len(distinct) + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    out["bucket"].append(-1)
                    out["ids"].append(distinct[k : k + 1].tobytes())
                    out["codes"].append(known[cut[k] : cut[k + 1]].tobytes())
                    out["owners"].append(None)
                lone = np.where(n > 1, -1, owner[first]).astype(np.int16)
                code = code[first]
                cut = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    used, local = np.unique(lone[s], return_inverse=True)
                    table = np.where(used < 0, 0, distinct[used])
                    out["bucket"].append(int(k))
                    out["ids"].append(table.tobytes())
                    out["codes"].append(code[s].astype(np.uint32).tobytes())
                    out["owners"].append(np.where(lone[s] < 0, -1, local).astype(np.int16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("ids", "codes", "owners"))], names=["bucket", "ids", "codes", "owners"])

    return run


def _meet(f: pd.DataFrame) -> pd.DataFrame:
    """A bucket: (id, shared codes) of documents that alone in their pack hold a code that other packs have."""
    bucket = np.uint64(f["bucket"].iloc[0])
    codes = [np.frombuffer(x, np.uint32) for x in f["codes"]]
    every, inverse, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    shared = np.split(n[inverse] > 1, np.cumsum([len(c) for c in codes])[:-1])
    rows = []
    for ids, code, owner, ok in zip(f["ids"], codes, f["owners"], shared, strict=True):
        ids, owner = np.frombuffer(ids, np.int64), np.frombuffer(owner, np.int16)
        ok = ok & (owner >= 0)
        code, owner = code[ok], owner[ok]
        by = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[by], np.arange(len(ids) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            rows.append((int(ids[k]), ((bucket << np.uint64(32)) + code[by[cut[k] : cut[k + 1]]].astype(np.uint64)).tobytes()))
    return pd.DataFrame(rows, columns=["id", "codes"])


def _pieces(buckets: int, length: int):
    """Runs with a shared anchor: (anchor, id, th, first window, hash of the piece, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data, off = text_bytes(part.column(2))
                doc, start, size, anchor = runs(data, off, length)
                if not len(doc):
                    continue
                code = code_of(anchor, buckets)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keep = np.zeros(len(doc), bool)
                for r, lists in enumerate(part.column(3).to_pylist()):
                    s = slice(cut[r], cut[r + 1])
                    keep[s] = np.isin(code[s], np.concatenate([np.frombuffer(x, np.uint64) for x in lists]))
                doc, start, size, anchor = doc[keep], start[keep], size[keep], anchor[keep]
                if not len(doc):
                    continue
                a = off[doc] + start
                n = size + length - 1
                flat = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                text = data[flat]
                ends = np.concatenate([[0], np.cumsum(n)])
                pos = np.arange(len(text)) - np.repeat(ends[:-1], n)
                h = mix(np.add.reduceat(mix(text.astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(8))), ends[:-1]) + n.astype(np.uint64))
                take = pa.array(doc)
                piece = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(start), pa.array(h.view(np.int64)), piece], names=["key", "id", "th", "start", "h", "piece"])

    return run


# ------------------------------------------------------------- suffix arrays
def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """All suffixes in order (of their first ``depth`` bytes at least, if given). Larsson-Sadakane: groups of equal
    prefixes carry their last place as rank; only groups that still have several members are sorted
    again, by the rank of the suffix h bytes on, and h doubles."""
    n = len(text)
    x = loads(text, ">u8")
    sa = np.argsort(x)
    rank = np.empty(n, np.int64)

    def ranks(new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """base: the places that the sorted suffixes hold; a group's rank is its last place."""
        last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
        return np.repeat(base[last], np.diff(last, prepend=-1))

    if not n:
        return sa
    x = x[sa]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    places = np.arange(n)
    rank[sa] = ranks(new, places)
    h = 8
    while depth is None or h < depth:  # places of groups with several members
        places = places[~(new & np.append(new[1:], True))]
        if not len(places):
            break
        members = sa[places]
        nxt = members + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], n - 1 - nxt)  # of two that end, the shorter first
        both = rank[members] * (n + h) + (second + h)  # the group, then the rank: one number, at most n (n + h)
        order = np.argsort(both)
        members, both = members[order], both[order]
        sa[places] = members
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[members] = ranks(new, places)
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, begin: np.ndarray, cap: int) -> np.ndarray:
    """lcp[k]: common bytes of the suffixes at places k - 1 and k, at most ``cap``. Neighbours
    are compared eight bytes at a time, those that still agree go on; prefixes may pass the
    ends of pieces (``begin``), as suffixes do."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    x = np.append(loads(text), np.uint64(0))
    todo = np.arange(1, n)
    a, b = sa[:-1], sa[1:]
    for at in range(0, cap, 8):
        differ = x[np.minimum(a + at, n)] ^ x[np.minimum(b + at, n)]
        equal = differ == 0
        low = differ[~equal]
        low &= ~low + np.uint64(1)  # the lowest bit that differs lies in the first byte that does
        lcp[todo[~equal]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        todo, a, b = todo[equal], a[equal], b[equal]
        if not len(todo):
            break
    lcp[todo] = cap
    ends = n - np.maximum(sa[:-1], sa[1:])  # zeros after the end are no bytes
    lcp[1:] = np.minimum(lcp[1:], np.minimum(ends, cap))
    return lcp


def _lists(f: pa.Table, length: int):
    """A shard -> removed intervals, and for spread anchors the strings left."""
    col = f.combine_chunks()
    key = col["key"].to_numpy()
    ids, th, start, h = (col[c].to_numpy() for c in ("id", "th", "start", "h"))
    salted = col["salts"].to_numpy() > 1
    # equal pieces of one anchor are one piece: the smallest id decides
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    data, off = text_bytes(col["piece"].combine_chunks() if isinstance(col["piece"], pa.ChunkedArray) else col["piece"])
    size = np.diff(off)
    n = size[first]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    flat = np.repeat(off[first] - begin, n) + np.arange(n.sum())
    text = data[flat]
    lowest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(lowest, inverse, ids)
    sa = suffix_array(text, length)
    lcp = common_prefixes(text, sa, begin, length)
    piece = np.repeat(np.arange(len(first)), n)
    window = (np.arange(len(text)) - begin[piece]) <= n[piece] - length
    group = np.cumsum(lcp < length) - 1  # by place
    of = np.empty(len(text), np.int64)
    of[sa] = group
    smallest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, of[window], lowest[piece[window]])
    # pieces whose id isn't the smallest that holds the whole piece are removed whole
    whole = ids > lowest[inverse]
    out = [(ids[whole], th[whole], start[whole], size[whole])]
    mine = np.flatnonzero(~whole)
    p = inverse[mine]
    wins = n[p] - length + 1
    row = np.repeat(mine, wins)
    step = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    at = begin[inverse[row]] + step
    gone = smallest[of[at]] < ids[row]
    # maximal runs of removed windows
    r, s = row[gone], step[gone]
    if len(r):
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
        k = np.flatnonzero(new)
        m = np.diff(np.append(k, len(r)))
        out.append((ids[r[k]], th[r[k]], start[r[k]] + s[k], m + length - 1))
    removed = tuple(np.concatenate(c) for c in zip(*out, strict=True))
    left = np.flatnonzero(~gone & salted[row])
    strings = text[at[left][:, None] + np.arange(length)[None, :]] if len(left) else np.zeros((0, length), np.uint8)
    return removed, (key[row[left]], strings, ids[row[left]], th[row[left]], start[row[left]] + step[left], col["salts"].to_numpy()[row[left]])


SHARD_OUT = "id long, th long, packed long, key long, part int, strings binary, ids binary, ths binary, places binary"


def _shard(length: int):
    def run(f: pa.Table) -> pa.Table:
        (ids, th, start, size), (key, strings, i2, t2, p2, salts) = _lists(f, length)
        n = len(ids)
        cols = {"id": ids.tolist(), "th": th.tolist(), "packed": (start * 256 + size - length).tolist(), "key": [None] * n, "part": [None] * n, "strings": [None] * n, "ids": [None] * n, "ths": [None] * n, "places": [None] * n}
        if len(key):
            part = (string_hashes(strings) % salts.astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, key))
            bound = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])]))
            for a, b in zip(bound, np.append(bound[1:], len(order)), strict=True):
                o = order[a:b]
                s = np.ascontiguousarray(strings[o]).view(f"S{length}").ravel()
                o = o[np.argsort(s, kind="stable")]
                for c, v in (("id", None), ("th", None), ("packed", None), ("key", int(key[o[0]])), ("part", int(part[o[0]])), ("strings", strings[o].tobytes()), ("ids", i2[o].tobytes()), ("ths", t2[o].tobytes()), ("places", p2[o].tobytes())):
                    cols[c].append(v)
        types = {"id": pa.int64(), "th": pa.int64(), "packed": pa.int64(), "key": pa.int64(), "part": pa.int32()}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in cols.items()})

    return run


def string_hashes(strings: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes, over all of it."""
    h = np.zeros(len(strings), np.uint64)
    for k in range(0, strings.shape[1], 8):
        eight = np.zeros((len(strings), 8), np.uint8)
        eight[:, : strings.shape[1] - k] = strings[:, k : k + 8]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + eight.view("<u8").ravel() + np.uint64(k + 1))
    return h


def merge_sorted(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of all shards with their smallest id: lists are merged two by
    two, the smaller placed in the larger by binary search, so that a string is moved
    once per halving and not once per list."""
    merged = []
    for strings, ids in lists:
        first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
        merged.append((strings[first], np.minimum.reduceat(ids, first)))
    while len(merged) > 1:
        merged.sort(key=lambda x: len(x[0]))
        merged = [_merge_two(*merged[i : i + 2]) if i + 1 < len(merged) else merged[i] for i in range(0, len(merged), 2)]
    return merged[0]


def _merge_two(small: tuple[np.ndarray, np.ndarray], large: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    (s, low), (every, least) = small, large
    at = np.searchsorted(every, s)
    known = np.zeros(len(s), bool)
    inside = at < len(every)
    known[inside] = every[at[inside]] == s[inside]
    least = least.copy()
    least[at[known]] = np.minimum(least[at[known]], low[known])
    return np.insert(every, at[~known], s[~known]), np.insert(least, at[~known], low[~known])


def _merge(length: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        lists = [(np.frombuffer(s, f"S{length}"), np.frombuffer(i, np.int64)) for s, i in zip(f["strings"], f["ids"], strict=True)]
        every, least = merge_sorted(lists)
        out = []
        for (s, ids), th, place in zip(lists, f["ths"], f["places"], strict=True):
            gone = least[np.searchsorted(every, s)] < ids
            out.append((ids[gone], np.frombuffer(th, np.int64)[gone], np.frombuffer(place, np.int64)[gone] * 256))
        ids, th, packed = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"id": ids, "th": th, "packed": packed})

    return run


def removed_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(id, th, text) with ids not null -> (id, th, packed): removed intervals as
    first byte * 256 + bytes - length."""
    spark = docs.sparkSession
    buckets = pieces(docs, 16 << 20, least=16)
    sent = stage(docs.select("id", "text").mapInArrow(_send(buckets, length), "bucket int, ids binary, codes binary, owners binary"), "repeats-sent")
    far = sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_meet, "id long, codes binary")

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": [int(np.frombuffer(x, np.int64)[0]) for x in f["ids"]], "codes": f["codes"].tolist()}, columns=["id", "codes"])

    near = sent.where("bucket < 0").select("ids", "codes").mapInPandas(own, "id long, codes binary")
    shared = stage(far.unionByName(near), "repeats-shared")
    discard(sent)
    release(spark)
    lists = shared.groupBy("id").agg(F.collect_list("codes").alias("codes"))  # at most a few numbers per 16 bytes of one text
    held = docs.join(lists, "id").select("id", "th", "text", "codes")
    held = stage(held.mapInArrow(_pieces(buckets, length), "key long, id long, th long, start long, h long, piece binary"), "repeats-pieces")
    discard(shared)
    release(spark)
    hot = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / (HOT // 2)).cast("long").alias("salts"))
    total = held.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(48, total // SHARD_BYTES)
    dealt = held.join(side(stage(hot, "repeats-hot"), 100_000), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("id", "th", "start"), "salts")), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(_shard(length), SHARD_OUT)
    found = stage(found, "repeats-found")
    discard(held)
    release(spark)
    merged = found.where("strings is not null").select("key", "part", "strings", "ids", "ths", "places").groupBy("key", "part").applyInPandas(_merge(length), "id long, th long, packed long")
    return found.where("id is not null").select("id", "th", "packed").unionByName(merged)


def _cutter(length: int):
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, packed: pd.Series, copies: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, copy in zip(texts, packed, copies, strict=True):
            raw = (t or "").encode()
            n = len(raw)
            if copy:
                rows.append((n, n, 1, b"") if n >= length else (n, 0, 0, raw))
                continue
            if p is None or not len(p):
                rows.append((n, 0, 0, raw))
                continue
            p = np.sort(np.asarray(p, np.int64))
            a = p // 256
            b = np.maximum.accumulate(a + p % 256 + length)
            new = np.concatenate([[True], a[1:] > b[:-1]])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            ends = np.concatenate([[0], b])
            kept = b"".join(raw[x:y] for x, y in zip(ends.tolist(), [*a.tolist(), n], strict=True))
            rows.append((n, int((b - a).sum()), len(a), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row."""
    raw = F.col(text).cast("string")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST))
    d = docs.select(F.col(doc_id).alias("doc_id"), key.alias("id"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    long = d.where(F.octet_length("text") >= length)
    ids = stage(long.select("id", "th", F.sha2("text", 256).alias("sha")), "repeats-ids")
    classes = ids.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = stage(ids.join(classes, "sha").where("id > least").select("id", "th").distinct(), "repeats-copies")
    one = side(copies, 1_000_000).withColumn("copy", F.lit(True))
    packed = removed_intervals(long.join(side(copies, 1_000_000), ["id", "th"], "left_anti").select("id", "th", "text"), length)
    packed = stage(packed.groupBy("id", "th").agg(F.collect_list("packed").alias("packed")), "repeats-packed")  # of one text
    release(docs.sparkSession)
    got = d.join(packed, ["id", "th"], "left").join(one, ["id", "th"], "left")
    return got.select("doc_id", _cutter(length)("text", "packed", F.coalesce("copy", F.lit(False))).alias("__c")).select("doc_id", "__c.*")
