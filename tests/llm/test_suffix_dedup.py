import random

import numpy as np
import pytest

from pathweave.llm import suffix_dedup as S

from .util import awkward, docs_of, prose


def brute(rows, length=50):
    """Per row: (id, bytes, removed, spans, kept)."""
    key = lambda i: S.FIRST if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def run(spark, rows, **kw):
    got = S.remove_repeats(docs_of(spark, rows), **kw).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(60)]
    rows += [(100 + i, prose(rng, 20) + " " + passage + " " + prose(rng, rng.randrange(0, 20))) for i in range(60)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows += [(300 + i, rows[i][1][: rng.randrange(30, 90)] + "#" + rows[i + 1][1]) for i in range(20)]
    rows += [(400, "ab" * 300), (401, "ab" * 100 + "c"), (402, "a" * 49), (403, "a" * 50), (404, "a" * 51), (405, "\0" * 120), (406, "\0" * 60 + "é" * 40)]
    rows += [(5, "second text of id 5 " + passage), (300, rows[0][1])]
    return rows + awkward(rng)[:4] + [(None, "null id " + passage), (None, passage + " null id too")]


@pytest.mark.parametrize("hot", [4096, 8])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)  # 8: most shared anchors are spread and merged by binary search
    rows = corpus(hot)
    assert run(spark, rows) == brute(rows)


def test_long_and_empty(spark):
    rng = random.Random(2)
    rows = [r for r in awkward(rng) if r[0] in (5, 6, 9)]
    got = {(i, n, k) for i, n, k, *_ in run(spark, rows)}
    long = len(rows[0][1].encode())
    assert got == {("5", long, 0), ("6", long, long), ("9", 600, 0)}
    assert run(spark, []) == []


@pytest.mark.parametrize("text", [b"banana", b"a" * 100, b"abracadabra" * 9, bytes(range(256)) * 2, b"\0\0\0"])
def test_suffix_array_and_common_prefixes(text):
    t = np.frombuffer(text, np.uint8)
    sa = S.suffix_array(t)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = S.common_prefixes(t, sa, np.array([0, len(text) // 2]), 50)
    for k in range(1, len(text)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 50)


@pytest.mark.parametrize("text", [b"a" * 300, b"abracadabra" * 30, b"\0\0\0a" * 40])
def test_order_as_deep_as_the_strings(text):
    # sorted no deeper than the strings that are compared, and the groups of equal strings are the same
    t, none = np.frombuffer(text, np.uint8), np.array([0])
    whole, part = S.suffix_array(t), S.suffix_array(t, 50)
    assert [text[i : i + 50] for i in part] == [text[i : i + 50] for i in whole]
    assert S.common_prefixes(t, part, none, 50).tolist() == S.common_prefixes(t, whole, none, 50).tolist()


def test_hashes_are_made_in_slices_of_a_cache(monkeypatch):
    rng, seen, loads = random.Random(3), [], S.loads
    monkeypatch.setattr(S, "loads", lambda data, *kind: (seen.append(len(data)), loads(data, *kind))[1])
    texts = [prose(rng, 400).encode() for _ in range(400)]
    off = np.cumsum([0, *map(len, texts)])
    got = S.runs(np.frombuffer(b"".join(texts), np.uint8), off)
    assert len(seen) > 1 and max(seen) <= 1 << 18
    alone = [S.runs(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in texts]
    assert got[0].tolist() == [k for k, r in enumerate(alone) for _ in r[0]]
    assert all(a.tolist() == [x for r in alone for x in r[i].tolist()] for i, a in enumerate(got) if i)


def test_merge_by_binary_search():
    a = np.sort(np.array([b"aa", b"bb", b"bb", b"dd"], "S2"))
    b = np.sort(np.array([b"bb", b"cc"], "S2"))
    s, least = S.merge_sorted([(a, np.array([5, 4, 7, 1])), (b, np.array([2, 9]))])
    assert s.tolist() == [b"aa", b"bb", b"cc", b"dd"] and least.tolist() == [5, 2, 9, 1]


def test_hot_strings_are_dealt_by_all_their_bytes():
    # windows that start in one phrase have the same first bytes, but go to many parts
    rng = np.random.default_rng(1)
    strings = rng.integers(97, 123, (4000, 50)).astype(np.uint8)
    strings[:, :40] = 97
    part = S.string_hashes(strings) % np.uint64(8)
    assert np.bincount(part.astype(int), minlength=8).min() > 400
    assert (S.string_hashes(strings[::-1]) == S.string_hashes(strings)[::-1]).all()
    strings = np.repeat(strings[:1], 50, 0)
    strings[np.arange(50), np.arange(50)] = 65
    assert len(np.unique(S.string_hashes(strings))) == 50


def test_shard_spreads_strings_of_one_phrase():
    import pyarrow as pa

    rng = random.Random(6)
    pieces = [b"a phrase of forty bytes that repeats here: " + bytes(rng.randrange(97, 123) for _ in range(7)) for _ in range(200)]
    n = len(pieces)
    shard = pa.table({"key": [7] * n, "id": list(range(n)), "th": list(range(n)), "start": [0] * n, "h": list(range(n)), "piece": pa.array(pieces, pa.binary()), "salts": [4] * n})
    out = S._shard(50)(shard).to_pydict()
    parts = {p: len(s) // 50 for p, s in zip(out["part"], out["strings"]) if s is not None}
    assert sorted(parts) == [0, 1, 2, 3] and sum(parts.values()) == n and max(parts.values()) < n // 2


@pytest.mark.parametrize("length", [30, 80])
def test_other_lengths_equal_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(S, "HOT", 8)
    rng = random.Random(length)
    header = "from the header of one source: "
    rows = [(i, header + prose(rng, 6, 10**6)) for i in range(40)]
    shared = prose(rng, 12, 10**6)[:length]
    rows += [(100 + i, prose(rng, 5, 10**6) + shared + prose(rng, 5, 10**6)) for i in range(10)]
    assert run(spark, rows, length=length) == brute(rows, length)
