import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.llm import collocations as C

from .util import awkward, docs_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for r in rows:
        text, lang = r[1], (r[2] if len(r) > 2 else None) or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        inside = {}
        for p, a in cand.items():
            for s in range(len(p)):
                for e in range(s + 2, len(p) + 1):
                    if e - s < len(p):
                        inside[p[s:e]] = max(inside.get(p[s:e], 0), a)
        got = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(rng, n=60):
    words = ["The", "of", "new", "york", "city", "été", "É", "a-b", "x\x00y", "日本", " ", "NEW"]
    fixed = ["new york city of the", "hot dog", "Hot\t dog", "une  ÉTÉ chaude"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "".join(p + rng.choice([" ", ". ", "\n", "\r\n", ",", "\v", "  ", "\t"]) for p in parts), rng.choice(["en", "fr", None, "und", "en", "en"])))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = corpus(rng) + [(*r, "en") if i % 2 else (*r, None) for i, r in enumerate(awkward(rng))]
    for least, top in ((3, 2000), (8, 5)):
        assert rows_of(C.collocations(docs_of(spark, rows), least, top=top)) == brute(rows, least, top=top)


def test_collisions_are_told_apart_by_text(spark):
    rows = corpus(random.Random(2), 40)
    for mask in (0x3F, 0x7):
        assert rows_of(C.collocations(docs_of(spark, rows), 3, mask=mask)) == brute(rows, 3)


def test_nothing_and_little(spark):
    assert C.collocations(docs_of(spark, []), 1).count() == 0
    assert C.collocations(docs_of(spark, [(1, None, "en"), (2, " .. \n", None)]), 1).count() == 0
    rows = [(1, "a b", "en")]
    assert rows_of(C.collocations(docs_of(spark, rows), 1)) == brute(rows, 1) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_score_beyond_64_bits(spark):
    f = spark.range(1).select(F.lit(4 * 10**14).alias("a"), F.lit(9 * 10**15).alias("n"), F.lit(5 * 10**14).alias("l"), F.lit(4 * 10**14).alias("r"))
    wide = "cast({} as decimal(38,0))".format
    got = f.select(F.expr(f"({wide(f'1000 * {wide('a')}')} * {wide('n')}) div ({wide('l')} * {wide('r')})").alias("s")).first().s
    assert got == 1000 * 4 * 10**14 * 9 * 10**15 // (5 * 10**14 * 4 * 10**14)


@pytest.mark.parametrize("window", [64, 700, 1 << 20])
def test_windows_of_a_long_text_change_nothing(monkeypatch, window):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "c.", "dd\n", "e" * rng.randrange(1, 90)]) for _ in range(800)), "", "a bb a bb", None, "z" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(texts), pa.array(range(5), pa.int64())], names=["lang", "text", "doc"])

    def counts(n):
        total = Counter()
        for b in C._count(n, None, int(C.ALL))([batch]):
            for r in b.to_pylist():
                total[r["fp"]] += r["c"]
                assert r["lo"] == r["hi"]
        return total

    def pointers():
        known = [C.Screen(np.full(4096, 255, np.uint8), 15)] * 3  # all pass
        found = [set(), set(), set()]
        for b in C._point(known, known, int(C.ALL))([batch]):
            for r in b.to_pylist():
                at, size = r["place"] >> 32, r["place"] & 0xFFFFFFFF
                assert len(texts[r["doc"]].encode()[at : at + size].split()) == r["words"]
                assert r["fp"] not in found[r["words"] - 1]
                found[r["words"] - 1].add(r["fp"])
        return found

    assert [set(counts(n)) for n in (1, 2, 3)] == pointers()
    want = {n: counts(n) for n in (1, 2, 5)}
    monkeypatch.setattr(C, "WINDOW", window)
    assert [set(counts(n)) for n in (1, 2, 3)] == pointers()
    assert {n: counts(n) for n in (1, 2, 5)} == want
    assert sum(want[1].values()) == sum(len(re.split(r"[\s.]+", (t or "").strip(" .\n"))) for t in texts if t)
