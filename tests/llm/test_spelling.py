import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathweave.llm import spelling as S

from .util import awkward, docs_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, every=31, shortest=7, least=2, ratio=10):
    n = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(rng):
    stems = ["commission", "Élégantes", "aaaaaaa", "aaaaaaaa", "bananas", "÷×÷×÷×÷", "tomorrow", "ÀÀÀÀÀÀÀ"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: 1 + i % len(stems)])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", w[k] * 2, "q", "é"]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("every", [31, 2, 0])
def test_equals_brute_force(spark, every):
    rng = random.Random(every)
    rows = corpus(rng) + awkward(rng) + [(None, "commission " * 3), (None, "comission " * 2), (7, "q" * 20000 + " " + "q" * 19999 + " " + "q" * 20000 + " " + "q" * 19999)] * 2
    assert rows_of(S.spelling_forms(docs_of(spark, rows), every=every)) == brute(rows, every)


def test_chains_and_ties(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "zbcdefg": 10, "yyyyyyy": 5}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(words.items())]
    got = rows_of(S.spelling_forms(docs_of(spark, rows), every=0, least=1))
    assert got == brute(rows, 0, least=1)
    assert [r for r in got if r[0] == "abcdefg"] == [("abcdefg", "abcdefgh", "abcdefghij", 1, 2, 10)]


def test_nothing(spark):
    assert S.spelling_forms(docs_of(spark, [])).count() == 0
    assert S.spelling_forms(docs_of(spark, [(1, None), (2, ""), (3, "short words only")])).count() == 0


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_neighbourhood_is_full(symbols):
    """Each word's keys hold the own key of every word one edit away."""
    rng = random.Random(symbols)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    edited = []
    for w in words:
        k = rng.randrange(len(w) + 1)
        edited.append(rng.choice([w[:k] + "x" + w[k:], w[:k] + "é" + w[k + 1 :], w[:k] + w[k + 1 :] + ("" if k < len(w) else "b")]))
    own, around = S.Reduced(symbols), S.Reduced(symbols)
    own.read(edited)
    around.read(words)
    keys = [set() for _ in words]
    for who, key in around.neighbours():
        for w, k in zip(who.tolist(), key.tolist(), strict=True):
            keys[w].add(k)
    assert all(k in keys[i] for i, k in enumerate(own.own().tolist()) if edited[i])
    assert len(np.unique(own.own())) <= len(set(edited))
