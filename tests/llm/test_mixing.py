import random
import re

import numpy as np

from pathweave.llm import mixing as M

from .util import awkward, docs_of, prose


def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        q = [(v / (2 * g + 1), -i) for i, (v, g, c) in enumerate(zip(votes, got, caps)) if g < c and v > 0]
        if not q:
            break
        got[-max(q)[1]] += 1
    return got


def test_closed_form_equals_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 8)
        votes = [rng.choice([0, 1, 5, 5, 10, rng.randrange(1, 1000)]) for _ in range(n)]
        caps = [rng.randrange(0, 40) for _ in range(n)]
        seats = rng.randrange(0, 120)
        assert M.sainte_lague(np.array(votes), seats, np.array(caps)).tolist() == highest_quotients(votes, seats, caps)


def test_water_fill():
    t = M.water_fill(np.array([3.0, 1.0, 2.0]), np.array([10, 100, 100]), 315.0, 2)
    assert np.allclose(t, [20, 295 / 3, 2 * 295 / 3])
    assert np.allclose(M.water_fill(np.array([3.0, 1.0]), np.array([0, 0]), 0.0, 2), 0)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 200)), "en", rng.choice(["b", "a", "a", "a", "Z", "é", None])) for i in range(600)]
    rows += [(*r, "en", "hot") for r in awkward(rng)]
    got = M.mix_sources(docs_of(spark, rows), carry=()).collect()
    again = M.mix_sources(docs_of(spark, rows, 7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = np.array([sum(size(r[1]) for r in rows if r[3] == s) for s in sources])
    w = np.array([(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))])
    target = M.water_fill(w, sizes, 1.5 * sizes.sum(), 2)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(int(a), round(b, 6)) for a, b in zip(sizes, target)}
    for s, t in zip(sizes, target):
        taken = sum(r.taken for r in got if r.source_size == s)
        assert abs(taken - t) <= M.BLOCK * 12
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)


def test_empty_and_wordless(spark):
    assert M.mix_sources(docs_of(spark, [])).count() == 0
    got = M.mix_sources(docs_of(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
