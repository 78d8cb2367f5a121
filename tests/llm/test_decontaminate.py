import random
import re

import pytest

from pathweave.llm import decontaminate as D

from .util import awkward, docs_of, prose


def words(t):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "")).encode().lower().split()


def brute(rows, items):
    out = {}
    for i, t in rows:
        d = words(t)
        for item, b in items:
            b = words(b)
            n, errors = (D.WINDOW, D.ERRORS) if len(b) >= D.WINDOW else (len(b), 0)
            if n < D.LEAST:
                continue
            for p in range(len(d) - n + 1):
                if any(sum(x != y for x, y in zip(d[p : p + n], b[q : q + n])) <= errors for q in range(len(b) - n + 1)):
                    out[i] = min(out.get(i, item), item)
    return out


def corpus():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([4, 7, 8, 10, 13, 14, 25]), 3000)) for i in range(40)] + [(90, None), (91, ""), (92, "w1 w2"), (93, None)]
    items += [(50, items[3][1]), (51, items[3][1])]

    def spoil(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "zzz"
        return " ".join(w)

    rows = [(i, prose(rng, 60, 3000)) for i in range(60)]
    rows += [(100 + i, prose(rng, 20) + " " + spoil(rng.choice(items[:40])[1], rng.randrange(4)).upper() + ", " + prose(rng, 10)) for i in range(120)]
    return rows + awkward(rng)[:4] + [(None, items[5][1] + " " + items[6][1])], items


@pytest.mark.parametrize("side_bytes", [D.SIDE_BYTES, 0])
def test_equals_brute_force(spark, side_bytes):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs_of(spark, rows), bench, side_bytes=side_bytes).collect()
    assert {r.doc_id: r.first_item for r in got} == brute(rows, items)
    assert len(got) == len({r.doc_id for r in got})


def test_masks_lose_nothing():
    from itertools import combinations

    kept = [set(m) for m in D.masks()]
    for wrong in combinations(range(D.WINDOW), D.ERRORS):
        assert any(not set(wrong) & m for m in kept)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs_of(spark, [(1, "a b c d e f g h i j k l m n")]), bench).count() == 0
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert D.decontaminate(docs_of(spark, []), bench).count() == 0
    twice = docs_of(spark, [(1, "a b c d e f g h i j k l m n")] * 2)
    assert [r.doc_id for r in D.decontaminate(twice, bench).collect()] == [1]
