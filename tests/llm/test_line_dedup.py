import random

from pathweave.llm import line_dedup as L

from .util import awkward, docs_of, prose


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    """(id, text) distinct by id -> text kept."""
    order = lambda i: (i is not None, i)
    lines = [((order(i), k), L.normal(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [(o, x) for o, x in lines if len(x) >= L.LEAST]
    first = {}
    for o, x in lines:
        first[x] = min(first.get(x, o), o)
    drop = {o for o, x in lines if first[x] < o}
    drop |= {o for x, o in first.items() if any(p < o and x != y and one_edit(x, y) for y, p in first.items())}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (order(i), k) not in drop) for i, t in rows}


def corpus():
    rng = random.Random(8)
    lines = [prose(rng, rng.randrange(2, 12)) for _ in range(60)] + ["aaaaaaaaaaaaaaaa", "short", "line number 1 of many", "école élève naïve"]

    def edit(x):
        p, c = rng.randrange(len(x)), rng.choice("abcé ")
        return rng.choice([x, x, x.upper(), "  " + x.replace(" ", "   "), x[:p] + c + x[p:], x[:p] + x[p + 1 :], x[:p] + c + x[p + 1 :], x[:p] + x[p + 2 :]])

    rows = [(i, "\n".join(edit(rng.choice(lines)) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(500 + i, f"line number {i} of many\nline numbers {i} of many") for i in range(30)]
    return rows + [(None, lines[0] + "\nnull"), (900, None), (901, ""), (902, "\n\n"), (903, "a" * 15), (904, "a" * 17)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = L.dedup_lines(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_columns_repeats_long_empty(spark):
    rng = random.Random(1)
    rows = [r for r in awkward(rng) if r[0] in (5, 6, 8, 10)]
    df = docs_of(spark, rows)
    got = L.dedup_lines(df)
    assert got.columns == [*df.columns, "__n_removed"]
    text = {(r.doc_id, r.text) for r in got.collect()}
    assert (5, rows[0][1]) in text and (6, "") in text and len(text) == 4
    assert L.dedup_lines(docs_of(spark, [])).count() == 0
