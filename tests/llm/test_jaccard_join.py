import random
import re

import pytest

from pathweave.llm import jaccard_join as J

from .util import awkward, docs_of, prose


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent):
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted((str(i), len(sets[x]), str(least.get(find(x), i))) for x, (i, _) in enumerate(rows))


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 150))) for i in range(50)]
    for base in range(8):
        words = prose(rng, rng.choice([12, 60, 200, 600])).split()
        rows += [(1000 + 100 * base + i, near(rng, words, rng.choice([0, 1, 1, 2, 5]))) for i in range(20)]
    passage = prose(rng, 60)
    rows += [(3000 + i, prose(rng, rng.choice([5, 40])) + " " + passage) for i in range(60)]
    rows += [(4000, "a b c"), (4001, "A  B\tC"), (4002, "a b"), (4003, "a b c d"), (4004, "a b c d")]
    return rows + [(i, t) for i, t in awkward(rng) if i is not None and i != 6]


@pytest.mark.parametrize("k,percent,light_below", [(4, 85, None), (4, 85, 1), (4, 85, 10**6), (5, 80, None), (4, 85, 60)])
def test_components_equal_brute_force(spark, k, percent, light_below):
    rows = corpus(k)
    got = J.jaccard_components(docs_of(spark, rows), shingle=k, percent=percent, light_below=light_below).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, percent)


def test_nulls_repeats_empty(spark):
    rng = random.Random(9)
    t = prose(rng, 50)
    got = J.jaccard_components(docs_of(spark, [(3, t), (3, t), (None, t), (7, t), (None, "alone here"), (8, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("7", "3"), ("8", "8"), ("None", "3"), ("None", "3")] or sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("7", "3"), ("8", "8"), ("None", "3"), ("None", "None")]
    assert J.jaccard_components(docs_of(spark, [])).count() == 0


def test_verified_links(spark):
    rng = random.Random(4)
    words = prose(rng, 100).split()
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, near(rng, words, 1)), (4, prose(rng, 100))]
    got = {r.doc_id: r.n_verified_links for r in J.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("k,percent,short,long", [(4, 85, 9, 10), (5, 80, 8, 9)])
def test_pairs_of_least_sizes_link(spark, k, percent, short, long):
    # 6 of 7 shingles at 85, 4 of 5 at 80: the shorter text's prefix has one shingle, the longer one's three
    rows = []
    for i in range(30):
        words = [f"x{i}y{j}" for j in range(long)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:short] if i % 2 else words[long - short :]))]
    got = J.jaccard_components(docs_of(spark, rows), shingle=k, percent=percent).collect()
    want = brute(rows, k, percent)
    assert all(int(c) % 2 == 0 for *_, c in want)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("percent", [50, 75, 80, 85, 90, 100])
def test_screening_asks_no_more_than_linked_sets_share(percent):
    def prefix(n):
        o = J.least_overlap(n, percent)
        return n - o + min(o, n - o + 1)

    for n in range(1, 120):
        # the worst case: a set's own shingles come before those that it shares
        shared = [max(0, min(prefix(n) - (n - a), prefix(m) - (m - a))) for m in range(1, 2 * n + 1) for a in range(1, min(n, m) + 1) if 100 * a >= percent * (n + m - a)]
        assert J.least_shared(n, percent) == min(shared) >= 1


def test_near_copies_without_links_to_a_centre(spark, monkeypatch):
    # 300 texts two edits from a text that is not there: hardly any two link, all share their rarest shingles
    rng = random.Random(12)
    base = [f"b{i}" for i in range(104)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(104), 2):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    # some pairs differ by one further edit and so link away from every centre
    for i in range(0, 60, 3):
        words = rows[i][1].split()
        words[50] = f"z{i}"
        rows.append((1000 + i, " ".join(words)))
    compared = []
    kept = J.stage
    monkeypatch.setattr(J, "stage", lambda df, name: (lambda got: (compared.append((name, got.count())) if name in ("join-star", "join-across", "join-differences") else None, got)[1])(kept(df, name)))
    got = J.jaccard_components(docs_of(spark, rows)).collect()
    want = brute(rows, 4, 85)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert sum(n for _, n in compared) < 320 * 319 // 2 // 4, compared


def test_difference_keys_only_where_levels_and_components_meet(spark):
    # a and b share entry 1 at level 0; nobody of level 3 has it; entry 2 is known to one component (c, d)
    rows = [("a", "z", 20, False, [1, 7], 0, 1), ("b", "z", 20, False, [1, 8], 0, 1), ("c", "z", 20, False, [2, 9], 3, 1), ("d", "z", 20, False, [2, 10], 3, 1)]
    star = spark.createDataFrame(rows, "sid string, psid string, n int, link boolean, d array<long>, level int, grain int")
    labels = spark.createDataFrame([("c", "c"), ("d", "c")], "node string, label string")
    got = J._difference_keys(star, labels).collect()
    assert sorted((r.sid, r.role) for r in got) == [("a", 0), ("b", 0)] and len({r.key for r in got}) == 1
