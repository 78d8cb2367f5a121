import random

import pytest

from pathweave.llm import common as C


def brute(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("few", [100_000, 3])
def test_later_edges_join_known_components(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)  # 3: nothing is broadcast
    rng = random.Random(few)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    later = [(rng.randrange(80), rng.randrange(80)) for _ in range(25)] + [(70, 70)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    known = C.components(frame(first), "c")
    got = C.components(frame(later), "c", known).collect()
    every = [(a, b) for a, b in first + later if a != b]
    assert sorted((r.node, r.label) for r in got) == sorted(brute(every).items())
    # no new edge, or only such as lie within components: nothing changes
    again = C.components(frame([(a, b) for a, b in first]), "c", known).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, known.collect()))


def test_small_graph_is_broadcast(spark, monkeypatch):
    kinds = []
    staged = C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: (kinds.append(df._jdf.queryExecution().optimizedPlan().toString()), staged(df, name))[1])
    C.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"), "c")
    assert "strategy=broadcast" in kinds[2] and len(kinds) > 2
