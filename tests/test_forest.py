"""Whole trees in a task give what the distributed operators give."""

import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators import forest as W
from pathweave.operators import trees as T

SCHEMA = "tree_id long, node_id string, parent_id string, child_idx int, kind string, token string"
KINDS = ("Word", "NameExpr", "Flag", "Status", "AssignExpr", "ArgumentList", "Comment")


def random_nodes(seed=5, trees=12):
    rng, rows = random.Random(seed), []
    for t in range(trees):
        rows.append((t, "r", None, 0, "Order", None))
        rows += [(t, "r/00", "r", 0, "NameExpr", name) for name in ("someName", "other|one")[: 1 + t % 2]]  # a leaf id may repeat
        ids, kids = ["r"], {}
        for _ in range(rng.choice([3, 25, 60])):
            p = ids[-1] if rng.random() < 0.3 else rng.choice(ids)
            k = kids[p] = kids.get(p, 0) + 1
            ids.append(f"{p}/{k:03d}")
            rows.append((t, ids[-1], p, k, rng.choice(KINDS), rng.choice(["a", "b c", "urgent", "HIGH", "x9", "null", "", None, "\U0001F600"])))
    rows += [(99, "r", None, 0, "Order", None), (None, "r", None, 0, "Word", "a"), (None, "r/0", "r", 0, "Word", "b"), (3, None, "r", 4, "Word", "c")]
    rows += [(50, "r", None, 0, "Order", None)] * 2 + [(50, "r/1", "r", 1, "Word", "a")]  # an inner id that repeats
    rng.shuffle(rows)
    return rows


class Names:
    def __init__(self, n, whole):
        self.lv = T.cs_leaves(T.ancestor_chains(n, limit=8, whole=whole), "Order", ("Word", "NameExpr"), ("Flag", "Status"), ("Order",), whole=whole)
        self.vars = T.variables(self.lv, whole)


def contexts(n, whole):
    c = Names(n, whole)
    cols = ("tree_id", "lhs", "rhs", "lvar", "rvar", "ltok", "rtok", "a_id", "kl", "kr", "is_self", "path", "context")
    return T.cs_contexts(T.cs_leaf_pairs(c.lv, c.vars, 7, 4, whole, cols, 20), c.vars, 20, whole=whole).select(*cols)


def drawn(n, whole):
    c = Names(n, whole)
    big = T.pair_count_small(c.vars, 20, whole).filter(~F.col("small"))
    names = big if whole else c.vars.join(big.select("tree_id"), "tree_id", "left_semi")
    return T.variable_pairs(names, 20, whole=whole)


def texts(n, whole):
    c = Names(n, whole)
    return T.cs_path_texts(c.lv, c.vars, 7, 4, 20, whole=whole)


def lines(n, whole):
    return T.unit_lines(T.ancestor_chains(T.with_piece_hashes(n, whole=whole), limit=6, whole=whole), "Order", 5, 2, whole)


def hashed_pairs(n, whole):
    return T.leaf_pairs(T.ancestor_chains(T.with_piece_hashes(n, 3, whole=whole), whole=whole), "Order", 6, 3, 3, whole=whole)


JOBS = {
    "leaves": lambda n, whole: T.leaf_ordinals(T.leaves(n, whole=whole), whole).select("tree_id", "node_id", "ord"),
    "siblings": lambda n, whole: T.sibling_position(n, whole).select("tree_id", "node_id", "sib"),
    "chains": lambda n, whole: T.ancestor_chains(n, whole=whole),
    "chains of 2": lambda n, whole: T.ancestor_chains(n, limit=2, whole=whole),
    "variables": lambda n, whole: Names(n, whole).vars,
    "pairs": lambda n, whole: T.leaf_pairs(T.ancestor_chains(n, whole=whole), "Order", 5, 2, whole=whole),
    "hashed pairs": hashed_pairs, "contexts": contexts, "drawn": drawn, "texts": texts, "lines": lines,
}


def rows_of(df):
    return sorted((repr([r[c] for c in sorted(df.columns)]) for r in df.collect()))


# ids that repeat or are null number in any order: these compare without them
def plain(df, name):
    if name in ("chains", "chains of 2"):
        return df
    return df.filter("tree_id is not null and tree_id % 2 = 0 and tree_id <> 50")


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nodes") / "n")
    spark.createDataFrame(random_nodes(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", list(JOBS))
def test_whole_trees_equal_the_distributed_way(nodes, name):
    want = rows_of(plain(JOBS[name](nodes, False), name))
    assert want
    assert rows_of(plain(T.by_tree(nodes, JOBS[name]), name)) == want


def test_large_trees_go_the_distributed_way(spark, nodes):
    seen = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # sizes are told between batches

    def job(n, whole):
        seen.append((whole, {r[0] for r in n.select("tree_id").distinct().collect()}))
        return JOBS["pairs"](n, whole)

    try:
        got = rows_of(plain(T.by_tree(nodes, job, large=30), "pairs"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rows_of(plain(JOBS["pairs"](nodes, False), "pairs"))
    whole, rest = (dict(seen)[w] for w in (True, False))
    assert whole and not whole & rest and {None, 50} < rest


def test_closure_of_whole_trees(nodes):
    n = nodes.filter("tree_id is not null and node_id is not null and tree_id % 2 = 0 and tree_id <> 50")
    assert rows_of(T.by_tree(n, T.subtree_closure)) == rows_of(T.subtree_closure(n))


def test_whole_trees_need_no_shuffle_after_packing(nodes):
    for name in JOBS:
        if name != "chains of 2":
            packed = W.packed(nodes.filter("tree_id <> 50"))
            n = packed.filter("whole").select(F.explode("nodes").alias("n")).select("n.*")
            plan = JOBS[name](n, True)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan, name


def test_cycles_in_whole_trees_are_reported(spark):
    n = spark.createDataFrame([(1, "a", "b", 0, "K", None), (1, "b", "a", 0, "K", None)], SCHEMA)
    with pytest.raises(Exception, match="cycle"):
        T.by_tree(n, lambda x, whole: T.ancestor_chains(x, whole=whole)).collect()


def test_names_come_with_their_leaves(spark):
    """the leaves of a name were only counted."""
    rows = [(1, "r", None, 0, "Order", None), (1, "r/0", "r", 0, "NameExpr", "unit"), (1, "r/1", "r", 1, "Word", "a"), (1, "r/2", "r", 2, "Flag", "N"), (1, "r/3", "r", 3, "Word", "a")]
    n = spark.createDataFrame(rows, SCHEMA)
    for whole in (False, True):
        job = lambda x, w: Names(x, w).vars
        got = (T.by_tree(n, job) if whole else job(n, False)).orderBy("first_ord").collect()
        assert [(r.var, r.leaves, r.n_leaves) for r in got] == [("METHOD_NAME", ["r/0"], 1), ("a", ["r/1", "r/3"], 2), ("N", ["r/2"], 1)]
