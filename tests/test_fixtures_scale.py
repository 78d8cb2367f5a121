"""Fixtures and text functions beyond the sizes that the small tables reach."""

from pyspark.sql import functions as F

from pathweave.functions import names as N
from pathweave.operators import metrics as M
from pathweave.operators import similarity as SIM
from pathweave.operators import trees as T
from pathweave.sources import dom
from pathweave.sources import fixtures as fx


def unit_of(spark, n):
    return spark.range(1, n + 1).select(
        F.lit(7).cast("long").alias("ex"), F.col("id").cast("int").alias("pos"), F.lit("cust1").alias("grp"),
        F.lit("some|name").alias("target"), F.concat(F.lit("a"), "id").alias("src"), F.lit("T^A_B").alias("path"), F.lit("z").alias("dst"))


def test_a_unit_of_120_contexts_has_distinct_nodes_in_document_order(spark):
    nodes = fx.fx_nodes(spark, "", unit_of(spark, 120))
    assert nodes.count() == nodes.select("node_id").distinct().count() == 2 + 6 * 120
    lines = [r.child_idx for r in nodes.where("kind = 'Line'").orderBy("node_id").collect()]
    assert lines == list(range(1, 121))


def test_path_hash_of_pieces_equals_hash_of_path(spark):
    p = T.leaf_pairs(T.ancestor_chains(fx.fx_nodes(spark, "", unit_of(spark, 12))), "Order")
    got = p.select("path", "path_hash", N.java_string_hash("path").cast("string").alias("whole")).collect()
    assert len(got) > 50 and all(r.path_hash == r.whole for r in got)


def java_hash(s):
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_java_hash_counts_utf16_units(spark):
    words = ["", "a", "a\U0001F600", "\U0001F600b\U0010FFFF", "école", "漢字" * 40, "z" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(N.java_string_hash("w")).collect()] == [java_hash(w) for w in words]
    a, b = N.hash_state(F.lit("x\U0001F600")), N.hash_state("w")
    both = df.select(N.signed_int(N.hash_of_concat(a["h"], b["h"], b["p"])))
    assert [r[0] for r in both.collect()] == [java_hash("x\U0001F600" + w) for w in words]


def test_nearest_words_break_ties_by_word(spark):
    v = spark.createDataFrame([(f"w{i}", [1.0, 1.0]) for i in range(9, -1, -1)] + [("q", [1.0, 1.0]), ("far", [1.0, -1.0])], "word string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0], ["q"])], "qid long, vec array<double>, exclude array<string>")
    for parts in (1, 5):
        got = SIM.nearest(spark, v.repartition(parts), q, 5).orderBy("rank").collect()
        assert [r.word for r in got] == ["w0", "w1", "w2", "w3", "w4"]


def test_accuracy_is_zero_without_any_match(spark):
    preds = spark.createDataFrame([(1, "a|b", 1, "x|y", 0.5), (1, "a|b", 2, "z", 0.4)], "ex long, original string, rank int, word string, score double")
    assert [r.acc for r in M.topk_accuracy(M.first_match_rank(preds), preds, 3).collect()] == [0.0] * 3
    assert [r.acc for r in M.topk_accuracy_by_index(preds, 3).collect()] == [0.0] * 3


def test_cycles_in_trees_are_reported(spark):
    import pytest

    nodes = spark.createDataFrame([(1, "a", "b", 0, "K", None), (1, "b", "a", 0, "K", None)], "tree_id long, node_id string, parent_id string, child_idx int, kind string, token string")
    with pytest.raises(ValueError):
        T.ancestor_chains(nodes, max_rounds=4)


def test_suggestions_join_builds_no_broadcast(spark, tmp_path):
    parts = [(i, f"a{i} b", f"Brand#{i}") for i in range(6)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    preds = fx.fx_preds(spark, str(tmp_path))
    got = {(r.ex, r["rank"]): r.word for r in preds.collect()}
    assert len(got) == 60
    assert got[(2, 1)] == f"a{(2 * 7 + 37) % 6}|b" and got[(2, 3)] == "<PAD_OR_OOV>" and got[(1, 5)] == f"brand#{(35 + 185) % 6}"
    plan = preds._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_nodes_come_in_one_pass_with_a_name_per_target(spark):
    c = unit_of(spark, 4).withColumn("target", F.when(F.col("pos") == 3, "other").when(F.col("pos") == 4, None).otherwise("some|name"))
    nodes = fx.fx_nodes(spark, "", c)
    assert [r.token for r in nodes.where("kind = 'NameExpr'").orderBy("token").collect()] == [None, "other", "some|name"]
    assert nodes.where("kind = 'Order'").count() == 1 and nodes.count() == 1 + 3 + 6 * 4
    assert "Union" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_chains_are_built_from_inner_nodes_and_stored_as_columns(spark, tmp_path):
    import os

    from pathweave.operators import ranking

    kept = []
    was, T.stored = T.stored, lambda df: kept.append(df.count()) or ranking.stored(df)
    try:
        c = T.ancestor_chains(fx.fx_nodes(spark, "", unit_of(spark, 10)))
        up = {r.node_id: [x.node_id for x in r.up] for r in c.collect()}
    finally:
        T.stored = was
    assert max(kept) == 1 + 2 * 10  # the root, lines and parts; no leaves
    assert up["r"] == [] and up["r/017/2/1"] == ["r/017/2", "r/017", "r"] and len(up) == 62
    out = ranking.stored(c.select("tree_id", "up"))
    assert out.inputFiles() and all(f.endswith(".zstd.parquet") for f in out.inputFiles()) and out.count() == 62


def test_lines_of_the_roles_are_built_once(spark, monkeypatch):
    from pathweave.plans import q_dataset as Q

    ctx = unit_of(spark, 3).unionByName(unit_of(spark, 2).withColumn("ex", F.lit(8).cast("long")).withColumn("grp", F.lit("cust2")))
    calls = []
    monkeypatch.setattr(Q.fx, "fx_ctx", lambda *a: calls.append(1) or ctx)
    out = Q.q_union_outputs(spark, "")
    assert sum(r.n for r in out.collect()) == 2 and len(calls) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Range" not in plan


def test_page_nodes_come_in_bounded_slices_and_whole(spark):
    import pyarrow as pa

    class Pages:  # hands out the task's function
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    html = "<html>" + "<p>a</p>" * 300 + "</html>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(100)) + [None], "html": [html] * 99 + [None, html]}, schema=pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    out = list(dom.page_nodes(Pages())(iter([pages, pages])))
    assert max(b.num_rows for b in out) <= dom.SLICE_ROWS and len(out) > 4
    got = spark.createDataFrame([tuple(r.values()) for r in pages.to_pylist()], "page_id long, html string")
    rows = dom.page_nodes(got).groupBy("page_id").agg(F.count("node_id").alias("n"), F.max("error").alias("e")).collect()
    assert sorted(((r.page_id is None, r.page_id, r.n, r.e) for r in rows), key=str) == sorted(
        [(i is None, i, 0 if i == 99 else 602, "ValueError: empty page" if i == 99 else None) for i in [*range(100), None]], key=str)


def test_leaves_of_chains_need_no_join_of_rows_with_chains(spark):
    nodes = spark.createDataFrame([(1, "r", None, 0, "Order", None), (1, "r/0", "r", 0, "Word", "a"), (1, "r/1", "r", 1, "Part", "p"),
                                   (1, "r/1/0", "r/1", 0, "Word", "b"), (1, None, "r", 2, "Word", "c"), (None, "q", None, 0, "Word", "d")],
                                  "tree_id long, node_id string, parent_id string, child_idx int, kind string, token string")
    chains = T.ancestor_chains(nodes, limit=1)
    got = T.leaves(chains)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") == 1  # that of the chains
    assert sorted(r.token for r in got.collect()) == sorted(r.token for r in T.leaves(nodes).collect()) == ["a", "b", "c", "d"]
    assert {r.token: [u.kind for u in r.up] for r in got.collect()} == {"a": ["Order"], "b": ["Part"], "c": ["Order"], "d": []}


def test_leaf_pairs_by_blocks_of_child_indices(spark):
    rows = [(1, "r", None, 0, "Order", None)] + [(1, f"r/{i:03}", "r", i, "Word", f"w{i}") for i in range(60)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id string, parent_id string, child_idx int, kind string, token string")
    for width in (1, 2, 5):
        p = T.leaf_pairs(T.ancestor_chains(nodes), "Order", 4, width)
        got = sorted((r.l, r.r) for r in p.collect())
        assert got == sorted((f"r/{i:03}", f"r/{j:03}") for i in range(60) for j in range(i + 1, min(60, i + width + 1)))
    assert "floor" in p._jdf.queryExecution().optimizedPlan().toString().lower()  # blocks, no row per allowed width


def test_type_arguments_store_their_two_kinds_only(spark, monkeypatch):
    from pathweave.plans import q_trees as Q

    seen = []
    monkeypatch.setattr(Q, "stored", lambda df: seen.append((df.columns, {r.kind for r in df.select("kind").distinct().collect()})) or df)
    monkeypatch.setattr(Q.fx, "fx_nodes", lambda *_: nodes_of(spark))
    got = {(r.node_id, r.generic) for r in Q.q_is_generic_parent(spark, "").collect()}
    assert got == {("r/1", True), ("r/2", False)}
    assert seen == [(["tree_id", "node_id", "parent_id", "kind"], {"Part", "Word"})]


def nodes_of(spark):
    rows = [("r", None, 0, "Order", None), ("r/1", "r", 1, "Part", None), ("r/1/0", "r/1", 0, "Word", "a"), ("r/1/1", "r/1", 1, "Word", "b"), ("r/2", "r", 2, "Part", None), ("r/2/0", "r/2", 0, "Flag", "N")]
    return spark.createDataFrame([(1, *r) for r in rows], "tree_id long, node_id string, parent_id string, child_idx int, kind string, token string")


def test_first_places_of_words_need_no_sort(spark, monkeypatch):
    from pathweave.plans import q_dataset as Q

    words = [(1, 2, 1, "b"), (1, 1, 7, "a"), (1, 1, 3, "a"), (1, 1, 70000, "b"), (None, 3, 2, "a"), (None, 2**31 - 1, 5, "c"), (None, 2, 2**31 - 1, "a"), (1, 1, 3, "a")]
    monkeypatch.setattr(Q.fx, "fx_words", lambda *_: spark.createDataFrame(words, "doc_id long, line_no int, pos int, w string"))
    out = Q.q_unique_in_order(spark, "")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(d, w, *min((x, p) for i, x, p, v in words if (i, v) == (d, w))) for d, _, _, w in words}
    assert {tuple(r) for r in out.collect()} == want and dict(out.dtypes)["first_pos"] == "int"
