"""Tree queries on fx_nodes (Java rules; limits: length 5, width 2)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.names import JAVA_CHILD_ID_PARENTS, maybe_hash_path
from ..operators import trees as T
from ..operators.ranking import stored
from ..sources import fixtures as fx
from ..sources.tables import table
from . import sqlfn as S
from .oracle_fixtures import with_fx
from .registry import register

UNIT = "Order"
LMAX, WMAX = 5, 2
SET_SQL = "[" + ", ".join(f"'{k}'" for k in JAVA_CHILD_ID_PARENTS) + "]"

PATH_SQL = f"""(array_to_string(list_transform(range(kl), lambda i: '(' || kinds_l[i + 1] ||
   CASE WHEN i = 0 OR list_contains({SET_SQL}, kinds_l[i + 2]) THEN cast(cis_l[i + 1] AS varchar) ELSE '' END || ')^'), '')
 || '(' || kinds_l[kl + 1] || CASE WHEN list_contains({SET_SQL}, coalesce(kinds_l[kl + 2], ''))
      THEN cast(cis_l[kl + 1] AS varchar) ELSE '' END || ')'
 || array_to_string(list_transform(range(kr - 1, -1, -1), lambda i: '_(' || kinds_r[i + 1] ||
   CASE WHEN i = 0 OR list_contains({SET_SQL}, kinds_r[i + 1]) THEN cast(cis_r[i + 1] AS varchar) ELSE '' END || ')'), ''))"""


def tq(sql: str, *names: str, extra=None, once=()) -> str:
    return with_fx(sql, *names, extra=extra, recursive=True, once=once)


def _nodes(spark, sf_dir):
    # the node table feeds both sides of the chain joins: materialise it once
    return stored(fx.fx_nodes(spark, sf_dir))


def _by_tree(spark, sf_dir, job):
    return T.by_tree(fx.fx_nodes(spark, sf_dir), job)


CHAIN_COLS = ("tree_id", "node_id", "kind", "token", "childless", "up", "me")


def _chains(n, whole):
    return T.ancestor_chains(n, limit=LMAX + 1, whole=whole, columns=CHAIN_COLS)


def _pairs(spark, sf_dir, *columns):
    return _by_tree(spark, sf_dir, lambda n, whole: T.leaf_pairs(_chains(n, whole), UNIT, LMAX, WMAX, whole=whole, columns=columns))


@register("leaf_predicate", tq("SELECT tree_id, node_id, token FROM tleaves", "tleaves", once=("fx_ctx", "fx_nodes")))
def q_leaf_predicate(spark, sf_dir):
    """Leaves (childless, not comments, non-empty token)."""
    return T.leaves(_nodes(spark, sf_dir)).select("tree_id", "node_id", "token")


@register("leaf_ordinal", tq("""
SELECT tree_id, node_id, cast(row_number() OVER (PARTITION BY tree_id ORDER BY node_id) AS int) AS ord FROM tleaves
""", "tleaves"))
def q_leaf_ordinal(spark, sf_dir):
    """Document order of leaves."""
    def job(n, whole):
        lv = T.leaves(n.select("tree_id", "node_id", "parent_id", "kind", "token"), whole=whole).select("tree_id", "node_id")
        return T.leaf_ordinals(lv, whole).select("tree_id", "node_id", F.col("ord").cast("int"))

    return _by_tree(spark, sf_dir, job)


@register("sibling_position", tq("""
SELECT tree_id, node_id, cast(row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY node_id) - 1 AS int) AS sib
FROM fx_nodes
""", "fx_nodes"))
def q_sibling_position(spark, sf_dir):
    """C13."""
    return _by_tree(spark, sf_dir, lambda n, whole: T.sibling_position(n.select("tree_id", "node_id", "parent_id"), whole).select(
        "tree_id", "node_id", "sib"))


@register("ancestor_stack", tq("""
SELECT n.tree_id, n.node_id, coalesce(string_agg(a.anc_id, '>' ORDER BY a.k), '') AS stack
FROM fx_nodes n LEFT JOIN anc a ON n.tree_id = a.tree_id AND n.node_id = a.node_id GROUP BY n.tree_id, n.node_id
""", "anc"))
def q_ancestor_stack(spark, sf_dir):
    """Ancestors nearest-first."""
    c = _by_tree(spark, sf_dir, lambda n, whole: T.ancestor_chains(n, whole=whole, columns=("tree_id", "node_id", "up")))
    return c.select("tree_id", "node_id", F.array_join(F.transform("up", lambda x: x["node_id"]), ">").alias("stack"))


@register("node_depth", tq("""
SELECT n.tree_id, n.node_id, cast(count(a.k) AS int) AS depth
FROM fx_nodes n LEFT JOIN anc a ON n.tree_id = a.tree_id AND n.node_id = a.node_id GROUP BY n.tree_id, n.node_id
""", "anc"))
def q_node_depth(spark, sf_dir):
    """Edges to the root."""
    return _by_tree(spark, sf_dir, lambda n, whole: T.ancestor_chains(n, whole=whole, columns=("tree_id", "node_id", "depth")))


@register("subtree_closure", tq("""
SELECT a.tree_id, a.anc_id AS node_id, cast(count(*) AS bigint) AS n_desc,
       cast(count(l.node_id) AS bigint) AS n_leaves
FROM anc a LEFT JOIN tleaves l ON a.tree_id = l.tree_id AND a.node_id = l.node_id
GROUP BY a.tree_id, a.anc_id
""", "anc", "tleaves"))
def q_subtree_closure(spark, sf_dir):
    """C14: descendants and leaves under every inner node, from interval labels."""
    return _by_tree(spark, sf_dir, T.subtree_closure)


@register("leaf_pairs", tq("SELECT tree_id, l, r FROM tpairs", "tpairs"))
def q_leaf_pairs(spark, sf_dir):
    """C4: leaf pairs (l before r) within the length and width limits."""
    return _pairs(spark, sf_dir, "tree_id", "l", "r")


@register("lca_join", tq("SELECT tree_id, l, r, ids_l[kl + 1] AS a_id FROM tpairs", "tpairs"))
def q_lca_join(spark, sf_dir):
    """Lowest common ancestor of each pair."""
    return _pairs(spark, sf_dir, "tree_id", "l", "r", "a_id")


@register("filter_path_length", tq("SELECT tree_id, l, r, cast(length AS int) AS length FROM tpairs", "tpairs"))
def q_filter_path_length(spark, sf_dir):
    """Emitted pairs and their path length (<= 5)."""
    return _pairs(spark, sf_dir, "tree_id", "l", "r", "kl", "kr").select("tree_id", "l", "r", (F.col("kl") + F.col("kr")).cast("int").alias("length"))


@register("filter_path_width", tq("SELECT tree_id, l, r, cast(width AS int) AS width FROM tpairs", "tpairs"))
def q_filter_path_width(spark, sf_dir):
    """Emitted pairs and their width under the LCA (<= 2)."""
    return _pairs(spark, sf_dir, "tree_id", "l", "r", "width").select("tree_id", "l", "r", F.col("width").cast("int"))


@register("path_string", tq(f"SELECT tree_id, l, r, src, {PATH_SQL} AS path, dst FROM tpairs", "tpairs"))
def q_path_string(spark, sf_dir):
    """Readable Java-style path of every emitted pair, with its end tokens."""
    return _pairs(spark, sf_dir, "tree_id", "l", "r", "src", "path", "dst")


@register("mask_target_leaf", tq("SELECT tree_id, node_id, name FROM lv", "lv"))
def q_mask_target_leaf(spark, sf_dir):
    """H15 + H1 + H14: emitted leaf text, the unit's own name as METHOD_NAME."""
    lv = _by_tree(spark, sf_dir, lambda n, whole: T.leaves(T.ancestor_chains(n, whole=whole, columns=CHAIN_COLS)))
    return lv.select("tree_id", "node_id", T.leaf_names(lv, UNIT).alias("name"))


TARGET_SQL = f"""
SELECT n.tree_id, CASE WHEN length(array_to_string({S.h2('n.token')}, '|')) > 0
  THEN array_to_string({S.h2('n.token')}, '|') ELSE {S.h1('n.token')} END AS target
FROM fx_nodes n JOIN fx_nodes r ON n.tree_id = r.tree_id AND n.parent_id = r.node_id
WHERE n.kind = 'NameExpr' AND r.kind = 'Order'
"""


@register("drop_unit_without_paths", tq(f"""
SELECT t.tree_id, t.target, cast(count(*) AS bigint) AS n_contexts
FROM ({TARGET_SQL}) t JOIN tpairs p ON t.tree_id = p.tree_id GROUP BY t.tree_id, t.target
""", "tpairs", "fx_nodes"))
def q_drop_unit_without_paths(spark, sf_dir):
    """Units with at least one surviving path (Java drops the others)."""
    def job(n, whole):
        chains = _chains(n, whole)
        p = T.leaf_pairs(chains, UNIT, LMAX, WMAX, whole=whole, columns=("tree_id",)).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_contexts"))
        return T.unit_targets(chains, UNIT).join(p.hint("merge"), "tree_id")

    return _by_tree(spark, sf_dir, job)


@register("tree_example_lines", tq(f"""
SELECT t.tree_id, t.target || ' ' || string_agg(p.src || ',' || cast({S.h8(PATH_SQL)} AS varchar) || ',' || p.dst, ' '
  ORDER BY p.l_ord, p.r_ord) AS line
FROM ({TARGET_SQL}) t JOIN tpairs p ON t.tree_id = p.tree_id GROUP BY t.tree_id, t.target
""", "tpairs", "fx_nodes"))
def q_tree_example_lines(spark, sf_dir):
    """A20 on trees: one `target src,hash,dst ...` line per unit, pairs in (i, j) order."""
    def job(n, whole):
        chains = T.ancestor_chains(T.with_piece_hashes(n, whole=whole), limit=LMAX + 1, whole=whole, columns=CHAIN_COLS)
        return T.unit_lines(chains, UNIT, LMAX, WMAX, whole)

    return _by_tree(spark, sf_dir, job)


@register("filter_by_code_length", f"""
SELECT doc_id, n_lines FROM (SELECT doc_id, {S.h17('text')} AS n_lines FROM documents) WHERE n_lines BETWEEN 1 AND 10000
""")
def q_filter_by_code_length(spark, sf_dir):
    """Units whose line count (H17) is in [1, 10000]."""
    from ..functions.names import code_length

    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", code_length("text").alias("n_lines"))
    return d.filter(F.col("n_lines").between(1, 10000))


@register("drop_bodyless", tq("""
SELECT u.tree_id, u.node_id FROM (SELECT * FROM fx_nodes WHERE kind = 'Line') u
SEMI JOIN (SELECT b.tree_id, b.parent_id FROM (SELECT * FROM fx_nodes WHERE kind = 'Part') b
  SEMI JOIN (SELECT tree_id, parent_id FROM fx_nodes WHERE length(token) > 0) w ON w.tree_id = b.tree_id AND w.parent_id = b.node_id) f
  ON f.tree_id = u.tree_id AND f.parent_id = u.node_id
""", "fx_nodes", once=("fx_ctx", "fx_nodes")))
def q_drop_bodyless(spark, sf_dir):
    """Units (Line nodes) kept only when their body (a Part child) holds a token."""
    n = _nodes(spark, sf_dir)
    body = n.filter(F.col("kind") == "Part").select(F.col("tree_id").alias("bt"), F.col("node_id").alias("bn"),
                                                    F.col("parent_id").alias("bp"))
    words = n.filter(F.col("token").isNotNull() & (F.length("token") > 0)).select(
        F.col("tree_id").alias("wt"), F.col("parent_id").alias("wp"))
    full = body.join(words, (body.bt == words.wt) & (body.bn == words.wp), "left_semi")
    units = n.filter(F.col("kind") == "Line")
    return units.join(full, (units.tree_id == full.bt) & (units.node_id == full.bp), "left_semi").select(
        "tree_id", "node_id")


@register("is_generic_parent", tq("""
SELECT n.tree_id, n.node_id, EXISTS (SELECT 1 FROM fx_nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id
  AND c.kind = 'Word') AS generic
FROM fx_nodes n WHERE n.kind = 'Part'
""", "fx_nodes"))
def q_is_generic_parent(spark, sf_dir):
    """A type node (here Part) with at least one type argument (here a Word child)."""
    # two kinds of nodes take part: only they are stored, without their tokens
    n = stored(fx.fx_nodes(spark, sf_dir).filter(F.col("kind").isin("Part", "Word")).select("tree_id", "node_id", "parent_id", "kind"))
    args = n.filter(F.col("kind") == "Word").select(F.col("tree_id").alias("at"), F.col("parent_id").alias("ap"),
                                                    F.lit(True).alias("g")).distinct()
    t = n.filter(F.col("kind") == "Part")
    j = t.join(args, (t.tree_id == args.at) & (t.node_id == args.ap), "left")
    return j.select("tree_id", "node_id", F.coalesce("g", F.lit(False)).alias("generic"))
