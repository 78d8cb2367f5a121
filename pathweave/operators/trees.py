"""Trees as adjacency tables: leaves, ancestor chains, leaf pairs and paths.

Input: ``nodes(tree_id, node_id, parent_id, child_idx, kind, token)``;
document order is the order of ``node_id`` inside a tree.

Scale notes
* Ancestor chains are built by pointer doubling over the inner nodes only: each
  round joins the table with itself on the current top ancestor and concatenates
  the chains, so a depth-D forest needs about log2(D) shuffle joins (stored per
  round as compressed columns); every node then takes its parent's chain in one join.
* Leaf pairs are never enumerated per tree. A pair is emitted at its lowest
  common ancestor ``a``; the extractor's length and width limits are turned
  into join keys: each leaf contributes one row per ancestor within the
  length limit, dealt by the block of its child index (four widths long); a left
  row goes to the one or two blocks that hold the allowed child indices, and the
  join on (tree, ancestor, block) checks the width. A big tree is spread over many
  join keys; a hot key is split by AQE's skew-join handling.
* That is for trees of any size. With ``whole`` the operators get whole trees of bounded size in a
  task, one after another (``forest.by_tree``), and need no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import JAVA_MAX_PATH_LENGTH, JAVA_MAX_PATH_WIDTH, MAX_LABEL_LENGTH, METHOD_NAME
from ..functions.names import (JAVA_CHILD_ID_PARENTS, hash_of_concat, hash_state, java_string_hash, mul32, normalize_name,
                               signed_int, split_name_unless_empty, split_subtokens, split_subtokens_cs, truncate_label)
from . import forest
from .forest import by_tree
from .ranking import affine_scan, number_within_skew_safe, reliable_checkpoint, stored


def leaves(nodes: DataFrame, comment_kinds: tuple[str, ...] = ("Comment",),
           null_literal_kind: str = "NullLiteralExpr", whole: bool = False) -> DataFrame:
    """Childless nodes that are not comments and carry a non-empty
    token ('null' only for a null literal). Chains know which nodes are childless."""
    if whole and "childless" not in nodes.columns:
        nodes = forest.childless(nodes)
    if "childless" in nodes.columns:
        return _worded(nodes.filter("childless").drop("childless"), comment_kinds, null_literal_kind)
    parents = nodes.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    childless = nodes.join(parents.hint("merge"), (nodes.tree_id == parents._t) & (nodes.node_id == parents._p), "left_anti")
    return _worded(childless, comment_kinds, null_literal_kind)


def _worded(childless: DataFrame, comment_kinds: tuple[str, ...], null_literal_kind: str) -> DataFrame:
    return childless.filter(_has_word(comment_kinds, null_literal_kind))


def _has_word(comment_kinds: tuple[str, ...] = ("Comment",), null_literal_kind: str = "NullLiteralExpr") -> Column:
    tok = F.col("token")
    return (~F.col("kind").isin(*comment_kinds) & tok.isNotNull() & (F.length(tok) > 0)
            & ((tok != "null") | (F.col("kind") == null_literal_kind)))


def leaf_ordinals(lv: DataFrame, whole: bool = False) -> DataFrame:
    """1-based document-order number of each leaf in its tree (no task holds a tree of any size)."""
    if whole:
        return forest.ordinals(lv)
    return number_within_skew_safe(lv, ["tree_id"], ["node_id"], "ord").withColumn("ord", F.col("ord").cast("int"))


def sibling_position(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """Index among the parent's children, by document order (no task holds a family of any size)."""
    if whole:
        return forest.siblings(nodes)
    keyed = nodes.withColumns({"_root": F.col("parent_id").isNull(), "_p": F.coalesce("parent_id", F.lit(""))})
    out = number_within_skew_safe(keyed, ["tree_id", "_root", "_p"], ["node_id"], "sib")
    return out.withColumn("sib", (F.col("sib") - 1).cast("int")).drop("_root", "_p")


def tree_intervals(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Interval labels: ``pre`` is a node's number in its tree's document order (from 1), ``last``
    that of its last descendant (its own if it has none), so that a subtree is a range.

    ``last`` is the number before the next sibling's; a last child takes its parent's, by
    pointer jumping in log2(depth) rounds of joins on unique keys. The document order
    of nodes must be that of their ids, parents first.
    """
    n = number_within_skew_safe(nodes.select("tree_id", "node_id", "parent_id"), ["tree_id"], ["node_id"], "pre")
    n = reliable_checkpoint(sibling_position(n))
    nxt = n.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p"), (F.col("sib") - 1).alias("_s"), F.col("pre").alias("_next"))
    size = n.groupBy(F.col("tree_id").alias("_r")).agg(F.max("pre").alias("_size"))
    cur = n.join(nxt, (n.tree_id == nxt._t) & (n.parent_id == nxt._p) & (n.sib == nxt._s), "left").join(size, n.tree_id == F.col("_r"))
    cur = cur.select("tree_id", "node_id", "parent_id", "pre", F.col("parent_id").alias("ptr"),
                     F.when(F.col("parent_id").isNull(), F.col("_size")).otherwise(F.col("_next") - 1).alias("last"))
    cur = reliable_checkpoint(cur)
    for _ in range(max_rounds):
        if cur.filter(F.col("last").isNull()).limit(1).count() == 0:
            return cur.drop("ptr")
        up = cur.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("ptr").alias("_ptr"), F.col("last").alias("_last"))
        j = cur.join(up, (cur.tree_id == up._t) & (cur.ptr == up._n) & cur["last"].isNull(), "left")
        cur = reliable_checkpoint(j.select("tree_id", "node_id", "parent_id", "pre", F.coalesce("_ptr", "ptr").alias("ptr"),
                                           F.coalesce("last", "_last").alias("last")))
    raise ValueError("parents form a cycle, or chains are longer than 2 ** max_rounds")


def subtree_closure(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """C14: (tree_id, node_id, n_desc, n_leaves) of every inner node: the range of its interval,
    and the difference of two running leaf counts."""
    if whole:
        return forest.closure(nodes.select("tree_id", "node_id", "parent_id", _has_word().alias("_worded")), "_worded")
    lv = leaves(nodes).select("tree_id", "node_id", F.lit(1.0).alias("is_leaf"))
    n = tree_intervals(nodes).join(lv.hint("merge"), ["tree_id", "node_id"], "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(0.0)))
    n = reliable_checkpoint(affine_scan(n, ["tree_id", "pre"], F.lit(1.0), F.col("is_leaf"), "_leaves"))
    ends = n.select(F.col("tree_id").alias("_t"), F.col("pre").alias("_e"), F.col("_leaves").alias("_upto"))
    inner = n.filter(F.col("last") > F.col("pre"))
    j = inner.join(ends, (inner.tree_id == ends._t) & (inner["last"] == ends._e))
    return j.select("tree_id", "node_id", (F.col("last") - F.col("pre")).alias("n_desc"),
                    (F.col("_upto") - F.col("_leaves")).cast("long").alias("n_leaves"))


def with_piece_hashes(nodes: DataFrame, child_id_cap: int | None = None,
                      child_id_parents: tuple[str, ...] = JAVA_CHILD_ID_PARENTS, whole: bool = False) -> DataFrame:
    """Adds the hashes of a node's pieces of Java paths (see ``java_path_pieces``): (uh, up) of
    ``(Type[id])^``, (ch, cp) of ``(Type[id])`` and (dh, dp) of ``_(Type[id])``, each a hash and
    31 ** its length. Every character is folded once per node, not once per path."""
    if whole:
        return forest.pieces(nodes, child_id_cap, child_id_parents)
    parent = nodes.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("kind").alias("_pk"))
    j = nodes.join(parent, (nodes.tree_id == parent._t) & (nodes.parent_id == parent._n), "left")
    kinds = F.array(*[F.lit(k) for k in child_id_parents])
    c = F.col("child_idx")
    cid = (F.least(c, F.lit(child_id_cap)) if child_id_cap is not None else c).cast("string")

    def state(text, has_id):
        return hash_state(F.concat(F.lit(text), F.col("kind"), F.when(has_id, cid).otherwise(F.lit("")), F.lit(")")))

    j = j.withColumns({"_c": state("(", F.array_contains(kinds, F.coalesce("_pk", F.lit("")))), "_d": state("_(", F.array_contains(kinds, F.col("kind")))})
    h, mask = F.col("_c")["h"], F.lit(4294967295)
    hashes = F.struct((h * 31 + ord("^")).bitwiseAND(mask).alias("uh"), (F.col("_c")["p"] * 31).bitwiseAND(mask).alias("up"), h.alias("ch"),
                      F.col("_c")["p"].alias("cp"), F.col("_d")["h"].alias("dh"), F.col("_d")["p"].alias("dp"))
    return j.select(*nodes.columns, hashes.alias("pieces"))


def ancestor_chains(nodes: DataFrame, max_rounds: int = 32, limit: int | None = None, whole: bool = False,
                    columns: tuple[str, ...] | None = None) -> DataFrame:
    """Per node, its ancestors nearest-first as ``up: array<struct<node_id, kind,
    child_idx[, pieces]>>`` (the nearest ``limit`` if given), ``depth = size(up)`` and whether it
    is ``childless``, so that leaves need no join of rows with chains.

    Pointer doubling over the inner nodes: every round each one whose chain (from itself
    upwards) is not complete appends the chain of the node that it points to. Each node then
    takes the chain of its parent.
    """
    more = ["pieces"] if "pieces" in nodes.columns else []
    if whole:
        typed = nodes.withColumn("child_idx", F.col("child_idx").cast("int"))
        return forest.chains(typed, ["node_id", "kind", "child_idx", *more], limit, columns)
    me = F.struct("node_id", "kind", F.col("child_idx").cast("int").alias("child_idx"), *more)
    # a node meets the rows that name it as their parent in a window over its id (no join, and no leaf is stored)
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).filter("tree_id is not null and node_id is not null").distinct()
    marked = nodes.withColumn("_p", F.lit(False)).unionByName(parents.withColumn("_p", F.lit(True)), allowMissingColumns=True)
    marked = marked.withColumn("childless", ~F.bool_or("_p").over(Window.partitionBy("tree_id", "node_id")))
    nodes = marked.filter(~F.col("_p")).select(*nodes.columns, "childless")
    inner = nodes.filter(~F.col("childless"))
    cur = stored(inner.select("tree_id", "node_id", F.array(me).alias("chain"), F.col("parent_id").alias("ptr"),
                              (F.col("parent_id").isNull() | F.lit(limit is not None and limit <= 1)).alias("done")))
    for _ in range(max_rounds):
        if cur.filter(~F.col("done")).limit(1).count() == 0:
            break
        other = cur.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("chain").alias("_chain"),
                           F.col("ptr").alias("_ptr"), F.col("done").alias("_d"))
        going = cur.filter(~F.col("done"))
        j = going.join(other.hint("merge"), (going.tree_id == other._t) & (going.ptr == other._n), "left")
        j = j.select("tree_id", "node_id", F.when(F.col("_n").isNotNull(), F.concat("chain", "_chain")).otherwise(F.col("chain")).alias("chain"),
                     F.col("_ptr").alias("ptr"), F.coalesce("_d", F.lit(True)).alias("done"))
        if limit is not None:
            j = j.withColumn("done", F.col("done") | (F.size("chain") >= limit)).withColumn("chain", F.slice("chain", 1, limit))
        cur = stored(cur.filter("done").unionByName(j))
    else:
        raise ValueError("parents form a cycle, or chains are longer than 2 ** max_rounds")
    up = cur.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("chain").alias("_chain"))
    j = nodes.join(up.hint("merge"), (nodes.tree_id == up._t) & (nodes.parent_id == up._n), "left")
    j = j.select(*nodes.columns, F.coalesce("_chain", F.array().cast(up.schema["_chain"].dataType)).alias("up")).withColumns(
        {"depth": F.size("up").cast("int"), "me": me})
    return j if columns is None else j.select(*[c for c in j.columns if c in columns])


def leaf_names(chains: DataFrame, unit_kind: str, name_kind: str = "NameExpr") -> Column:
    """H1 + H14 + H15: emitted leaf text; the unit's own name leaf becomes METHOD_NAME."""
    is_name = (F.col("kind") == name_kind) & (F.get("up", 0)["kind"] == unit_kind)
    return F.when(is_name, F.lit(METHOD_NAME)).otherwise(
        truncate_label(normalize_name("token"), MAX_LABEL_LENGTH))


def unit_targets(chains: DataFrame, unit_kind: str, name_kind: str = "NameExpr") -> DataFrame:
    """Target of each unit: subtokens of its name joined by '|', else the
    normalised name (the name node is the one whose parent is the unit root;
    the parent's kind is the first element of the chain, so no join)."""
    names = chains.filter(_is_unit_name(unit_kind, name_kind))
    return names.select("tree_id", _target().alias("target"))


def _is_unit_name(unit_kind: str, name_kind: str) -> Column:
    return (F.col("kind") == name_kind) & (F.get("up", 0)["kind"] == unit_kind)


def _target() -> Column:
    sub = F.array_join(split_subtokens("token"), "|")
    return F.when(F.length(sub) > 0, sub).otherwise(normalize_name("token"))


def _sides(lv: DataFrame, max_length: int, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per (leaf, ancestor within max_length): k steps up, child index on the leaf's side."""
    full = F.concat(F.array("me"), F.col("up"))
    t = lv.withColumn("full", full)
    t = t.select("tree_id", "node_id", "ord", "name", "full", *extra,
                 F.posexplode(F.slice("up", 1, max_length)).alias("p", "a"))
    return t.select("tree_id", F.col("node_id").alias("leaf"), "ord", "name", "full", *extra,
                    (F.col("p") + 1).cast("int").alias("k"), F.col("a.node_id").alias("a_id"),
                    F.get("full", F.col("p"))["child_idx"].alias("ci"))


def _cid(node: Column, cap: int | None) -> Column:
    c = node["child_idx"]
    return (F.least(c, F.lit(cap)) if cap is not None else c).cast("string")


def java_path_pieces(child_id_cap: int | None = None,
                     child_id_parents: tuple[str, ...] = JAVA_CHILD_ID_PARENTS) -> dict[str, Column]:
    """H10 pieces computed on one side row (chain ``full``, steps ``k``):

    * up: ``(Type[id])^`` from the leaf to just below the ancestor -- the id
      for the first node or when the *parent's* kind is in the set;
    * common: ``(Type[id])`` of the ancestor, id when its parent's kind is in the set;
    * down: ``_(Type[id])`` from just below the ancestor to the leaf -- the id
      for the last node or when the node's *own* kind is in the set.
    """
    kinds = F.array(*[F.lit(k) for k in child_id_parents])
    up = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda i: F.concat(F.lit("("), F.get("full", i)["kind"],
                           F.when((i == 0) | F.array_contains(kinds, F.get("full", i + 1)["kind"]),
                                  _cid(F.get("full", i), child_id_cap)).otherwise(F.lit("")), F.lit(")^")))
    common_node = F.get("full", F.col("k"))
    common_parent_kind = F.coalesce(F.get("full", F.col("k") + 1)["kind"], F.lit(""))
    common = F.concat(F.lit("("), common_node["kind"],
                      F.when(F.array_contains(kinds, common_parent_kind), _cid(common_node, child_id_cap))
                      .otherwise(F.lit("")), F.lit(")"))
    down = F.transform(
        F.sequence(F.col("k") - 1, F.lit(0), F.lit(-1)),
        lambda i: F.concat(F.lit("_("), F.get("full", i)["kind"],
                           F.when((i == 0) | F.array_contains(kinds, F.get("full", i)["kind"]),
                                  _cid(F.get("full", i), child_id_cap)).otherwise(F.lit("")), F.lit(")")))
    return {"up": F.concat(F.array_join(up, ""), common), "down": F.array_join(down, "")}


def _composed_hashes(s: DataFrame) -> DataFrame:
    """hu of the pieces up to and with the ancestor, (hd, pd) of those down, on side rows
    whose leaf has the hashes of its own pieces (lh, dh, dp)."""
    inner = F.slice("full", 2, F.col("k") - 1)
    top = F.get("full", F.col("k"))["pieces"]
    up = F.aggregate(inner, F.col("lh"), lambda h, e: hash_of_concat(h, e["pieces"]["uh"], e["pieces"]["up"]))
    down = F.aggregate(inner, F.struct(F.col("dh").alias("h"), F.col("dp").alias("p")), lambda a, e: F.struct(
        hash_of_concat(e["pieces"]["dh"], a["h"], a["p"]).alias("h"), mul32(e["pieces"]["dp"], a["p"]).alias("p")))
    s = s.withColumns({"hu": hash_of_concat(up, top["ch"], top["cp"]), "hd": down})
    return s.withColumns({"pd": F.col("hd")["p"], "hd": F.col("hd")["h"]})


PAIR_COLS = ("tree_id", "l", "r", "l_ord", "r_ord", "a_id", "kl", "kr", "width", "src", "dst", "path", "path_hash")


def leaf_pairs(chains: DataFrame, unit_kind: str, max_length: int = JAVA_MAX_PATH_LENGTH,
               max_width: int = JAVA_MAX_PATH_WIDTH, child_id_cap: int | None = None, whole: bool = False,
               columns: tuple[str, ...] = PAIR_COLS) -> DataFrame:
    """C4 + C6 + B12 + B13 + H10 (Java rules): pairs (l before r) within the
    limits, with their LCA ``a_id``, steps ``kl``/``kr``, width ``ci_r - ci_l``
    and the readable ``path``. The path pieces are built on the side rows,
    so only short strings travel through the join. Chains of nodes with
    ``with_piece_hashes`` give the path's hash without its text."""
    lv = leaves(chains)
    hashed = "pieces" in chains.schema["up"].dataType.elementType.fieldNames()
    if whole:
        more = [leaf_names(lv, unit_kind).alias("name")] * bool({"src", "dst"} & set(columns))
        return forest.leaf_pairs(lv.select("tree_id", "node_id", "up", "me", *more), tuple(columns), max_length, max_width, child_id_cap, JAVA_CHILD_ID_PARENTS)
    lv = leaf_ordinals(lv).withColumn("name", leaf_names(lv, unit_kind))
    if hashed:
        own = F.concat(F.lit("("), F.col("kind"), _cid(F.col("me"), child_id_cap), F.lit(")"))
        lv = lv.withColumns({"lh": hash_state(F.concat(own, F.lit("^")))["h"], "dh": hash_state(F.concat(F.lit("_"), own))})
        lv = lv.withColumns({"dp": F.col("dh")["p"], "dh": F.col("dh")["h"]})
    # both join sides (and any reuse of the pairs) start from the leaf rows: materialise them once
    lv = stored(lv)
    s = _sides(lv, max_length, ["lh", "dh", "dp"] if hashed else [])
    pieces = java_path_pieces(child_id_cap)
    s = s.withColumns({"up": pieces["up"], "down": pieces["down"]})
    s = _composed_hashes(s) if hashed else s
    ends = ["tree_id", "leaf", "ord", "name", "k", "a_id", "ci"]
    block = lambda c: F.floor(c / max(4, 4 * max_width))
    left = s.select(*[F.col(c).alias(f"l_{c}") for c in [*ends, "up"] + ["hu"] * hashed],
                    F.explode(F.sequence(block(F.col("ci") + 1), block(F.col("ci") + max_width))).alias("key"))
    right = s.select(*[F.col(c).alias(f"r_{c}") for c in [*ends, "down"] + ["hd", "pd"] * hashed], block(F.col("ci")).alias("r_key"))
    j = left.join(right, (left.l_tree_id == right.r_tree_id) & (left.l_a_id == right.r_a_id) & (left.key == right.r_key)
                  & (right.r_ci > left.l_ci) & (right.r_ci <= left.l_ci + max_width))
    j = j.filter(F.col("l_k") + F.col("r_k") <= max_length)
    path = F.concat("l_up", "r_down")
    path_hash = signed_int(hash_of_concat("l_hu", "r_hd", "r_pd")) if hashed else java_string_hash(path)
    return j.select(F.col("l_tree_id").alias("tree_id"), F.col("l_leaf").alias("l"), F.col("r_leaf").alias("r"),
                    F.col("l_ord").alias("l_ord"), F.col("r_ord").alias("r_ord"),
                    F.col("l_a_id").alias("a_id"), F.col("l_k").alias("kl"), F.col("r_k").alias("kr"),
                    (F.col("r_ci") - F.col("l_ci")).alias("width"),
                    F.col("l_name").alias("src"), F.col("r_name").alias("dst"),
                    path.alias("path"), path_hash.cast("string").alias("path_hash")).select(*columns)


def unit_lines(chains: DataFrame, unit_kind: str, max_length: int = JAVA_MAX_PATH_LENGTH, max_width: int = JAVA_MAX_PATH_WIDTH,
               whole: bool = False, name_kind: str = "NameExpr") -> DataFrame:
    """A20 on trees: (tree_id, line), the unit's target and its contexts ``src,hash,dst`` in the order of
    their leaves, for every unit that has any. With ``whole`` lines are made where the pairs are."""
    if whole:
        rows = chains.withColumns({"leaf": F.col("childless") & F.coalesce(_has_word(), F.lit(False)),
                                   "named": F.coalesce(_is_unit_name(unit_kind, name_kind), F.lit(False))}).filter("leaf or named")
        rows = rows.select("tree_id", "node_id", "up", "me", leaf_names(rows, unit_kind, name_kind).alias("name"), "leaf", "named",
                           F.when(F.col("named"), _target()).alias("target"))
        return forest.unit_lines(rows, max_length, max_width, None, JAVA_CHILD_ID_PARENTS)
    p = leaf_pairs(chains, unit_kind, max_length, max_width)
    ctx = p.select("tree_id", "l_ord", "r_ord", F.concat_ws(",", "src", "path_hash", "dst").alias("c"))
    g = ctx.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("l_ord", "r_ord", "c"))).alias("cs"))
    j = unit_targets(chains, unit_kind, name_kind).join(g.hint("merge"), "tree_id")
    return j.select("tree_id", F.concat("target", F.lit(" "), F.array_join(F.transform("cs", lambda x: x["c"]), " "))
                    .alias("line"))


def tree_contexts(nodes: DataFrame, unit_kind: str, max_length: int = JAVA_MAX_PATH_LENGTH,
                  max_width: int = JAVA_MAX_PATH_WIDTH, no_hash: bool = False) -> DataFrame:
    """K6 / A20 input: (tree_id, l_ord, r_ord, src, path, dst) of every emitted pair."""
    path = "path" if no_hash else "path_hash"

    def job(n, whole):
        chains = ancestor_chains(n if no_hash else with_piece_hashes(n, whole=whole), limit=max_length + 1, whole=whole)
        return leaf_pairs(chains, unit_kind, max_length, max_width, whole=whole, columns=("tree_id", "l_ord", "r_ord", "src", path, "dst"))

    return by_tree(nodes, job).withColumnRenamed(path, "path")


# ---------------------------------------------------------------------------
# C#-style extraction: variables (names) and their leaves, ordered pairs of
# variables, limits on the token parents (length, |width| < W).
# ---------------------------------------------------------------------------

# fixed values: kinds whose children carry their index in C#-style paths
CS_CHILD_ID_PARENTS = ("SimpleAssignmentExpression", "ElementAccessExpression", "SimpleMemberAccessExpression",
                       "InvocationExpression", "BracketedArgumentList", "ArgumentList")


def check_limits(length: int, width: int) -> None:
    """Both limits must be positive (checked before any plan is built)."""
    if length < 1 or width < 1:
        raise ValueError(f"path limits below 1: length {length}, width {width}")


def cs_leaves(chains: DataFrame, unit_kind: str, identifier_kinds: tuple[str, ...], literal_kinds: tuple[str, ...],
              declaration_parents: tuple[str, ...], name_kind: str = "NameExpr", whole: bool = False) -> DataFrame:
    """Leaf record -- kind, text, constant flag, variable name
    (the unit's own name token becomes METHOD_NAME), document ordinal."""
    lv = leaf_ordinals(leaves(chains).filter(F.col("kind").isin(*identifier_kinds, *literal_kinds)), whole)
    parent_kind = F.get("up", 0)["kind"]
    is_method_name = (F.col("kind") == name_kind) & (parent_kind == unit_kind)
    return lv.withColumns({
        "var": F.when(is_method_name, F.lit(METHOD_NAME)).otherwise(F.col("token")),
        "is_const": ~(F.col("kind").isin(*identifier_kinds) & parent_kind.isin(*declaration_parents)),
        "is_literal_kind": F.col("kind").isin(*literal_kinds),
    })


def variables(cs_lv: DataFrame, whole: bool = False) -> DataFrame:
    """One row per (tree, name): first-seen ordinal, leaf count,
    constant (no occurrence is a declaration), literal (first occurrence is a literal) and its
    leaves in document order."""
    if whole:
        return forest.variables(cs_lv.select("tree_id", "node_id", "var", "ord", "is_const", "is_literal_kind"))
    held = F.array_sort(F.collect_list(F.struct("ord", "node_id")))["node_id"]
    return cs_lv.groupBy("tree_id", "var").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_leaves"),
        F.bool_and("is_const").alias("is_const"),
        F.min_by("is_literal_kind", "ord").alias("is_literal"), held.alias("leaves"))


ROUNDS = 6  # of the pair permutation


def variable_pairs(vars_: DataFrame, max_pairs: int | None, seed: int = 42, whole: bool = False) -> DataFrame:
    """C5 (pair level) + G7 + F5: 2-combinations of names in first-seen order plus each name with
    itself: all, or ``max_pairs`` per tree drawn without enumerating them.

    The n(n+1)/2 pairs factor into A x B exactly (n/2 x (n+1), or n x (n+1)/2), so a Feistel network
    that moves a number of Z_A and one of Z_B by seeded hashes of each other is a permutation of the
    pair numbers; the first ``max_pairs`` of it are unranked and joined with the names' numbers."""
    if whole:
        v = vars_.select("tree_id", "var", F.col("first_ord").alias("o"), F.col("tree_id").cast("string").alias("_tree"))
        return forest.drawn_names(v, max_pairs, seed, ROUNDS)
    v = number_within_skew_safe(vars_.select("tree_id", "var", F.col("first_ord").alias("o")), ["tree_id"], ["o"], "num").withColumn("num", F.col("num") - 1)
    v = reliable_checkpoint(v)
    n = F.col("n")
    units = v.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.expr("n * (n + 1) div 2")
    drawn = units.select("tree_id", F.when(n % 2 == 0, F.expr("n div 2")).otherwise(n).alias("A"), F.when(n % 2 == 0, n + 1).otherwise(F.expr("(n + 1) div 2")).alias("B"),
                         F.explode(F.sequence(F.lit(0).cast("long"), (total if max_pairs is None else F.least(total, F.lit(max_pairs))) - 1)).alias("x"))
    if max_pairs is None:
        p = drawn.select("tree_id", F.col("x").alias("t"))
    else:
        def move(i, other):
            digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tree_id").cast("string"), i.cast("string"), other.cast("string")))
            return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

        def turn(s, i):
            even = i % 2 == 0
            m = move(i, F.when(even, s["r"]).otherwise(s["l"]))
            return F.struct(F.when(even, (s["l"] + m) % F.col("A")).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + m) % F.col("B")).alias("r"))

        start = F.struct(F.expr("x div B").alias("l"), (F.col("x") % F.col("B")).alias("r"))
        p = drawn.select("tree_id", "B", F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn).alias("s"))
        p = p.select("tree_id", (F.col("s.l") * F.col("B") + F.col("s.r")).alias("t"))
    p = reliable_checkpoint(p)  # at most max_pairs rows a tree; read several times below
    p = p.withColumn("j", F.floor((F.sqrt(F.lit(8.0) * F.col("t") + 1) - 1) / 2).cast("long"))
    # the root is rounded: one step either way makes it exact
    p = p.withColumn("j", F.when(F.expr("(j + 1) * (j + 2) div 2 <= t"), F.col("j") + 1).when(F.expr("j * (j + 1) div 2 > t"), F.col("j") - 1).otherwise(F.col("j")))
    p = p.withColumn("i", F.expr("t - j * (j + 1) div 2"))
    a = v.select("tree_id", F.col("num").alias("i"), F.col("var").alias("v1"), F.col("o").alias("o1"))
    b = v.select("tree_id", F.col("num").alias("j"), F.col("var").alias("v2"), F.col("o").alias("o2"))
    return p.join(a, ["tree_id", "i"]).join(b, ["tree_id", "j"]).select(
        "tree_id", "v1", "v2", "o1", "o2", (F.col("i") == F.col("j")).alias("is_self"))


CS_PAIR_COLS = ("tree_id", "lhs", "rhs", "a_id", "kl", "kr", "lvar", "rvar", "ltok", "rtok", "is_self", "path")


def cs_leaf_pairs(cs_lv: DataFrame, vars_: DataFrame, max_length: int = 7, max_width: int = 4, whole: bool = False,
                  columns: tuple[str, ...] = CS_PAIR_COLS, max_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """Leaf pairs (lhs != rhs) whose token-parent path is within the C# limits, the earlier-seen
    name on the left (a name with itself both ways, B19), with the path (H11). Width applies
    only when both sides of the LCA are non-empty (steps >= 2). The side rows carry the names'
    order and their piece of the path; chains don't travel through the join. With ``whole`` names are
    sampled before (``max_pairs``, F5), so that only the leaf pairs of drawn names are made;
    ``context`` is a column more: names (H5) and hashed path."""
    check_limits(max_length, max_width)
    if whole:
        more = [split_name_unless_empty("var").alias("label")] * ("context" in columns) + ["token"] * bool({"ltok", "rtok"} & set(columns))
        lv = cs_lv.select("tree_id", "node_id", "var", "ord", "up", "me", F.col("tree_id").cast("string").alias("_tree"), *more)
        return forest.cs_leaf_pairs(lv, tuple(columns), max_length, max_width, 3, CS_CHILD_ID_PARENTS, max_pairs, seed, ROUNDS)
    lv = cs_lv.join(vars_.select("tree_id", "var", "first_ord").hint("merge"), ["tree_id", "var"])
    s = _sides(stored(lv.withColumn("name", F.col("var"))), max_length, ["first_ord", "token"])
    pieces = cs_path_pieces()
    cols = ["tree_id", "leaf", "name", "first_ord", "token", "k", "a_id", "ci"]
    L_ = s.select(*[F.col(c).alias(f"l_{c}") for c in cols], pieces["up"].alias("l_up"))
    R_ = s.select(*[F.col(c).alias(f"r_{c}") for c in cols], pieces["down"].alias("r_down"))
    deltas = [d for d in range(-(max_width - 1), max_width) if d != 0]

    def within(left, right):
        return ((left.l_tree_id == right.r_tree_id) & (left.l_a_id == right.r_a_id) & (left.l_first_ord <= right.r_first_ord)
                & (left.l_k + right.r_k <= max_length))

    parts = []
    # (A) both sides non-empty: equi-join on the allowed child-index offsets
    if deltas:
        la = L_.filter(F.col("l_k") >= 2).withColumn("key", F.explode(F.array(*[F.col("l_ci") + d for d in deltas])))
        ra = R_.filter(F.col("r_k") >= 2)
        parts.append(la.join(ra, within(la, ra) & (la.key == ra.r_ci)).drop("key"))
    # (B) the left token's parent is the LCA; (C) the right one's
    lb = L_.filter(F.col("l_k") == 1)
    parts.append(lb.join(R_, within(lb, R_) & (lb.l_ci != R_.r_ci)))
    lc, rc = L_.filter(F.col("l_k") >= 2), R_.filter(F.col("r_k") == 1)
    parts.append(lc.join(rc, within(lc, rc) & (lc.l_ci != rc.r_ci)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(F.col("l_tree_id").alias("tree_id"), F.col("l_leaf").alias("lhs"), F.col("r_leaf").alias("rhs"),
                      F.col("l_a_id").alias("a_id"), F.col("l_k").alias("kl"), F.col("r_k").alias("kr"),
                      F.col("l_name").alias("lvar"), F.col("r_name").alias("rvar"), F.col("l_token").alias("ltok"), F.col("r_token").alias("rtok"),
                      (F.col("l_first_ord") == F.col("r_first_ord")).alias("is_self"), F.concat("l_up", "r_down").alias("path"))
    return out.withColumn("context", cs_context()) if "context" in columns else out


def cs_path_texts(cs_lv: DataFrame, vars_: DataFrame, max_length: int = 7, max_width: int = 4, max_pairs: int | None = None, seed: int = 42,
                  whole: bool = False) -> DataFrame:
    """(tree_id, text): the path contexts (names by H5, hashed path) of each tree in the order of their ends, joined by
    blanks. With ``whole`` texts are made where the pairs are."""
    if whole:
        check_limits(max_length, max_width)
        lv = cs_lv.select("tree_id", "node_id", "var", "ord", "up", "me", F.col("tree_id").cast("string").alias("_tree"), split_name_unless_empty("var").alias("label"))
        return forest.cs_unit_texts(lv, max_length, max_width, 3, CS_CHILD_ID_PARENTS, max_pairs, seed, ROUNDS)
    c = cs_contexts(cs_leaf_pairs(cs_lv, vars_, max_length, max_width), vars_, max_pairs, seed)
    c = c.select("tree_id", F.struct("lhs", "rhs", cs_context().alias("context")).alias("c"))
    return c.groupBy("tree_id").agg(F.array_join(F.array_sort(F.collect_list("c"))["context"], " ").alias("text"))


def cs_context() -> Column:
    """H5 names and the hashed path (H9) of a pair."""
    return F.concat_ws(",", split_name_unless_empty("lvar"), java_string_hash("path").cast("string"), split_name_unless_empty("rvar"))


def pair_count_small(vars_: DataFrame, max_pairs: int, whole: bool = False) -> DataFrame:
    """Trees whose number of variable pairs (combinations + self pairs) fits the sample size (with
    ``whole`` their names, told the same)."""
    n = forest.sizes(vars_, "n_vars") if whole else vars_.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_vars"))
    return n.withColumn("small", F.col("n_vars") * (F.col("n_vars") + 1) / 2 <= max_pairs)


def cs_contexts(pairs: DataFrame, vars_: DataFrame, max_pairs: int | None, seed: int = 42, whole: bool = False) -> DataFrame:
    """The leaf pairs of the sampled variable pairs. Names are sampled first, and only
    in trees with more pairs than the sample size; every other tree keeps all, which is exact.
    With ``whole`` ``cs_leaf_pairs`` has drawn the names."""
    if max_pairs is None or whole:
        return pairs
    size = pair_count_small(vars_, max_pairs)
    big_vars = vars_.join(size.filter(~F.col("small")).select("tree_id").hint("merge"), "tree_id", "left_semi")
    sampled = variable_pairs(big_vars, max_pairs, seed).select("tree_id", F.col("v1").alias("lvar"), F.col("v2").alias("rvar"))
    p = pairs.join(size.select("tree_id", "small").hint("merge"), "tree_id")
    big = p.filter(~F.col("small")).join(sampled, ["tree_id", "lvar", "rvar"], "left_semi")
    return p.filter("small").unionByName(big).drop("small")


def cs_path_pieces(child_id_cap: int = 3, child_id_parents: tuple[str, ...] = CS_CHILD_ID_PARENTS) -> dict[str, Column]:
    """H11 pieces on one side row: ``Kind[id]^Kind...^Ancestor`` up and ``_Kind[id]..._Kind`` down; a
    node carries its (capped) child index when its parent's kind is in the set."""
    kinds = F.array(*[F.lit(k) for k in child_id_parents])

    def piece(i) -> Column:
        node, parent = F.get("full", i), F.get("full", i + 1)
        cid = F.when(F.array_contains(kinds, F.coalesce(parent["kind"], F.lit(""))),
                     F.least(node["child_idx"], F.lit(child_id_cap)).cast("string")).otherwise(F.lit(""))
        return F.concat(node["kind"], cid)

    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.col("k") - 1, F.lit(1))), piece)
    up = F.when(F.col("k") >= 2, F.concat(F.array_join(inner, "^"), F.lit("^"))).otherwise(F.lit(""))
    down = F.when(F.col("k") >= 2, F.concat(F.lit("_"), F.array_join(F.reverse(inner), "_"))).otherwise(F.lit(""))
    return {"up": F.concat(up, F.get("full", F.col("k"))["kind"]), "down": down}


def comment_contexts(comments: DataFrame, keys: list[str], text: str = "text", size: int = 5) -> DataFrame:
    """(keys, batch_no, context): comment text trimmed of blanks and ``/*{}``, its subtokens
    (H5) in batches of ``size``, each as ``batch,COMMENT,batch``. A null text has none."""
    parts = F.split(split_name_unless_empty(F.btrim(text, F.lit(" /*{}"))), r"\|", -1)
    c = comments.filter(F.col(text).isNotNull()).select(*keys, parts.alias("_parts"))
    batches = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_parts") / size).cast("int") - 1),
                          lambda i: F.array_join(F.slice("_parts", i * size + 1, size), "|"))
    e = c.select(*keys, F.posexplode(batches).alias("batch_no", "_b"))
    return e.select(*keys, "batch_no", F.concat("_b", F.lit(",COMMENT,"), "_b").alias("context"))


def cs_lines(units: DataFrame, contexts: DataFrame, comments: DataFrame) -> DataFrame:
    """A20, C# form: (tree_id, line) for every row of units(tree_id, name): the name's subtokens, a
    blank, then path contexts(tree_id, lhs, rhs, context) in the order of their ends and
    comments(tree_id, comment_no, text) in theirs. Units without either are kept (B10, C# form).
    Contexts may come as ``cs_path_texts``, one text per tree."""
    paths = None if "text" in contexts.columns else contexts.select("tree_id", F.struct(
        F.lit(0).alias("part"), F.col("lhs").alias("a"), F.col("rhs").alias("b"), F.lit(0).alias("i"), F.lit(0).alias("j"), "context").alias("c"))
    target = F.array_join(split_subtokens_cs("name"), "|")
    notes = comment_contexts(comments, ["tree_id", "comment_no"]).select("tree_id", F.struct(
        F.lit(1).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.col("comment_no").cast("int").alias("i"),
        F.col("batch_no").cast("int").alias("j"), "context").alias("c"))
    if paths is None:
        said = notes.groupBy("tree_id").agg(F.array_join(F.array_sort(F.collect_list("c"))["context"], " ").alias("said"))
        j = units.select("tree_id", target.alias("target")).join(contexts.hint("merge"), "tree_id", "left").join(said.hint("merge"), "tree_id", "left")
        return j.select("tree_id", F.concat("target", F.lit(" "), F.concat_ws(" ", "text", "said")).alias("line"))
    bags = paths.unionByName(notes).groupBy("tree_id").agg(F.array_sort(F.collect_list("c"))["context"].alias("cs"))
    return units.select("tree_id", target.alias("target")).join(bags.hint("merge"), "tree_id", "left").select(
        "tree_id", F.concat("target", F.lit(" "), F.coalesce(F.array_join("cs", " "), F.lit(""))).alias("line"))
