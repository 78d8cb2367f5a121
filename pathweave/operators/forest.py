"""Trees whole in a task: packing them, and numpy kernels over tables of whole trees.

``by_tree`` writes a node table once, as rows that each hold whole trees, and runs a job on the
unpacked nodes: a task then sees its trees one after another, so that chains, ordinals and pairs
need no shuffle. Trees of more than ``LARGE`` nodes, those whose inner nodes repeat and nodes
without a tree go the distributed way of ``trees`` (``whole=False``), so no task has to hold a tree
of any size. Kernels take slices of about ``ROWS`` nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .ranking import stored

ROWS = 1 << 15  # nodes of a slice
LARGE = 1 << 14  # nodes from which a tree is not held by a task
PAIRS = 1 << 19  # candidate pairs made at once


# ---------------------------------------------------------------- slices
def _begins(ids: pa.Array) -> np.ndarray:
    """Whether a row's tree differs from that of the row before (the first row: True)."""
    new = np.ones(len(ids), bool)
    if len(ids) > 1:
        a, b = ids[1:], ids[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] = differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def tree_slices(batches: Iterator[pa.RecordBatch], rows: int, large: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """(table, whole): tables of whole trees of about ``rows`` rows; a tree that passes ``large`` rows
    comes in pieces that are not whole. Rows of a tree must follow each other."""
    ready, held, going, last = [], [], False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("tree_id")
        new = _begins(ids)
        new[0] = last is None or last.as_py() != ids[0].as_py()
        last = ids[len(ids) - 1]
        at = np.flatnonzero(new)
        if going:
            end = int(at[0]) if len(at) else batch.num_rows
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), False
            if not len(at):
                continue
            batch, at, going = batch.slice(end), at - end, False
        if len(at):
            ready += [*held, batch.slice(0, int(at[-1]))]
            held = []
            batch = batch.slice(int(at[-1]))
        held.append(batch)
        if sum(b.num_rows for b in ready) >= rows:
            yield pa.Table.from_batches(ready), True
            ready = []
        if large is not None and sum(b.num_rows for b in held) > large:
            yield pa.Table.from_batches(held), False
            held, going = [], True
    if ready or held:
        yield pa.Table.from_batches(ready + held), True


def flat(table: pa.Table) -> dict[str, pa.Array]:
    return {c: table.column(c).combine_chunks() for c in table.column_names}


def numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def codes(*arrays: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers of equal values over several arrays (null: -1), and the values."""
    d = pa.concat_arrays(arrays).dictionary_encode()
    c = numbers(pc.fill_null(d.indices.cast(pa.int64()), -1))
    ends = np.cumsum([0, *map(len, arrays)])
    return [c[i:j] for i, j in zip(ends[:-1], ends[1:])], d.dictionary


class Links:
    """Rows of a slice of whole trees: number of the tree, row of the parent (-1: none in the tree)."""

    def __init__(self, c: dict[str, pa.Array]):
        self.tree = np.cumsum(_begins(c["tree_id"])) - 1
        (node, parent), values = codes(c["node_id"], c["parent_id"])
        span = len(values) + 1
        own = np.where(node >= 0, self.tree * span + node, -1)
        to = np.where(parent >= 0, self.tree * span + parent, -2)
        order = np.argsort(own, kind="stable")
        place = np.searchsorted(own[order], to)
        row = order[np.minimum(place, len(order) - 1)]
        self.up = np.where((to >= 0) & (own[row] == to), row, -1)
        self.childless = np.ones(len(own), bool)
        self.childless[self.up[self.up >= 0]] = False
        # further rows with the id of an inner node
        twice = np.zeros(len(own), bool)
        twice[order[1:]] = (own[order][1:] == own[order][:-1]) & (own[order][1:] >= 0)
        mates = np.zeros(len(own), bool)
        mates[order[:-1]] = twice[order[1:]]
        inner = np.unique(own[~self.childless])
        self.repeats = (twice | mates) & np.isin(own, inner)

    def levels(self, limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ancestors k up) for k = 1, 2, ..."""
        rows = np.flatnonzero(self.up >= 0)
        at, k = self.up[rows], 0
        while len(rows) and (limit is None or k < limit):
            k += 1
            if k > len(self.up):
                raise ValueError("parents form a cycle")
            yield rows, at
            on = self.up[at] >= 0
            rows, at = rows[on], self.up[at[on]]


# ---------------------------------------------------------------- packing
def packed(nodes: DataFrame, rows: int = 1 << 12, large: int = LARGE) -> DataFrame:
    """(whole, nodes): each row some whole trees, or a piece of what is not for one task. Written."""
    kind = ST.StructType([ST.StructField("whole", ST.BooleanType()), ST.StructField("nodes", ST.ArrayType(nodes.schema))])

    def pack(batches):
        def row(table, whole):
            c = flat(table)
            s = pa.StructArray.from_arrays(list(c.values()), names=list(c))
            return pa.RecordBatch.from_arrays([pa.array([whole]), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), s)], names=["whole", "nodes"])

        for table, whole in tree_slices(batches, rows, large):
            if not table.num_rows:
                continue
            if whole:
                c = flat(table)
                links = Links(c)
                apart = links.repeats | numbers(c["tree_id"].is_null())
                if apart.any():
                    apart = np.isin(links.tree, links.tree[apart])
                    yield row(table.filter(pa.array(apart)), False)
                    table = table.filter(pa.array(~apart))
            for i in range(0, table.num_rows, table.num_rows if whole else rows):
                yield row(table if whole else table.slice(i, rows), whole)

    # dealt and ordered already, if the plan tells so
    by = nodes.repartition("tree_id").sortWithinPartitions("tree_id", "node_id")
    return stored(by.mapInArrow(pack, kind))


def by_tree(nodes: DataFrame, job: Callable[[DataFrame, bool], DataFrame], large: int = LARGE) -> DataFrame:
    """job(nodes, whole) of the trees that fit a task, united with that of the others, if any."""
    p = packed(nodes, large=large)

    def rows(whole):
        return p.filter(F.col("whole") == whole).select(F.explode("nodes").alias("n")).select("n.*")

    out = job(rows(True), True)
    if p.filter(~F.col("whole")).limit(1).count():
        out = out.unionByName(job(stored(rows(False)), False))
    return out


def kernel(df: DataFrame, f: Callable[[dict[str, pa.Array]], Iterator[dict[str, pa.Array]] | dict[str, pa.Array]], schema: ST.StructType) -> DataFrame:
    """f on the columns of each slice of whole trees -> columns (a dict, or several in turn)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches):
        for table, _ in tree_slices(batches, ROWS):
            if not table.num_rows:
                continue
            got = f(flat(table))
            for c in [got] if isinstance(got, dict) else got:
                yield pa.RecordBatch.from_arrays([c[x.name] if c[x.name].type == x.type else c[x.name].cast(x.type) for x in kind], schema=kind)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, f: Callable, added: dict[str, ST.DataType]) -> DataFrame:
    """The rows with columns that f makes of a slice's."""
    schema = ST.StructType([*(x for x in df.schema.fields if x.name not in added), *(ST.StructField(k, t) for k, t in added.items())])
    return kernel(df, lambda c: c | f(c), schema)


# ---------------------------------------------------------------- nodes
def document_order(c: dict[str, pa.Array], tree: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """1-based number of each row within its tree (and ``by``) in the order of node ids."""
    ids = c["node_id"]
    group = tree if by is None else np.unique(tree * (int(by.max(initial=0)) + 2) + by + 1, return_inverse=True)[1]
    same = tree[1:] == tree[:-1]
    rising = pc.fill_null(pc.less_equal(ids[:-1], ids[1:]), False).to_numpy(zero_copy_only=False)
    if (rising | ~same).all():
        order = np.argsort(group, kind="stable")
    else:
        by_id = numbers(pc.array_sort_indices(ids, null_placement="at_start"))
        order = by_id[np.argsort(group[by_id], kind="stable")]
    g = group[order]
    start = np.zeros(len(g), np.int64)
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    start[new] = new
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.maximum.accumulate(start) + 1
    return out


def ordinals(df: DataFrame) -> DataFrame:
    return with_columns(df, lambda c: {"ord": pa.array(document_order(c, np.cumsum(_begins(c["tree_id"])) - 1), pa.int32())}, {"ord": ST.IntegerType()})


def siblings(df: DataFrame) -> DataFrame:
    def f(c):
        (parent,), _ = codes(c["parent_id"])
        return {"sib": pa.array(document_order(c, np.cumsum(_begins(c["tree_id"])) - 1, parent) - 1, pa.int32())}

    return with_columns(df, f, {"sib": ST.IntegerType()})


def sizes(df: DataFrame, name: str) -> DataFrame:
    """The rows with the number of rows of their tree."""
    def f(c):
        tree = np.cumsum(_begins(c["tree_id"])) - 1
        return {name: pa.array(np.bincount(tree)[tree])}

    return with_columns(df, f, {name: ST.LongType()})


def childless(df: DataFrame) -> DataFrame:
    return with_columns(df, lambda c: {"childless": pa.array(Links(c).childless)}, {"childless": ST.BooleanType()})


def closure(df: DataFrame, worded: str) -> DataFrame:
    """(tree_id, node_id, n_desc, n_leaves) of inner nodes; ``worded``: a column that leaves meet."""
    schema = ST.StructType([df.schema["tree_id"], df.schema["node_id"], ST.StructField("n_desc", ST.LongType()), ST.StructField("n_leaves", ST.LongType())])

    def f(c):
        links = Links(c)
        up, depth, at, rounds = links.up, np.zeros(len(links.up), np.int64), links.up.copy(), 0
        step = (up >= 0).astype(np.int64)
        while (at >= 0).any():  # pointer doubling
            if (rounds := rounds + 1) > 40:
                raise ValueError("parents form a cycle")
            on = np.flatnonzero(at >= 0)
            step[on] += step[at[on]]
            at[on] = at[at[on]]
        depth = step
        desc = np.zeros(len(up), np.int64)
        own = (links.childless & numbers(pc.fill_null(c[worded], False))).astype(np.int64)
        order = np.argsort(-depth, kind="stable")
        ends = np.flatnonzero(np.concatenate([np.diff(depth[order]) != 0, [True]])) + 1
        begin = 0
        for end in ends:  # from the deepest level up
            rows = order[begin:end]
            rows, begin = rows[up[rows] >= 0], end
            np.add.at(desc, up[rows], desc[rows] + 1)
            np.add.at(own, up[rows], own[rows])
        inner = np.flatnonzero(~links.childless)
        return {"tree_id": c["tree_id"].take(pa.array(inner)), "node_id": c["node_id"].take(pa.array(inner)),
                "n_desc": pa.array(desc[inner]), "n_leaves": pa.array(own[inner])}

    return kernel(df, f, schema)


def chains(df: DataFrame, me: list[str], limit: int | None, columns: tuple[str, ...] | None) -> DataFrame:
    """childless, up, depth, me (or just the columns named): see ``trees.ancestor_chains``."""
    one = ST.StructType([df.schema[x] for x in me])

    def f(c):
        links = Links(c)
        levels = list(links.levels(limit))
        depth = np.zeros(len(links.up), np.int64)
        for rows, _ in levels:
            depth[rows] += 1
        offsets = np.concatenate([[0], np.cumsum(depth)])
        take = np.empty(offsets[-1], np.int64)
        for k, (rows, at) in enumerate(levels):
            take[offsets[rows] + k] = at
        whole = pa.StructArray.from_arrays([c[x] for x in me], names=me)
        return c | {"childless": pa.array(links.childless), "up": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole.take(pa.array(take))),
                "depth": pa.array(depth, pa.int32()), "me": whole}

    added = {"childless": ST.BooleanType(), "up": ST.ArrayType(one), "depth": ST.IntegerType(), "me": one}
    fields = [*df.schema.fields, *(ST.StructField(k, t) for k, t in added.items())]
    return kernel(df, f, ST.StructType([x for x in fields if columns is None or x.name in columns]))


# ---------------------------------------------------------------- names
def _groups(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of equal keys in an order that sorts them, and the number of each row's group."""
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(k)]]))
    of = np.empty(len(k), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), sizes)
    return starts, sizes, of


def variables(df: DataFrame) -> DataFrame:
    """See ``trees.variables``."""
    types = {"first_ord": df.schema["ord"].dataType, "n_leaves": ST.LongType(), "is_const": ST.BooleanType(), "is_literal": ST.BooleanType(),
             "leaves": ST.ArrayType(ST.StringType())}
    schema = ST.StructType([df.schema["tree_id"], df.schema["var"], *(ST.StructField(k, t) for k, t in types.items())])

    def f(c):
        tree = np.cumsum(_begins(c["tree_id"])) - 1
        (var,), values = codes(c["var"])
        key, ord_ = tree * (len(values) + 1) + var + 1, numbers(c["ord"])
        order = np.lexsort((ord_, key))
        starts, sizes, _ = _groups(key, order)
        first = pa.array(order[starts])
        const, known = numbers(pc.fill_null(c["is_const"], True))[order], numbers(c["is_const"].is_valid())[order]
        all_, any_ = (np.logical_and.reduceat(const, starts), np.logical_or.reduceat(known, starts)) if len(starts) else (const, known)
        return {"tree_id": c["tree_id"].take(first), "var": c["var"].take(first), "first_ord": c["ord"].take(first), "n_leaves": pa.array(sizes),
                "is_const": pa.array(all_, mask=~any_), "is_literal": c["is_literal_kind"].take(first),
                "leaves": pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(order)]]), pa.int32()), c["node_id"].take(pa.array(order)))}

    return kernel(df, f, schema)


def drawn(tree: str | None, n: int, most: int, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i <= j: the first ``most`` pairs of the seeded permutation of ``trees.variable_pairs``."""
    from hashlib import md5

    A, B = (n // 2, n + 1) if n % 2 == 0 else (n, (n + 1) // 2)
    head = "|".join(x for x in (str(seed), tree) if x is not None)  # concat_ws leaves nulls out
    left, right = np.divmod(np.arange(min(most, n * (n + 1) // 2)), B)
    for i in range(rounds):
        moved, other, size = (left, right, A) if i % 2 == 0 else (right, left, B)
        values, which = np.unique(other, return_inverse=True)  # a side is hashed once per value
        m = np.array([int(md5(f"{head}|{i}|{v}".encode(), usedforsecurity=False).hexdigest()[:8], 16) for v in values.tolist()], np.int64)
        moved = (moved + m[which]) % size
        left, right = (moved, right) if i % 2 == 0 else (left, moved)
    t = left * B + right
    j = np.floor((np.sqrt(8.0 * t + 1) - 1) / 2).astype(np.int64)
    j = np.where((j + 1) * (j + 2) // 2 <= t, j + 1, np.where(j * (j + 1) // 2 > t, j - 1, j))
    return t - j * (j + 1) // 2, j


def _texts(c: dict[str, pa.Array], rows: np.ndarray) -> list[str | None]:
    return c["_tree"].take(pa.array(rows)).to_pylist()


def drawn_names(df: DataFrame, most: int | None, seed: int, rounds: int) -> DataFrame:
    """(tree_id, v1, v2, o1, o2, is_self) of names (tree_id, var, o, _tree): see ``trees.variable_pairs``."""
    schema = ST.StructType([df.schema["tree_id"], *(ST.StructField(v, ST.StringType()) for v in ("v1", "v2")),
                            *(ST.StructField(o, df.schema["o"].dataType) for o in ("o1", "o2")), ST.StructField("is_self", ST.BooleanType())])

    def f(c):
        tree = np.cumsum(_begins(c["tree_id"])) - 1
        order = np.lexsort((numbers(c["o"]), tree))
        starts, sizes, _ = _groups(tree, order)
        texts = _texts(c, order[starts])
        held, n = [], 0

        def out():
            a, b = (np.concatenate(x) for x in zip(*held))
            return {"tree_id": c["tree_id"].take(pa.array(a)), "v1": c["var"].take(pa.array(a)), "v2": c["var"].take(pa.array(b)),
                    "o1": c["o"].take(pa.array(a)), "o2": c["o"].take(pa.array(b)), "is_self": pa.array(a == b)}

        for s, size, text in zip(starts.tolist(), sizes.tolist(), texts):
            total = size * (size + 1) // 2
            if most is None or total <= most:
                j = np.repeat(np.arange(size), np.arange(1, size + 1))
                i = np.arange(total) - j * (j + 1) // 2
            else:
                i, j = drawn(text, size, most, seed, rounds)
            held.append((order[s + i], order[s + j]))
            n += len(i)
            if n >= PAIRS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return kernel(df, f, schema)


# ---------------------------------------------------------------- leaf pairs
class Sides:
    """One entry per (leaf, ancestor within reach): leaf row, steps k, number of the ancestor, child
    index on the leaf's side; entries are sorted by (ancestor, child index)."""

    def __init__(self, c: dict[str, pa.Array], leaf: np.ndarray, reach: int):
        up, me = c["up"], c["me"]
        first = up.offsets[0].as_py()
        self.inner = up.flatten()
        self.offset = numbers(up.offsets)[:-1].astype(np.int64) - first
        self.size = np.diff(numbers(up.offsets).astype(np.int64))
        self.tree = np.cumsum(_begins(c["tree_id"])) - 1
        self.index = {x: pa.concat_arrays([me.field(x), self.inner.field(x)]) for x in ("kind", "child_idx")}
        self.n = len(me)
        (node,), values = codes(self.inner.field("node_id"))
        leaves, ks, at = [], [], []
        for k in range(1, min(reach, int(self.size.max(initial=0))) + 1):
            rows = leaf[self.size[leaf] >= k]
            leaves.append(rows)
            ks.append(np.full(len(rows), k))
            at.append(self.offset[rows] + k - 1)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.leaf, self.k, self.at = join(leaves), join(ks), join(at)
        below = self.element(self.leaf, self.k - 1)
        ci = self.index["child_idx"].take(pa.array(below))
        known = numbers(ci.is_valid()) & (node[self.at] >= 0)
        self.keep(known)
        self.ci = numbers(pc.fill_null(ci, 0).cast(pa.int64()))[known]
        low = int(self.ci.min(initial=0))
        self.span = int(self.ci.max(initial=0)) - low + 1
        self.lca = self.tree[self.leaf] * (len(values) + 1) + node[self.at]
        _, self.lca = np.unique(self.lca, return_inverse=True)
        self.key = self.lca * self.span + self.ci - low
        order = np.argsort(self.key, kind="stable")
        self.keep(order)
        self.ci, self.lca, self.key, self.low = self.ci[order], self.lca[order], self.key[order], low

    def keep(self, which):
        self.leaf, self.k, self.at = self.leaf[which], self.k[which], self.at[which]

    def element(self, rows: np.ndarray, i) -> np.ndarray:
        """Place in ``index`` of a row's chain's element i (0: the row itself)."""
        return np.where(i == 0, rows, self.n + self.offset[rows] + i - 1)

    def ranges(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries (left, right) with keys of right in [low, high], some at once."""
        keys = self.key[right]
        a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        ends = np.cumsum(np.maximum(b - a, 0))
        i = 0
        while i < len(left):
            begun = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, begun + PAIRS, "right")))
            n = np.maximum(b[i:j] - a[i:j], 0)
            before = np.cumsum(n) - n
            for part in range(0, int(n.sum()), 4 * PAIRS):  # one entry may have very many
                where = np.arange(part, min(int(n.sum()), part + 4 * PAIRS))
                who = np.repeat(np.arange(j - i), n)[part : part + 4 * PAIRS] if n.sum() <= 4 * PAIRS else np.searchsorted(before, where, "right") - 1
                yield left[i + who], right[a[i + who] + where - before[who]]
            i = j


def _steps(values: list[pa.Array], sep: str = "") -> pa.Array:
    return pc.binary_join_element_wise(*values, sep)


class Pieces:
    """Texts of path pieces of chain elements, made once per distinct (kind, child index, parent's kind in the set)."""

    def __init__(self, sides: Sides, parents: tuple[str, ...], cap: int | None):
        kind, idx = sides.index["kind"], sides.index["child_idx"]
        idx = pc.min_element_wise(idx, pa.scalar(cap, idx.type)) if cap is not None else idx
        self.kind, self.id = kind, idx.cast(pa.string())
        self.marked = numbers(pc.fill_null(pc.is_in(kind, pa.array(parents, pa.string())), False))

    def text(self, at: np.ndarray, numbered: np.ndarray, before: str, after: str) -> pa.Array:
        """before + kind + (child index where numbered) + after; null where a part is null."""
        id_ = pc.if_else(pa.array(numbered), self.id.take(pa.array(at)), pa.scalar(""))
        n = len(at)
        return _steps([pa.repeat(before, n), self.kind.take(pa.array(at)), id_, pa.repeat(after, n)])


def java_texts(s: Sides, cap: int | None, parents: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """Up and down pieces of the entries, as ``trees.java_path_pieces``."""
    p = Pieces(s, parents, cap)

    def marked_parent(rows, i):  # the element after i, if the chain goes on
        has = s.size[rows] >= i + 1
        at = s.element(rows, np.where(has, i + 1, 0))
        return p.marked[at] & has

    def down(rows, i):
        at = s.element(rows, np.full(len(rows), i))
        return p.text(at, np.full(len(rows), i == 0) | p.marked[at], "_(", ")")

    def up(rows, i):
        at = s.element(rows, np.full(len(rows), i))
        return p.text(at, np.full(len(rows), i == 0) | marked_parent(rows, i), "(", ")^")

    def top(rows, k):
        return p.text(s.element(rows, np.full(len(rows), k)), marked_parent(rows, k), "(", ")")

    return _folded(s, up, top, down)


def cs_texts(s: Sides, cap: int, parents: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """Up and down pieces of the entries, as ``trees.cs_path_pieces``."""
    p = Pieces(s, parents, cap)

    def piece(rows, i, before, after):
        has = s.size[rows] >= i + 1
        return p.text(s.element(rows, np.full(len(rows), i)), p.marked[s.element(rows, np.where(has, i + 1, 0))] & has, before, after)

    def top(rows, k):
        return p.kind.take(pa.array(s.element(rows, np.full(len(rows), k))))

    none = lambda rows: pa.repeat("", len(rows))
    return _folded(s, lambda r, i: piece(r, i, "", "^") if i else none(r), top, lambda r, i: piece(r, i, "_", "") if i else none(r))


def _folded(s: Sides, up: Callable, top: Callable, down: Callable) -> tuple[pa.Array, pa.Array]:
    """up(0) + ... + up(k - 1) + top(k), and down(k - 1) + ... + down(0), of every entry; null pieces are left out."""
    n = s.n
    ups, downs, place = [], [], []
    rows, before, after = None, None, None
    for k in range(1, int(s.k.max(initial=0)) + 1):
        entries = np.flatnonzero(s.k == k)
        mine = np.unique(np.concatenate([s.leaf[s.k >= k]]))  # rows that go on
        if rows is None:
            before = after = pa.repeat("", len(mine))
        else:
            at = pa.array(np.searchsorted(rows, mine))
            before, after = before.take(at), after.take(at)
        rows = mine
        before = _steps([before, pc.fill_null(up(rows, k - 1), "")])
        after = _steps([pc.fill_null(down(rows, k - 1), ""), after])
        at = pa.array(np.searchsorted(rows, s.leaf[entries]))
        ups.append(_steps([before.take(at), top(s.leaf[entries], k)]))
        downs.append(after.take(at))
        place.append(entries)
    if not place:
        return pa.repeat("", 0), pa.repeat("", 0)
    back = np.empty(len(s.k), np.int64)
    back[np.concatenate(place)] = np.arange(len(s.k))
    return pa.concat_arrays(ups).take(pa.array(back)), pa.concat_arrays(downs).take(pa.array(back))


MASK = np.uint64(0xFFFFFFFF)


def text_state(text: str) -> tuple[int, int]:
    """Java's hash of a text and 31 ** its units, unsigned, as ``names.hash_state``."""
    h, p, raw = 0, 1, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        unit = raw[i] * 256 + raw[i + 1]
        h, p = (h * 31 + unit) & 0xFFFFFFFF, (p * 31 if unit else p) & 0xFFFFFFFF
    return h, p


def _states(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and powers of texts, made once per distinct text (null: 0)."""
    d = texts.dictionary_encode()
    made = np.array([text_state(t) for t in d.dictionary.to_pylist()] + [(0, 0)], np.uint64)
    return tuple(made[numbers(pc.fill_null(d.indices.cast(pa.int64()), -1))].T)


PIECES = ST.StructType([ST.StructField(x, ST.LongType()) for x in ("uh", "up", "ch", "cp", "dh", "dp")])


def pieces(df: DataFrame, cap: int | None, parents: tuple[str, ...]) -> DataFrame:
    """The nodes with the hashes of their path pieces: see ``trees.with_piece_hashes``."""
    def f(c):
        up, n = Links(c).up, len(c["kind"])
        marked = numbers(pc.fill_null(pc.is_in(c["kind"], pa.array(parents, pa.string())), False))
        ids = (pc.min_element_wise(c["child_idx"], pa.scalar(cap, c["child_idx"].type)) if cap is not None else c["child_idx"]).cast(pa.string())
        numbered = lambda which: pc.if_else(pa.array(which), ids, pa.scalar(""))
        (ch, cp), (dh, dp) = (_states(_steps([pa.repeat(x, n), c["kind"], numbered(which), pa.repeat(")", n)]))
                              for x, which in (("(", (up >= 0) & marked[up]), ("_(", marked)))
        known = numbers(c["kind"].is_valid())
        parts = [(ch * np.uint64(31) + np.uint64(ord("^"))) & MASK, (cp * np.uint64(31)) & MASK, ch, cp, dh, dp]
        return {"pieces": pa.StructArray.from_arrays([pa.array(x.astype(np.int64), mask=~known) for x in parts], names=PIECES.names)}

    return with_columns(df, f, {"pieces": PIECES})


def java_hashes(s: Sides, c: dict[str, pa.Array], cap: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of up pieces with the ancestor's, of down pieces, and 31 ** length of those, from ``pieces``."""
    pieces = {x: numbers(pc.fill_null(s.inner.field("pieces").field(x), 0)).astype(np.uint64) for x in PIECES.names}
    p, rows = Pieces(s, (), cap), np.arange(s.n)
    always = np.ones(s.n, bool)
    lh, _ = _states(p.text(rows, always, "(", ")^"))
    dh, dp = _states(p.text(rows, always, "_(", ")"))
    hu, hd, pd_ = lh[s.leaf], dh[s.leaf], dp[s.leaf]
    for i in range(1, int(s.k.max(initial=1))):
        on = np.flatnonzero(s.k > i)
        at = s.offset[s.leaf[on]] + i - 1
        hu[on] = (hu[on] * pieces["up"][at] + pieces["uh"][at]) & MASK
        hd[on] = (pieces["dh"][at] * pd_[on] + hd[on]) & MASK
        pd_[on] = (pieces["dp"][at] * pd_[on]) & MASK
    hu = (hu * pieces["cp"][s.at] + pieces["ch"][s.at]) & MASK
    return hu, hd, pd_


def text_hashes(texts: pa.Array) -> pa.Array:
    """Java's hashCode of texts as text, once per distinct text."""
    d = texts.dictionary_encode()
    signed = np.array([text_state(t)[0] for t in d.dictionary.to_pylist()], np.uint32).view(np.int32)
    return pa.array(signed).cast(pa.string()).take(d.indices)


def _rows(mask: pa.Array) -> np.ndarray:
    return np.flatnonzero(numbers(pc.fill_null(mask, False)))


def java_pairs(c: dict[str, pa.Array], leaf: np.ndarray, want: tuple[str, ...], max_length: int, max_width: int, cap: int | None,
               parents: tuple[str, ...]) -> Iterator[dict[str, pa.Array]]:
    """Columns of the pairs of ``trees.leaf_pairs``, tree by tree."""
    s = Sides(c, leaf, max_length)
    ord_ = np.zeros(s.n, np.int64)
    if {"l_ord", "r_ord"} & set(want) and len(leaf):
        ord_[leaf] = document_order({"node_id": c["node_id"].take(pa.array(leaf))}, s.tree[leaf])
    hashed = "pieces" in [x.name for x in c["me"].type]
    texts = java_texts(s, cap, parents) if "path" in want or ("path_hash" in want and not hashed) else None
    hashes = java_hashes(s, c, cap) if "path_hash" in want and hashed else None
    every, top = np.arange(len(s.key)), (s.lca + 1) * s.span - 1
    for left, right in s.ranges(every, every, s.key + 1, np.minimum(s.key + max_width, top)):
        near = s.k[left] + s.k[right] <= max_length
        left, right = left[near], right[near]
        a, b = s.leaf[left], s.leaf[right]
        out = {}
        for x in want:
            if x in ("path", "path_hash") and x not in out and texts is not None:
                out["path"] = _steps([texts[0].take(pa.array(left)), texts[1].take(pa.array(right))])
            if x == "path_hash" and hashes is None:
                out[x] = text_hashes(out["path"])
            elif x == "path_hash":
                hu, hd, p = hashes
                h = ((hu[left] * p[right] + hd[right]) & MASK).astype(np.uint32).view(np.int32)
                out[x] = pa.array(h).cast(pa.string())
            elif x != "path":
                out[x] = {"tree_id": lambda: c["tree_id"].take(pa.array(a)), "l": lambda: c["node_id"].take(pa.array(a)), "r": lambda: c["node_id"].take(pa.array(b)),
                          "l_ord": lambda: pa.array(ord_[a], pa.int32()), "r_ord": lambda: pa.array(ord_[b], pa.int32()),
                          "a_id": lambda: s.inner.field("node_id").take(pa.array(s.at[left])), "kl": lambda: pa.array(s.k[left], pa.int32()),
                          "kr": lambda: pa.array(s.k[right], pa.int32()), "width": lambda: pa.array(s.ci[right] - s.ci[left], pa.int32()),
                          "src": lambda: c["name"].take(pa.array(a)), "dst": lambda: c["name"].take(pa.array(b)), "_of": lambda: c["_of"].take(pa.array(a))}[x]()
        yield {x: out[x] for x in want}


def joined(tree: np.ndarray, keys: list[np.ndarray], texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Texts of each tree in the order of keys, then of the texts, joined by blanks: (trees, texts)."""
    order = np.lexsort((*keys[::-1], tree))
    by = [x[order] for x in (tree, *keys)]
    if len(texts) and np.logical_and.reduce([x[1:] == x[:-1] for x in by]).any():  # texts decide
        place = np.empty(len(texts), np.int64)
        place[numbers(pc.array_sort_indices(texts))] = np.arange(len(texts))
        order = np.lexsort((place, *keys[::-1], tree))
    starts, _, _ = _groups(tree, order)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(order)]]), pa.int32()), texts.take(pa.array(order)))
    return tree[order[starts]], pc.binary_join(lists, " ")


def cs_pairs(c: dict[str, pa.Array], want: tuple[str, ...], max_length: int, max_width: int, cap: int, parents: tuple[str, ...],
             most: int | None, seed: int, rounds: int) -> Iterator[dict[str, pa.Array]]:
    """Columns of the pairs of ``trees.cs_leaf_pairs``; with ``most`` those of the drawn names only."""
    s = Sides(c, np.arange(len(c["tree_id"])), max_length)
    (var,), values = codes(c["var"])
    ord_ = numbers(c["ord"]).astype(np.int64)
    order = np.lexsort((ord_, var, s.tree))
    starts, sizes, name = _groups(s.tree * (len(values) + 1) + var + 1, order)
    first = ord_[order[starts]][name]  # of the row's name
    allowed = base = number = None
    if most is not None and len(starts):
        # names of a tree in first-seen order
        head = order[starts]
        seen = np.lexsort((ord_[head], s.tree[head]))
        begins, counts, _ = _groups(s.tree[head], seen)
        of = np.empty(len(head), np.int64)
        of[seen] = np.arange(len(head)) - np.repeat(begins, counts)
        number, span = of[name], int(counts.max()) + 1
        big = counts * (counts + 1) // 2 > most
        texts = _texts(c, head[seen[begins]])
        found = []
        for t in np.flatnonzero(big):
            i, j = drawn(texts[t], int(counts[t]), most, seed, rounds)
            found.append((t * span + i) * span + j)
        allowed = np.sort(np.concatenate(found)) if found else None
        base, large = s.tree * span, big[s.tree]
    texts = cs_texts(s, cap, parents) if {"path", "context"} & set(want) else None
    every = np.arange(len(s.key))
    direct, others = every[s.k == 1], every[s.k >= 2]
    low, top = s.lca * s.span, (s.lca + 1) * s.span - 1

    def parts():  # (left, right) entries
        w = max_width - 1
        yield from s.ranges(others, others, np.maximum(s.key[others] - w, low[others]), np.minimum(s.key[others] + w, top[others]))
        yield from s.ranges(direct, every, low[direct], top[direct])
        yield from s.ranges(others, direct, low[others], top[others])

    for left, right in parts():
        a, b = s.leaf[left], s.leaf[right]
        ok = (s.ci[left] != s.ci[right]) & (s.k[left] + s.k[right] <= max_length) & (first[a] <= first[b])
        left, right, a, b = left[ok], right[ok], a[ok], b[ok]
        if allowed is not None:
            key = (base[a] + number[a]) * span + number[b]
            at = np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)
            ok = ~large[a] | (allowed[at] == key)
            left, right, a, b = left[ok], right[ok], a[ok], b[ok]
        take = lambda x, i: c[x].take(pa.array(i))
        path = _steps([texts[0].take(pa.array(left)), texts[1].take(pa.array(right))]) if texts is not None else None
        make = {"tree_id": lambda: take("tree_id", a), "lhs": lambda: take("node_id", a), "rhs": lambda: take("node_id", b), "lvar": lambda: take("var", a),
                "rvar": lambda: take("var", b), "ltok": lambda: take("token", a), "rtok": lambda: take("token", b),
                "a_id": lambda: s.inner.field("node_id").take(pa.array(s.at[left])), "kl": lambda: pa.array(s.k[left], pa.int32()),
                "kr": lambda: pa.array(s.k[right], pa.int32()), "is_self": lambda: pa.array(first[a] == first[b]), "path": lambda: path,
                "_of": lambda: pa.array(s.tree[a]), "_l": lambda: pa.array(a), "_r": lambda: pa.array(b),
                "context": lambda: _steps([take("label", a), text_hashes(path), take("label", b)], ",")}
        yield {x: make[x]() for x in want}


# ---------------------------------------------------------------- results per tree
PAIR_TYPES = {x: ST.StringType() for x in ("l", "r", "a_id", "src", "dst", "path", "path_hash", "lhs", "rhs", "lvar", "rvar", "ltok", "rtok", "context")} | {
    x: ST.IntegerType() for x in ("l_ord", "r_ord", "kl", "kr", "width")} | {"is_self": ST.BooleanType()}


def _schema(df: DataFrame, columns: tuple[str, ...]) -> ST.StructType:
    return ST.StructType([df.schema["tree_id"] if x == "tree_id" else ST.StructField(x, PAIR_TYPES[x]) for x in columns])


def leaf_pairs(lv: DataFrame, columns: tuple[str, ...], *rules) -> DataFrame:
    """lv: leaves with up, me and, for texts, name."""
    return kernel(lv, lambda c: java_pairs(c, np.arange(len(c["tree_id"])), columns, *rules), _schema(lv, columns))


def unit_lines(rows: DataFrame, *rules) -> DataFrame:
    """(tree_id, line): for each row with ``named`` its target and the contexts of the pairs of rows with
    ``leaf``, in (l_ord, r_ord) order; trees without pairs have none."""
    want = ("tree_id", "l_ord", "r_ord", "src", "path_hash", "dst")

    def f(c):
        tree = np.cumsum(_begins(c["tree_id"])) - 1
        leaf = _rows(c["leaf"])
        part = {k: v.take(pa.array(leaf)) for k, v in c.items()}
        of, found = np.cumsum(_begins(part["tree_id"])) - 1, []
        for x in java_pairs(part | {"_of": pa.array(of)}, np.arange(len(leaf)), (*want, "_of"), *rules):
            texts = _steps([pc.fill_null(x["src"], ""), pc.fill_null(x["path_hash"], ""), pc.fill_null(x["dst"], "")], ",")
            found.append((numbers(x["_of"]), numbers(x["l_ord"]), numbers(x["r_ord"]), texts))
        if not found:
            return
        numbers_ = [np.concatenate(x) for x in list(zip(*found))[:3]]
        if not len(numbers_[0]):
            return
        of_, lines = joined(numbers_[0], numbers_[1:], pa.concat_arrays([x[3] for x in found]))
        trees = tree[leaf[np.searchsorted(of, of_)]]
        named = _rows(c["named"])
        at = np.searchsorted(trees, tree[named])
        has = (at < len(trees)) & (trees[np.minimum(at, len(trees) - 1)] == tree[named])
        named, at = named[has], at[has]
        yield {"tree_id": c["tree_id"].take(pa.array(named)), "line": _steps([c["target"].take(pa.array(named)), lines.take(pa.array(at))], " ")}

    return kernel(rows, f, ST.StructType([rows.schema["tree_id"], ST.StructField("line", ST.StringType())]))


def cs_leaf_pairs(lv: DataFrame, columns: tuple[str, ...], *rules) -> DataFrame:
    """lv: leaf records with up, me, ord, var (and token, label, _tree)."""
    return kernel(lv, lambda c: cs_pairs(c, columns, *rules), _schema(lv, columns))


def cs_unit_texts(lv: DataFrame, *rules) -> DataFrame:
    """(tree_id, text): the contexts of each tree's pairs in the order of lhs, rhs, joined by blanks."""
    def f(c):
        tree = np.cumsum(_begins(c["tree_id"])) - 1
        (code,), values = codes(c["node_id"])
        place = np.empty(len(values) + 1, np.int64)
        place[numbers(pc.array_sort_indices(values))] = np.arange(len(values))
        found = [(numbers(x["_of"]), place[code[numbers(x["_l"])]], place[code[numbers(x["_r"])]], x["context"])
                 for x in cs_pairs(c, ("_of", "_l", "_r", "context"), *rules)]
        if found and sum(len(x[0]) for x in found):
            keys = [np.concatenate(x) for x in list(zip(*found))[:3]]
            of, texts = joined(keys[0], keys[1:], pa.concat_arrays([x[3] for x in found]))
            yield {"tree_id": c["tree_id"].take(pa.array(np.searchsorted(tree, of))), "text": texts}

    return kernel(lv, f, ST.StructType([lv.schema["tree_id"], ST.StructField("text", ST.StringType())]))
