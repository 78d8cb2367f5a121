"""DuckDB text of the fixtures, used as CTEs in the oracle SQL.

They mirror ``pathweave.sources.fixtures`` and FIXTURES.md.
"""

from __future__ import annotations

FX_SQL: dict[str, str] = {}

FX_SQL["fx_ctx"] = """
SELECT l_orderkey AS ex,
       cast(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS int) AS pos,
       'cust' || cast(o_custkey AS varchar) AS grp,
       replace(lower(substr(o_orderpriority, 3)), ' ', '|') || '|' || lower(c_mktsegment) AS target,
       split_part(p_name, ' ', 1) AS src,
       p_type || '^' || l_returnflag || '_' || l_linestatus AS path,
       split_part(p_name, ' ', 2) AS dst
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
"""

FX_SQL["fx_split"] = """
SELECT ex, grp,
       CASE WHEN substr(md5('42|' || grp), 1, 1) IN ('0', '1') THEN 'val'
            WHEN substr(md5('42|' || grp), 1, 1) IN ('2', '3') THEN 'test'
            ELSE 'train' END AS role
FROM (SELECT DISTINCT ex, grp FROM fx_ctx) d
"""

FX_SQL["fx_ctxr"] = """
SELECT c.*, CASE WHEN substr(md5('42|' || grp), 1, 1) IN ('0', '1') THEN 'val'
            WHEN substr(md5('42|' || grp), 1, 1) IN ('2', '3') THEN 'test'
            ELSE 'train' END AS role
FROM fx_ctx c
"""

FX_SQL["fx_words"] = """
SELECT doc_id, cast(line_no AS int) AS line_no, cast(pos AS int) AS pos, replace(w, ',', '') AS w FROM (
  SELECT doc_id, line_no, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (
    SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM (
      SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))) WHERE replace(w, ',', '') <> ''
"""

FX_SQL["fx_nodes"] = """
SELECT ex AS tree_id, 'r' AS node_id, cast(NULL AS varchar) AS parent_id, 0 AS child_idx, 'Order' AS kind, cast(NULL AS varchar) AS token
FROM (SELECT DISTINCT ex FROM fx_ctx) a
UNION ALL
SELECT ex, 'r/00', 'r', 0, 'NameExpr', target FROM (SELECT DISTINCT ex, target FROM fx_ctx) b
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar), 'r', cast(pos AS int), 'Line', cast(NULL AS varchar) FROM fx_ctx
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/0', 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar), 0, 'Flag', split_part(split_part(path, '^', 2), '_', 1) FROM fx_ctx
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/1', 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar), 1, 'Status', split_part(path, '_', 2) FROM fx_ctx
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/2', 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar), 2, 'Part', cast(NULL AS varchar) FROM fx_ctx
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/2/0', 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/2', 0, 'Word', src FROM fx_ctx
UNION ALL
SELECT ex, 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/2/1', 'r/' || lpad(cast(length(cast(pos AS varchar)) AS varchar), 2, '0') || cast(pos AS varchar) || '/2', 1, 'Word', dst FROM fx_ctx
"""

FX_SQL["fx_preds"] = """
SELECT p.p_partkey AS ex, replace(p.p_name, ' ', '|') AS original, cast(t.i AS int) AS rank,
       CASE WHEN t.i = 3 THEN '<PAD_OR_OOV>' WHEN t.i = 5 THEN lower(q.p_brand)
            ELSE replace(q.p_name, ' ', '|') END AS word,
       cast(1 AS double) / (t.i + 1) AS score
FROM part p
CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS t(i)
CROSS JOIN (SELECT count(*) AS n FROM part) c
JOIN part q ON q.p_partkey = (p.p_partkey * t.i * 7 + t.i * 37) % c.n
"""

FX_SQL["fx_idents"] = """
SELECT DISTINCT x FROM (SELECT p_name AS x FROM part UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events
  UNION ALL SELECT w FROM fx_words)
"""

# dependencies between fixtures, in definition order
FX_DEPS = {
    "fx_ctx": [],
    "fx_split": ["fx_ctx"],
    "fx_ctxr": ["fx_ctx"],
    "fx_words": [],
    "fx_nodes": ["fx_ctx"],
    "fx_preds": [],
    "fx_idents": ["fx_words"],
}


def with_fx(sql: str, *names: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False,
            once: tuple[str, ...] = ()) -> str:
    """Prefix ``sql`` with the CTEs of the named fixtures (and their deps),
    then any extra (name, body) CTEs in the order given. Those in ``once`` are
    computed once although read several times."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in FX_DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS {'MATERIALIZED ' if n in once else ''}({FX_SQL[n].strip()})" for n in order]
    for n, body in extra or []:
        ctes.append(f"{n} AS ({body.strip()})")
    if not ctes:
        return sql.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + sql.strip()


# ---------------------------------------------------------------------------
# Pipeline stages in DuckDB form (FIXTURE settings: max contexts 4,
# word cap 5, path cap 20, target cap 15, joined special word, seed 42).
# ---------------------------------------------------------------------------

def _stage(name: str, body: str, *deps: str) -> None:
    FX_SQL[name] = body
    FX_DEPS[name] = list(deps)


_stage("train", "SELECT * FROM fx_ctxr WHERE role = 'train'", "fx_ctxr")
_stage("tok_hist", """
SELECT w AS word, count(*) AS cnt FROM (SELECT src AS w FROM train UNION ALL SELECT dst FROM train) GROUP BY w
""", "train")
_stage("path_hist", "SELECT path AS word, count(*) AS cnt FROM train GROUP BY path", "train")
_stage("tgt_hist", "SELECT target AS word, count(*) AS cnt FROM (SELECT DISTINCT ex, target FROM train) GROUP BY target",
       "train")
for _k, _cap in (("tok", 5), ("path", 20), ("tgt", 15)):
    _stage(f"{_k}_rank", f"SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS r FROM {_k}_hist",
           f"{_k}_hist")
    _stage(f"{_k}_counts", f"""
SELECT word, cnt, r FROM {_k}_rank
WHERE cnt > coalesce((SELECT max(cnt) FROM {_k}_rank WHERE r = {_cap}), -1)
""", f"{_k}_rank")
    _stage(f"{_k}_vocab", f"""
SELECT '<PAD_OR_OOV>' AS word, 0 AS idx UNION ALL SELECT word, cast(r + 1 AS int) FROM {_k}_counts WHERE r < {_cap}
""", f"{_k}_counts")

_stage("tiers", """
SELECT c.*, s.word IS NOT NULL AS src_in, p.word IS NOT NULL AS path_in, d.word IS NOT NULL AS dst_in,
  CASE WHEN s.word IS NOT NULL AND p.word IS NOT NULL AND d.word IS NOT NULL THEN 1
       WHEN s.word IS NOT NULL OR p.word IS NOT NULL OR d.word IS NOT NULL THEN 2 ELSE 3 END AS tier
FROM fx_ctxr c
LEFT JOIN tok_counts s ON c.src = s.word
LEFT JOIN path_counts p ON c.path = p.word
LEFT JOIN tok_counts d ON c.dst = d.word
""", "fx_ctxr", "tok_counts", "path_counts")
_stage("flags", """
SELECT *, (n <= 4 OR (tier < 3 AND rn <= 4)) AS keep, cast(CASE WHEN n <= 4 THEN pos ELSE rn END AS int) AS spos
FROM (SELECT t.*, count(*) OVER (PARTITION BY ex) AS n,
             row_number() OVER (PARTITION BY ex ORDER BY tier, md5('42|' || cast(ex AS varchar) || '|' || cast(pos AS varchar))) AS rn
      FROM tiers t)
""", "tiers")
_stage("sampled", "SELECT ex, role, grp, target, src, path, dst, spos AS pos FROM flags WHERE keep", "flags")
_stage("encoded", """
SELECT s.*, coalesce(a.idx, 0) AS src_idx, coalesce(b.idx, 0) AS path_idx, coalesce(c.idx, 0) AS dst_idx,
       coalesce(t.idx, 0) AS target_idx,
       (coalesce(a.idx, 0) <> 0 OR coalesce(b.idx, 0) <> 0 OR coalesce(c.idx, 0) <> 0) AS valid
FROM sampled s
LEFT JOIN tok_vocab a ON s.src = a.word
LEFT JOIN path_vocab b ON s.path = b.word
LEFT JOIN tok_vocab c ON s.dst = c.word
LEFT JOIN tgt_vocab t ON s.target = t.word
""", "sampled", "tok_vocab", "path_vocab", "tgt_vocab")


# ---- metric stages over fx_preds -----------------------------------------
_stage("legal", """
SELECT *, cast(row_number() OVER (PARTITION BY ex ORDER BY rank) - 1 AS int) AS legal_rank FROM fx_preds
WHERE word <> '<PAD_OR_OOV>' AND regexp_full_match(word, '^[a-zA-Z|]+$')
""", "fx_preds")
_stage("first", """
SELECT e.ex, e.original, f.word AS prediction
FROM (SELECT DISTINCT ex, original FROM fx_preds) e LEFT JOIN (SELECT ex, word FROM legal WHERE legal_rank = 0) f
ON e.ex = f.ex
""", "legal")
_stage("conf", """
SELECT ex, original, prediction,
  cast(len(list_filter(p, lambda x: list_contains(o, x))) AS bigint) AS tp,
  cast(len(list_filter(p, lambda x: NOT list_contains(o, x))) AS bigint) AS fp,
  cast(len(list_filter(o, lambda x: NOT list_contains(p, x))) AS bigint) AS fn
FROM (SELECT *, string_split(original, '|') AS o,
        CASE WHEN prediction IS NULL THEN []::varchar[] ELSE string_split(prediction, '|') END AS p FROM first)
""", "first")
_stage("conf_nonan", """
SELECT ex, original, prediction,
  cast(len(list_filter(p, lambda x: list_contains(o, x))) AS bigint) AS tp,
  cast(len(list_filter(p, lambda x: NOT list_contains(o, x))) AS bigint) AS fp,
  cast(len(list_filter(o, lambda x: NOT list_contains(p, x))) AS bigint) AS fn
FROM (SELECT *, list_filter(string_split(original, '|'), lambda x: length(x) > 0) AS o,
        list_filter(string_split(prediction, '|'), lambda x: length(x) > 0) AS p
      FROM first WHERE prediction IS NOT NULL)
""", "first")


# ---- tree stages over fx_nodes (length limit 5, width limit 2) -----------
_stage("anc", """
SELECT tree_id, node_id, parent_id AS anc_id, 1 AS k FROM fx_nodes WHERE parent_id IS NOT NULL
UNION ALL
SELECT a.tree_id, a.node_id, n.parent_id, a.k + 1 FROM anc a JOIN fx_nodes n
  ON n.tree_id = a.tree_id AND n.node_id = a.anc_id WHERE n.parent_id IS NOT NULL
""", "fx_nodes")
_stage("tleaves", """
SELECT n.* FROM (SELECT * FROM fx_nodes WHERE token IS NOT NULL AND length(token) > 0 AND kind <> 'Comment'
  AND (token <> 'null' OR kind = 'NullLiteralExpr')) n
ANTI JOIN (SELECT DISTINCT tree_id, parent_id FROM fx_nodes WHERE parent_id IS NOT NULL) c
  ON c.tree_id = n.tree_id AND c.parent_id = n.node_id
""", "fx_nodes")
_stage("chain", """
SELECT tree_id, node_id, list(kind ORDER BY k) AS kinds, list(child_idx ORDER BY k) AS cis, list(nid ORDER BY k) AS ids
FROM (SELECT l.tree_id, l.node_id, 0 AS k, l.kind, l.child_idx, l.node_id AS nid FROM tleaves l
      UNION ALL
      SELECT a.tree_id, a.node_id, a.k, n.kind, n.child_idx, n.node_id FROM anc a
      JOIN tleaves l ON l.tree_id = a.tree_id AND l.node_id = a.node_id
      JOIN fx_nodes n ON n.tree_id = a.tree_id AND n.node_id = a.anc_id)
GROUP BY tree_id, node_id
""", "anc", "tleaves")


_stage("lv", """
SELECT l.tree_id, l.node_id, l.token, l.kind, c.kinds, c.cis, c.ids,
       cast(row_number() OVER (PARTITION BY l.tree_id ORDER BY l.node_id) AS int) AS ord,
       CASE WHEN l.kind = 'NameExpr' AND c.kinds[2] = 'Order' THEN 'METHOD_NAME' ELSE substr((CASE WHEN length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l.token), '\\n', '', 'g'), '//s+', '', 'g'), '["'',]', '', 'g'), '[^\x20-\x7E]', '', 'g'), '[^A-Za-z]', '', 'g')) > 0 THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l.token), '\\n', '', 'g'), '//s+', '', 'g'), '["'',]', '', 'g'), '[^\x20-\x7E]', '', 'g'), '[^A-Za-z]', '', 'g') WHEN length(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l.token), '\\n', '', 'g'), '//s+', '', 'g'), '["'',]', '', 'g'), '[^\x20-\x7E]', '', 'g'), ' ', '_')) > 0 THEN replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l.token), '\\n', '', 'g'), '//s+', '', 'g'), '["'',]', '', 'g'), '[^\x20-\x7E]', '', 'g'), ' ', '_') ELSE 'BLANK' END), 1, 50) END AS name
FROM tleaves l JOIN chain c ON l.tree_id = c.tree_id AND l.node_id = c.node_id
""", "chain")
_stage("allpairs", """
SELECT tree_id, l, r, l_ord, r_ord, kl, kr, cis_r[kr] - cis_l[kl] AS width, kl + kr AS length, src, dst,
       kinds_l, cis_l, kinds_r, cis_r, ids_l
FROM (SELECT *, list_position(ids_r, ids_l[kl + 1]) - 1 AS kr
      FROM (SELECT a.tree_id, a.node_id AS l, b.node_id AS r, a.ord AS l_ord, b.ord AS r_ord, a.name AS src,
                   b.name AS dst, a.kinds AS kinds_l, a.cis AS cis_l, a.ids AS ids_l, b.kinds AS kinds_r,
                   b.cis AS cis_r, b.ids AS ids_r,
                   list_min(list_filter(range(1, len(a.ids)), lambda i: list_contains(b.ids, a.ids[i + 1]))) AS kl
            FROM lv a JOIN lv b ON a.tree_id = b.tree_id AND a.ord < b.ord))
""", "lv")
_stage("tpairs", "SELECT * FROM allpairs WHERE length <= 5 AND width <= 2", "allpairs")


# ---- model stages (formula parameters, token/path dim 4, code dim 12) ----
def _f(i: str, d: str, salt: int) -> str:
    return f"(cast(({i} * 31 + {d} * 17 + {salt * 13}) % 97 AS double) / 97 - 0.5)"


_stage("tokE", f"SELECT idx, t.d, {_f('idx', 't.d', 1)} AS v FROM tok_vocab, range(4) t(d)", "tok_vocab")
_stage("pathE", f"SELECT idx, t.d, {_f('idx', 't.d', 2)} AS v FROM path_vocab, range(4) t(d)", "path_vocab")
_stage("tgtE", f"SELECT idx, t.d, {_f('idx', 't.d', 5)} AS v FROM tgt_vocab, range(12) t(d)", "tgt_vocab")
_stage("Wm", f"SELECT a.r, b.c, {_f('a.r', 'b.c', 3)} AS w FROM range(12) a(r), range(12) b(c)")
_stage("av", f"SELECT t.c, {_f('t.c', '0', 4)} AS a FROM range(12) t(c)")
_stage("enc_test", "SELECT * FROM encoded WHERE role = 'test' AND valid", "encoded")
_stage("xs", """
SELECT e.ex, e.pos, t.d AS r, t.v AS x FROM enc_test e JOIN tokE t ON e.src_idx = t.idx
UNION ALL SELECT e.ex, e.pos, 4 + p.d, p.v FROM enc_test e JOIN pathE p ON e.path_idx = p.idx
UNION ALL SELECT e.ex, e.pos, 8 + t.d, t.v FROM enc_test e JOIN tokE t ON e.dst_idx = t.idx
""", "enc_test", "tokE", "pathE")
_stage("hs", "SELECT ex, pos, c, tanh(sum(x * w)) AS h FROM xs JOIN Wm ON xs.r = Wm.r GROUP BY ex, pos, c", "xs", "Wm")
_stage("ss", "SELECT ex, pos, sum(h * a) AS s FROM hs JOIN av ON hs.c = av.c GROUP BY ex, pos", "hs", "av")
_stage("ws", """
SELECT ex, pos, e / sum(e) OVER (PARTITION BY ex) AS w
FROM (SELECT ex, pos, exp(s - max(s) OVER (PARTITION BY ex)) AS e FROM ss)
""", "ss")
_stage("code", "SELECT hs.ex, hs.c, sum(ws.w * hs.h) AS v FROM hs JOIN ws ON hs.ex = ws.ex AND hs.pos = ws.pos GROUP BY hs.ex, hs.c",
       "hs", "ws")
_stage("scores", "SELECT code.ex, t.idx, sum(code.v * t.v) AS score FROM code JOIN tgtE t ON code.c = t.d GROUP BY code.ex, t.idx",
       "code", "tgtE")
_stage("topk", """
SELECT ex, idx, score, cast(row_number() OVER (PARTITION BY ex ORDER BY score DESC, idx) AS int) AS rank FROM scores
QUALIFY rank <= 10
""", "scores")
_stage("mpreds", """
SELECT k.ex, e.target AS original, k.rank, coalesce(v.word, '<PAD_OR_OOV>') AS word, k.score
FROM topk k LEFT JOIN tgt_vocab v ON k.idx = v.idx JOIN (SELECT DISTINCT ex, target FROM enc_test) e ON k.ex = e.ex
""", "topk", "tgt_vocab", "enc_test")


# ---- C#-style stages: identifiers Word / NameExpr, literals Flag / Status,
# declarations under the unit root; length 7, width 4, 100 variable pairs ---
_stage("cslv", """
SELECT l.tree_id, l.node_id, l.kind, l.token, l.kinds, l.cis, l.ids, l.ord,
  CASE WHEN l.kind = 'NameExpr' AND l.kinds[2] = 'Order' THEN 'METHOD_NAME' ELSE l.token END AS var,
  NOT (l.kind IN ('Word', 'NameExpr') AND l.kinds[2] IN ('Order')) AS is_const,
  l.kind IN ('Flag', 'Status') AS is_literal_kind
FROM lv l WHERE l.kind IN ('Word', 'NameExpr', 'Flag', 'Status')
""", "lv")
_stage("csvars", """
SELECT tree_id, var, cast(min(ord) AS int) AS first_ord, cast(count(*) AS bigint) AS n_leaves,
       bool_and(is_const) AS is_const, arg_min(is_literal_kind, ord) AS is_literal
FROM cslv GROUP BY tree_id, var
""", "cslv")
def _draw(side: str, other: str, modulus: str, i: int) -> str:
    """One round of the pair permutation: a side moves by a hash of the other."""
    digest = f"md5('42|' || cast(tree_id AS varchar) || '|{i}|' || cast({other} AS varchar))"
    return f"({side} + cast('0x' || substr({digest}, 1, 8) AS bigint)) % {modulus}"


def _rounds() -> str:
    out = "SELECT tree_id, A, B, x // B AS l, x % B AS r FROM csdrawn"
    for i in range(6):
        new = (_draw("l", "r", "A", i), "r") if i % 2 == 0 else ("l", _draw("r", "l", "B", i))
        out = f"SELECT tree_id, A, B, {new[0]} AS l, {new[1]} AS r FROM ({out})"
    return out


_stage("csnum", "SELECT *, cast(row_number() OVER (PARTITION BY tree_id ORDER BY first_ord) - 1 AS bigint) AS num FROM csvars", "csvars")
_stage("csdrawn", """
SELECT tree_id, n, CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END AS A, CASE WHEN n % 2 = 0 THEN n + 1 ELSE (n + 1) // 2 END AS B,
       unnest(range(0, least(100, n * (n + 1) // 2))) AS x
FROM (SELECT tree_id, cast(count(*) AS bigint) AS n FROM csvars GROUP BY tree_id)
""", "csvars")
_stage("csvpairs", f"""
SELECT p.tree_id, a.var AS v1, b.var AS v2, a.num = b.num AS is_self
FROM (SELECT tree_id, t - j * (j + 1) // 2 AS i, j
      FROM (SELECT tree_id, t, cast(floor((sqrt(8.0 * t + 1) - 1) / 2) AS bigint) AS j
            FROM (SELECT tree_id, l * B + r AS t FROM ({_rounds()})))) p
JOIN csnum a ON a.tree_id = p.tree_id AND a.num = p.i
JOIN csnum b ON b.tree_id = p.tree_id AND b.num = p.j
""", "csnum", "csdrawn")
_stage("cspairs", """
SELECT p.*, kinds_l[kl + 1] AS a_kind FROM (
  SELECT *, list_position(ids_r, ids_l[kl + 1]) - 1 AS kr FROM (
    SELECT a.tree_id, a.node_id AS lhs, b.node_id AS rhs, a.var AS lvar, b.var AS rvar, a.token AS ltok, b.token AS rtok,
           a.kinds AS kinds_l, a.cis AS cis_l, a.ids AS ids_l, b.kinds AS kinds_r, b.cis AS cis_r, b.ids AS ids_r,
           list_min(list_filter(range(1, len(a.ids)), lambda i: list_contains(b.ids, a.ids[i + 1]))) AS kl
    FROM cslv a JOIN cslv b ON a.tree_id = b.tree_id AND a.node_id <> b.node_id)) p
JOIN csvars x ON x.tree_id = p.tree_id AND x.var = p.lvar
JOIN csvars y ON y.tree_id = p.tree_id AND y.var = p.rvar
JOIN csvpairs v ON v.tree_id = p.tree_id AND v.v1 = p.lvar AND v.v2 = p.rvar
WHERE kl + kr <= 7 AND (kl = 1 OR kr = 1 OR abs(cis_r[kr] - cis_l[kl]) < 4) AND x.first_ord <= y.first_ord
""", "cslv", "csvars", "csvpairs")
