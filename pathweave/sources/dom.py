"""Web pages as trees (K6 on FX7): a standard-library HTML parser per page
inside ``mapInArrow``; the resulting node table has the same shape as
every other tree source, so all tree operators apply. A task holds the nodes
of one page and ``SLICE_ROWS`` more, however many pages come in a batch.

A page that cannot be parsed yields no nodes and one row in the error side
table instead (A21: the other pages go on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = ("page_id long, node_id string, parent_id string, child_idx int, kind string, token string, "
               "error string")
SLICE_ROWS = 20_000  # node rows that a task hands back at once
SKIP_TEXT_IN = ("script", "style")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def _parse(page_id: int | None, html: str):
    from html.parser import HTMLParser

    rows: list[tuple] = []
    counter = [0]
    stack: list[list] = []  # [node_id, n_children, tag]

    def new(kind: str, token):
        nid = f"{counter[0]:08d}"
        counter[0] += 1
        if stack:
            parent = stack[-1]
            idx = parent[1]
            parent[1] += 1
            rows.append((page_id, nid, parent[0], idx, kind, token, None))
        else:
            rows.append((page_id, nid, None, 0, kind, token, None))
        return nid

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nid = new(tag, None)
            if tag not in VOID:
                stack.append([nid, 0, tag])

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][2] == tag:
                    del stack[i:]
                    break

        def handle_data(self, data):
            if stack and stack[-1][2] in SKIP_TEXT_IN:
                return
            text = data.strip()
            if text:
                new("#text", text)

        def handle_comment(self, data):
            new("#comment", data)

    new("#document", None)
    stack.append([rows[0][1], 0, "#document"])
    p = P(convert_charrefs=True)
    p.feed(html)
    p.close()
    return rows


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, child_idx, kind, token, error); error rows have NULL node_id."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("node_id", pa.string()), ("parent_id", pa.string()), ("child_idx", pa.int32()),
                            ("kind", pa.string()), ("token", pa.string()), ("error", pa.string())])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            out: list[tuple] = []
            ids, texts = batch.column("page_id"), batch.column("html")
            for i in range(batch.num_rows):
                pid, html = ids[i].as_py(), texts[i].as_py()
                try:
                    if html is None:
                        raise ValueError("empty page")
                    out.extend(_parse(pid, html))
                except Exception as e:  # noqa: BLE001 -- a bad page must not stop the others
                    out.append((pid, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                while len(out) >= SLICE_ROWS:
                    yield batch_of(out[:SLICE_ROWS])
                    del out[:SLICE_ROWS]
            if out:
                yield batch_of(out)

    return pages.select("page_id", "html").mapInArrow(run, NODE_SCHEMA)


def dom_tree(pages: DataFrame) -> DataFrame:
    """Node table in the common tree shape (tree_id = page_id)."""
    n = page_nodes(pages).filter(F.col("node_id").isNotNull())
    return n.select(F.col("page_id").alias("tree_id"), "node_id", "parent_id", "child_idx", "kind", "token")


def parse_errors(pages: DataFrame) -> DataFrame:
    return page_nodes(pages).filter(F.col("node_id").isNull()).select("page_id", "error")
