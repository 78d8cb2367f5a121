"""Source queries: files, projects, JSON maps, web-page trees, comments
(A1, A2, A15, A21, K6, B20, H19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import split_name_unless_empty
from ..operators import trees as T
from ..sources import dom
from ..sources.tables import table
from . import sqlfn as S
from .registry import register

HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"
COMMENT_RE = r"(?s)<!--(.*?)-->"


@register("scan_source_files")
def q_scan_source_files(spark, sf_dir):
    """A1: recursive listing of the table files; extension checked case-insensitively
    (content is never read: only path and length are selected)."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
         .select("path", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return f.filter(F.lower(name).endswith(".parquet")).select(name.alias("file_name"), "length")


@register("project_partition", f"""
SELECT regexp_extract(url, '{HOST_RE}', 1) AS project, cast(count(*) AS bigint) AS n_pages FROM pages GROUP BY 1
""")
def q_project_partition(spark, sf_dir):
    """A2: the group (project) of each page is its host."""
    p = table(spark, sf_dir, "pages", "url")
    return p.groupBy(F.regexp_extract("url", HOST_RE, 1).alias("project")).agg(F.count(F.lit(1)).alias("n_pages"))


JSON_SQL = "SELECT e.event_id, j.key AS element, j.value ->> '$' AS scope FROM events e, json_each(e.props) j"


@register("read_json_maps", JSON_SQL)
def q_read_json_maps(spark, sf_dir):
    """JSON map per line flattened to (element, scope) pairs; NULL lines skipped."""
    e = table(spark, sf_dir, "events", "event_id", "props")
    m = e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("element", "scope"))
    return m


@register("snippet_tree_job")
def q_snippet_tree_job(spark, sf_dir):
    """K6: every page parsed into a node table (html.parser in mapInArrow)."""
    return dom.dom_tree(table(spark, sf_dir, "pages", "page_id", "html"))


@register("skip_bad_files")
def q_skip_bad_files(spark, sf_dir):
    """Pages that fail to parse go to a side table; the rest are parsed."""
    nodes = dom.page_nodes(table(spark, sf_dir, "pages", "page_id", "html"))
    return nodes.groupBy("page_id").agg(
        F.count("node_id").alias("n_nodes"), F.max("error").alias("error"))


@register("drop_comments")
def q_drop_comments(spark, sf_dir):
    """Comment nodes are never leaves (on real page trees)."""
    t = dom.dom_tree(table(spark, sf_dir, "pages", "page_id", "html"))
    return T.leaves(t, comment_kinds=("#comment",)).select("tree_id", "node_id", "kind", "token")


def _comments(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(COMMENT_RE), 1)).alias("n", "c"))


@register("comment_contexts", f"""
SELECT page_id, cast(n AS int) AS comment_no, cast(b AS int) AS batch_no,
       array_to_string(parts[b * 5 + 1: b * 5 + 5], '|') || ',COMMENT,' || array_to_string(parts[b * 5 + 1: b * 5 + 5], '|')
       AS context
FROM (SELECT page_id, n, string_split({S.h5("trim(c, ' /*{}')")}, '|') AS parts
      FROM (SELECT page_id, unnest(cs) AS c, unnest(range(len(cs))) AS n
            FROM (SELECT page_id, regexp_extract_all(html, '{COMMENT_RE}', 1) AS cs FROM pages))) t,
     range(cast(ceil(len(parts) / 5.0) AS bigint)) r(b)
""")
def q_comment_contexts(spark, sf_dir):
    """Comment text trimmed of ' /*{{}}', split into subtokens (H5), batches
    of five as `batch,COMMENT,batch` contexts."""
    c = _comments(spark, sf_dir)
    parts = F.split(split_name_unless_empty(F.btrim("c", F.lit(" /*{}"))), r"\|", -1)
    c = c.select("page_id", F.col("n").cast("int").alias("comment_no"), parts.alias("parts"))
    batches = F.transform(F.sequence(F.lit(0), F.ceil(F.size("parts") / 5.0).cast("int") - 1),
                          lambda i: F.array_join(F.slice("parts", i * 5 + 1, 5), "|"))
    e = c.select("page_id", "comment_no", F.posexplode(batches).alias("batch_no", "b"))
    return e.select("page_id", "comment_no", F.col("batch_no").cast("int"),
                    F.concat("b", F.lit(",COMMENT,"), "b").alias("context"))
