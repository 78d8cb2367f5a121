"""Quotation linking: rebuild who answers whom from quoted passages.

A line's quote level is the number of '>' signs it starts with (blanks between
them are ignored). Consecutive lines of one level above 0 form a quoted passage;
a message's own passages are the paragraphs, the lines and the whole of its
level-0 text. Passages are normalised (lower case, runs of white space to one
blank, trimmed) and hashed. Within a conversation a quoted passage is joined to
the first message whose own text holds it, if that message comes earlier; a
message's parent is the message linked by its lowest quote level (of several, the
latest). A message without a linked quote answers the message one turn before, if
there is one, else it starts a thread. Chains of parents are followed by pointer
doubling, which gives every message the root of its thread and its depth; rows
ordered by (conv_id, thread, turn) are the conversations in reply order, and
``text`` has all quoted lines removed.

Every input row gives one row. Rows that repeat (conv_id, turn) are one node of
the reply tree: their quotes and passages are pooled. Null conv_id or turn: the
row is kept as a thread of its own, never linked. Null and empty texts have no
passages. Nothing is grouped into one task: joins and sums only, on (conversation,
hash) and (conversation, turn), so a conversation of any length is spread out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

QUOTE = re.compile(r"[ \t]*((?:>[ \t]*)+)")
BLANKS = re.compile(r"\s+")


def normal(text: str) -> str:
    return BLANKS.sub(" ", text.lower()).strip()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """(text without quotes, quoted (level, passage), own passages), passages normalised, none empty."""
    quoted: list[tuple[int, list[str]]] = []
    own: list[str] = []
    last = 0
    for line in (text or "").split("\n"):
        m = QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            quoted[-1][1].append(line[m.end():])
        else:
            quoted.append((level, [line[m.end():]]))
        last = level
    if not quoted:
        clean = text or ""
    else:
        clean = "\n".join(own).strip("\n")
    passages = {normal(clean), *map(normal, own), *map(normal, re.split(r"\n[ \t\r]*\n", clean))} - {""}
    found = [(level, normal(" ".join(lines))) for level, lines in quoted]
    return clean, [x for x in found if x[1]], sorted(passages)


def _parser():
    @F.pandas_udf("clean string, levels int, quotes array<struct<level:int,passage:string>>, own array<string>")
    def parsed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                clean, quotes, own = parse(t)
                rows.append((clean, max([q[0] for q in quotes], default=0), [{"level": a, "passage": b} for a, b in quotes], own))
            yield pd.DataFrame(rows, columns=["clean", "levels", "quotes", "own"])

    return parsed


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", carry: tuple[str, ...] = ("role",)) -> DataFrame:
    """conv_id, turn, carried columns, text (unquoted), quote_levels, n_quotes,
    n_linked, parent_turn, thread (turn of the root), depth."""
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *carry, _parser()(F.col(text).cast("string")).alias("__p"))
    m = stage(m.select("conv_id", "turn", *carry, "__p.*"), "quotes-parsed")
    node = m.where("conv_id is not null and turn is not null")
    digest = lambda c: F.xxhash64(c, F.length(c), F.md5(c))
    asked = node.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), digest("q.passage").alias("h"))
    # only passages that some message quotes matter, so the quotes' side decides what the join carries
    held = node.select("conv_id", "turn", F.explode("own").alias("own")).select("conv_id", "turn", digest("own").alias("h"))
    held = held.join(asked.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    links = asked.join(held, ["conv_id", "h"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    links = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"),
                                                 F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("l"), "origin")))["origin"].alias("origin"))
    nodes = node.select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("prev"))
    tree = stage(nodes.join(before, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
                 .select("conv_id", "turn", F.coalesce("origin", "prev").alias("parent"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "quotes-tree")
    # pointer doubling: (ancestor, steps to it, whether it is a root); finished rows leave the loop
    state = stage(tree.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("done")), "quotes-up")
    while state.where("not done").limit(1).count():
        higher = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = state.where("not done").join(higher, ["conv_id", "up"]).select("conv_id", "turn", F.col("upper").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        state = state.where("done").unionByName(stage(moved, "quotes-up"))
    up = state.drop("done")
    info = tree.join(up.withColumnRenamed("up", "thread"), ["conv_id", "turn"])
    got = m.join(info, ["conv_id", "turn"], "left")
    return got.select("conv_id", "turn", *carry, F.col("clean").alias("text"), F.col("levels").alias("quote_levels"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
                      F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
