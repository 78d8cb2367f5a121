from pyspark.sql import types as T

from pathweave.llm import quotations as Q

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("clean", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("depth", T.StringType())])


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return Q.link_quotations(df).collect()


def test_parse():
    clean, quotes, own = Q.parse("> > deep\n>> er\n> Level  one\nAnswer one.\n\nMore\nlines\n> tail")
    assert quotes == [(2, "deep er"), (1, "level one"), (1, "tail")]
    assert clean == "Answer one.\n\nMore\nlines" and "more lines" in own and "more" in own
    assert Q.parse(None) == ("", [], []) and Q.parse(">\n> ")[1] == []


def test_links(spark):
    rows = [(1, 0, "user", "How are you?\n\nSecond paragraph"), (1, 1, "assistant", "Fine."), (1, 2, "user", "> HOW are   you?\nAsking again"),
            (1, 3, "assistant", ">> how are you?\n> asking again\nStill fine"), (1, 4, "user", "> never said\nno link"), (1, 5, "user", "> Fine.\nback to fine"),
            (2, 0, "user", "> Fine.\nother conversation"), (2, 5, "user", "gap"), (None, 1, "user", "> Fine."), (3, None, "user", "x"), (4, 0, "user", None), (4, 1, "user", "")]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    p = {k: (r.parent_turn, r.thread, r.depth, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert p[1, 0] == (None, 0, 0, 0, 0) and p[1, 1] == (0, 0, 1, 0, 0) and p[1, 2] == (0, 0, 1, 1, 1)
    assert p[1, 3] == (2, 0, 2, 2, 2) and p[1, 4] == (3, 0, 3, 1, 0) and p[1, 5] == (1, 0, 2, 1, 1)
    assert p[2, 0] == (None, 0, 0, 1, 0) and p[2, 5] == (None, 5, 0, 0, 0)
    assert got[1, 3].text == "Still fine" and got[1, 3].quote_levels == 2
    assert p[None, 1] == (None, 1, 0, 0, 0) and p[3, None][0] is None
    assert len(got) == len(rows)


def test_long_chain_repeats_empty(spark):
    rows = [(7, i, "user", f"message {i}") for i in range(300)] + [(7, 5, "user", "message 5")]
    got = run(spark, rows)
    assert len(got) == 301 and all(r.depth == r.turn and r.thread == 0 for r in got)
    assert run(spark, []) == []
