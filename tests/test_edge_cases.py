"""Hand-made cases from the semantic notes (FIXTURES.md, SURVEY 2Q)."""

import pytest
from pyspark.sql import functions as F

from pathweave.config import FIXTURE, Settings
from pathweave.functions import names as N
from pathweave.operators import metrics as M
from pathweave.operators import vocab as V
from pathweave.sources import lines as L


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("ident,want", [
    ("toLowerCase", "to|lower|case"), ("XMLHttpRequest", "xml|http|request"), ("get_value2String", "get|value|string"),
    ("ABCdef", "ab|cdef"), ("parseHTML5Doc", "parse|html|doc"), ("aB", "a|b"), ("__x", "x"), ("fooBar", "foo|bar"),
])
def test_split_subtokens(spark, ident, want):
    assert one(spark, F.array_join(N.split_subtokens(F.col("x")), "|"), ident) == want


def test_normalize_name_defaults(spark):
    assert one(spark, N.normalize_name(F.col("x")), "32") == "32"
    assert one(spark, N.normalize_name(F.col("x")), "") == "BLANK"
    assert one(spark, N.normalize_name(F.col("x")), "a b") == "ab"
    assert one(spark, N.normalize_name_cs(F.col("x")), "7") == "NUM"
    assert one(spark, N.normalize_name_cs(F.col("x")), "10") == "10"
    assert one(spark, N.split_name_unless_empty(F.col("x")), "  ") == "SPACE"
    assert one(spark, N.split_name_unless_empty(F.col("x")), "METHOD_NAME") == "METHOD_NAME"


def test_hash_collision_and_java_values(spark):
    assert one(spark, N.java_string_hash(F.col("x")), "Aa") == one(spark, N.java_string_hash(F.col("x")), "BB")
    assert one(spark, N.java_string_hash(F.col("x")), "hello") == 99162322
    assert one(spark, N.java_string_hash(F.col("x")), "") == 0


def test_parse_blanks(spark):
    df = spark.createDataFrame([(1, "name"), (2, "name "), (3, "name a,b,c  d,e,f")], "ex long, line string")
    p = {r["ex"]: r["contexts"] for r in L.parse_example(df).collect()}
    assert p[1] == [] and p[2] == [""] and p[3] == ["a,b,c", "", "d,e,f"]
    c = L.split_contexts(L.parse_example(spark.createDataFrame([(1, "t a,b")], "ex long, line string")), "<P>")
    assert [tuple(r)[3:] for r in c.collect()] == [("a", "b", "<P>")]
    with pytest.raises(Exception):
        L.split_contexts(L.parse_example(spark.createDataFrame([(1, "t a,b,c,d")], "ex long, line string")),
                         "<P>").collect()


def test_border_tie_dropped(spark):
    h = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "word string, cnt long")
    kept = {r["word"] for r in V.cut_strict(h, 2).collect()}
    assert kept == {"a"}  # count at position 2 is 3: both 3s dropped
    assert {r["word"] for r in V.cut_strict(h, 10).collect()} == {"a", "b", "c", "d"}


def test_special_words_modes():
    assert FIXTURE.token_specials.pad_idx == FIXTURE.token_specials.oov_idx == 0
    sep = Settings(separate_oov_and_pad=True)
    assert (sep.token_specials.pad_idx, sep.token_specials.oov_idx, sep.target_specials.oov_idx) == (0, 1, 0)


def _preds(spark, rows):
    return spark.createDataFrame(rows, "ex long, original string, rank int, word string, score double")


def test_no_legal_prediction_counts_fn(spark):
    p = _preds(spark, [(1, "get|name", 1, "<PAD_OR_OOV>", 0.5), (1, "get|name", 2, "x1", 0.4)])
    conf = M.subtoken_confusion(M.first_legal(p)).collect()[0]
    assert (conf["tp"], conf["fp"], conf["fn"]) == (0, 0, 2)


def test_topk_normalises_letters(spark):
    p = _preds(spark, [(1, "to|lower", 1, "x|y", 0.5), (1, "to|lower", 2, "tolower", 0.4)])
    m = M.first_match_rank(p).collect()[0]
    assert m["match_rank"] == 1 and m["match_word"] == "tolower"
    acc = {r["k"]: r["acc"] for r in M.topk_accuracy(M.first_match_rank(p), p, 3).collect()}
    assert acc == {1: 0.0, 2: 1.0, 3: 1.0}  # non-decreasing curve
