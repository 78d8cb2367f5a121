"""C#-style lines keep units without paths; the running average equals a loop, a hot user included."""

from pyspark.sql import functions as F

from pathweave.operators import trees as T
from pathweave.operators.ranking import affine_scan


def test_lines_of_units(spark):
    units = spark.createDataFrame([(1, "getMyName"), (2, "x"), (3, "")], "tree_id long, name string")
    ctx = spark.createDataFrame([(1, "r/2", "r/3", "b,7,c"), (1, "r/1", "r/2", "a,5,b"), (1, "r/1", "r/3", "a,6,c")], "tree_id long, lhs string, rhs string, context string")
    notes = spark.createDataFrame([(1, 1, "// second one"), (1, 0, "/* one two three four five six */"), (2, 0, None), (3, 0, "/* {} */")], "tree_id long, comment_no int, text string")
    got = {r.tree_id: r.line for r in T.cs_lines(units, ctx, notes).collect()}
    assert got[1] == "get|my|name a,5,b a,6,c b,7,c one|two|three|four|five,COMMENT,one|two|three|four|five six,COMMENT,six second|one,COMMENT,second|one"
    assert got[2] == "x "  # neither paths nor comments
    assert got[3] == " SPACE,COMMENT,SPACE"
    assert T.cs_lines(units.limit(0), ctx, notes).count() == 0


def test_running_average_of_a_hot_user(spark):
    e = spark.range(6000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("u"), "id", (F.col("id") * 37 % 101).cast("double").alias("v")).repartition(7)
    first = e.groupBy("u").agg(F.min("id").alias("f"))
    e = e.join(first, "u")
    new = F.col("id") == F.col("f")
    got = affine_scan(e, ["u", "id"], F.when(new, 0.0).otherwise(0.5), F.when(new, F.col("v")).otherwise(F.col("v") * 0.5), "ema").orderBy("u", "id").collect()
    u, ema = None, 0.0
    for r in got:
        ema = r.v if r.u != u else 0.5 * r.v + 0.5 * ema
        u = r.u
        assert abs(r.ema - ema) < 1e-9
    assert len(got) == 6000
