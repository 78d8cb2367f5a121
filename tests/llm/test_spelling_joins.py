"""Neighbours are sized by Spark like the words that they come from, so no join may follow that size."""

from pathweave.llm import spelling as S


def test_neighbours_are_never_broadcast(spark):
    words = spark.createDataFrame([("spelling", 20), ("speling", 2), ("spellings", 1), ("another", 3)], "word string, n long")
    near = S.near_words(words)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    got = {(r.word, r.near) for r in near.collect()}
    assert got == {("spelling", "speling"), ("speling", "spelling"), ("spelling", "spellings"), ("spellings", "spelling")}
    docs = spark.createDataFrame([(1, "spelling " * 20 + "speling " * 2)], "doc_id long, text string")
    forms = S.spelling_forms(docs, every=0)
    assert "Broadcast" not in forms._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.form, r.root) for r in forms.collect()} == {("spelling", None, "spelling"), ("speling", "spelling", "spelling")}
