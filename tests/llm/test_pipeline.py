import random

import corpus_pipeline as C


from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as components
from .test_line_dedup import brute as kept_lines

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    for name, stage in C.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, SMALL)
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            assert len(rows_of(new)) >= 0.98 * len(before)  # clean documents stay
        elif name == "line_dedup":
            want = {i: t for i, t in kept_lines(before).items() if t.strip() or not dict(before)[i].strip()}
            assert dict(rows_of(new)) == want
        elif name == "near_duplicates":
            want = sorted(int(i) for i, _, c in components(before, C.SHINGLE, C.PERCENT) if i == c)
            assert sorted(i for i, _ in rows_of(new)) == want
        elif name == "decontamination":
            assert {i for i, _ in before} - {i for i, _ in rows_of(new)} == set(contaminated(before, bench))
        else:
            assert sorted(r.doc_id for r in new.collect()) == sorted(i for i, _ in before)
        docs = new


def test_awkward_rows_pass_through(spark):
    from .util import awkward, docs_of, prose

    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en", "s") for i in range(100, 130)] + [(*r, "en", None) for r in awkward(rng)]
    docs = docs_of(spark, rows)
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert set(range(100, 130)) <= set(ids) and None in ids and ids.count(6) == 0
    assert C.mix(spark, docs, SMALL).count() == len(ids)
    empty = docs_of(spark, [])
    for name, stage in C.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_null_and_repeated_ids_are_judged_by_text(spark):
    from .util import docs_of, prose

    rng = random.Random(8)
    a, b, c, d, e, f = (prose(rng, 60, 5000) for _ in range(6))
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("max_by(text, length(text))").first()[0]
    rows = [(5, a), (7, a + " x"), (7, b), (9, b + " y"), (None, a + " z"), (None, c), (None, d), (None, d), (None, d + " v"), (11, e), (11, e), (11, e + " w")]
    left = sorted(map(str, rows_of(C.drop_near_duplicates(spark, docs_of(spark, rows), SMALL))))
    assert [x for x in left if d not in x and e not in x] == sorted(map(str, [(5, a), (7, b), (None, c)]))
    assert sum(d in x for x in left) == 1 and sum(e in x for x in left) == 1
    rows = [(None, leak), (None, c), (3, d + " " + leak), (3, f), (4, e)]
    left = rows_of(C.drop_contaminated(spark, docs_of(spark, rows), SMALL))
    assert sorted(map(str, left)) == sorted(map(str, [(None, c), (3, f), (4, e)]))
