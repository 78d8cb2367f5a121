import itertools
import math
import random

import public_tokenizers

from pathweave.llm import language_id as L

from .util import docs_of

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "ab", "b", "ba", "▁ab"])
    model = L.make_model({"x": L.em([("ab", 5.0), ("aab", 2.0), ("ba", 1.0)], pieces), "y": L.em([("bb", 3.0)], pieces)}, {"x": 1, "y": 1}, pieces)
    at = {p: i for i, p in enumerate(pieces)}

    def total(w, lang):
        if not w:
            return 1.0
        return sum((model.prob[at[w[:k]], lang] if w[:k] in at else (L.UNKNOWN if k == 1 else 0.0)) * total(w[k:], lang) for k in range(1, len(w) + 1))

    for w in ["ab", "aabba", "q", "abqab"]:
        for lang in (0, 1):
            assert math.isclose(L.Scorer(model).loglik([w])[lang], math.log(total("▁" + w, lang)), rel_tol=1e-9)


def test_long_words_are_summed_whole():
    pieces = sorted(["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "abbabaabbaba"])
    model = L.make_model({"x": L.em([("ab", 5.0), ("aab", 2.0), ("abbabaabbaba", 9.0)], pieces), "y": L.em([("bb", 3.0)], pieces)}, {"x": 1, "y": 1}, pieces)
    rng = random.Random(1)
    for words in (["".join(rng.choice("abq") for _ in range(20)) for _ in range(5)], ["abbabaabbaba" * 2] * 2, ["a"]):
        got, want = L.long_forward(words, L.PieceTable(pieces), model.prob), L.Scorer(model)
        want.learn(sorted(set(words)))
        assert all(math.isclose(got[i][k], want.table[want.at[w]][k], rel_tol=1e-9) for i, w in enumerate(words) for k in (0, 1))
    # far beyond the range of a double, across slabs: the tail of a run of letters settles to one factor a letter
    one = [L.long_forward(["ab" * n], L.PieceTable(pieces), model.prob)[0] for n in (70_000, 70_001, 70_002)]
    assert all(math.isfinite(v) for v in one[0]) and all(math.isclose(one[2][k] - one[1][k], one[1][k] - one[0][k], rel_tol=1e-5) for k in (0, 1))
    assert max(map(len, L.vocabulary(PATH))) > 8


def test_untrained_script_gives_a_score(spark):
    rows = [(i, "the house and", "en") for i in range(5)] + [(i, "der und mit", "de") for i in range(5, 10)] + [(50, "абвгдежз" * 30, None), (51, "漢字" * 16, None), (52, "the " + "house" * 2000, None)]
    got = {r.doc_id: r for r in L.identify(docs_of(spark, rows), PATH).collect()}
    assert all(0 <= got[i].score <= 1 for i in (50, 51, 52))


def test_expectations_add_up():
    e = L.em([("abab", 3.0)], sorted(["▁", "a", "b", "ab", "▁a"]))
    assert 3 * 3 <= e.sum() <= 3 * 5


def test_piece_table_resolves_clashes():
    pieces = L.vocabulary(PATH)
    table = L.PieceTable(pieces)
    lat = L.Lattice(["häuser", "letter"], table)
    got = {(i, ln, w): ids[k] for i, row in enumerate(lat.pieces) for ln, at, ids in row for k, w in enumerate(range(2) if at is None else at)}
    for (i, ln, w), piece in got.items():
        if piece < len(pieces):
            assert pieces[piece] == ("▁" + ["häuser", "letter"][w])[i : i + ln]
    assert sum(len(t[2][t[2] >= 0]) for t in table.tables) == len(pieces)


def test_held_out_accuracy(spark):
    got = L.identify(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH, keep=("doc_id", "lang")).collect()
    assert all(r.held_out == (L.fold_of(r.doc_id) == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    wrong = d.withColumn("lang", L.F.when(L.fold(L.F.col("doc_id")) == 2, L.F.lit("zz")).otherwise(L.F.col("lang")))
    a, b = (sorted(map(tuple, L.identify(x, PATH).collect())) for x in (d, wrong))
    assert a == b


def test_awkward(spark):
    rng = random.Random(0)
    en, de = ["the", "house", "and", "with"], ["der", "haus", "und", "mit"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !? ½ ²", "en"), (103, "the house " * 30000, None), (104, "q" * 5000, "en"), (None, "und der haus mit", None), (105, "漢字", None), (106, "the and", "en"), (106, "the and", "en")]
    got = {r.doc_id: r for r in L.identify(docs_of(spark, rows), PATH).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de" and got[106].lang_pred == "en" and got[105].lang_pred in ("en", "de")
    assert {r.lang_pred for r in L.identify(docs_of(spark, [(1, "no label", None)]), PATH).collect()} == {"und"}
    assert L.identify(docs_of(spark, []), PATH).count() == 0


def test_a_full_cache_keeps_the_words_at_hand():
    pieces = sorted(["▁", "▁a", "a", "ab", "b", "ba", "▁ab"])
    model = L.make_model({"x": L.em([("ab", 5.0)], pieces), "y": L.em([("bb", 3.0)], pieces)}, {"x": 1, "y": 1}, pieces)
    words = ["".join(w) for w in itertools.product("ab", repeat=6)]
    scorer, learned = L.Scorer(model), []
    scorer.room, learn = 40, scorer.learn
    scorer.learn = lambda ws: (learned.append(sorted(ws)), learn(ws))
    texts = [" ".join(words[:30]), " ".join(words[10:45]), " ".join(words)]
    got = [scorer.predict([t]) for t in texts]
    assert learned[0] == words[:30] and learned[1] == words[30:45]  # those of the first text are not summed again
    for (langs, scores), t in zip(got, texts, strict=True):
        want = L.Scorer(model).predict([t])
        assert langs == want[0] and math.isclose(scores[0], want[1][0], rel_tol=1e-9)
