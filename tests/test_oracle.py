"""Registered queries against their DuckDB oracle on the smallest tables."""

import pytest

from scripts.oracle_check import digest
from tests.conftest import SMALL

CHECKED = [
    "dataset_stats", "normalize_name", "split_subtokens", "split_name_unless_empty", "java_string_hash",
    "code_length", "subtoken_prf", "subtoken_prf_nonan", "topk_accuracy", "prediction_log", "eval_summary",
    "vocab_cut_strict", "vocab_index", "specials_then_words", "encode_lookup", "sample_contexts",
    "filter_train_rows", "shuffle_train", "read_histogram", "save_load_vocab", "unique_in_order",
    "leaf_pairs", "path_string", "subtree_closure", "tree_example_lines",
    "variable_pairs", "path_string_cs", "reservoir_sample_pairs",
    "code_vectors", "attention_pool", "predict_names", "cross_entropy_loss", "known_paths_only", "evaluate",
    "most_similar", "analogy", "import_word2vec", "comment_contexts", "read_json_maps",
    "block_mean", "ema_half", "stream_histograms", "stream_metrics",
]


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as E

    return E.queries(), E.oracle_sql()


def test_every_oracle_has_a_query(registry):
    qs, sql = registry
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, duck, registry, name):
    qs, sql = registry
    got = qs[name](spark, SMALL).toPandas()
    want = duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert digest(got)[0] == digest(want)[0]
