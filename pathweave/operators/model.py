"""Forward pass of the attention model over encoded bags, as Spark jobs
(I1, I3-I9, C8-C11, D11, D12, E6, E7, A13).

Plan per stage
* C8 embedding lookup: three joins of the context rows with the embedding
  tables (broadcast when the vocabulary cap times the dimension fits the
  limit, sort-merge otherwise).
* I1/I3/I4/D11: contexts of a bag are grouped -- bags are bounded by
  ``max_contexts`` after sampling -- and one ``mapInPandas`` runs the
  tanh transform, the masked softmax and the weighted sum for a whole Arrow
  batch of bags with numpy.
* C9/E6: code vectors and targets meet in block products (``scoring``): a task
  holds one block of each, and the blocks' states are merged, so no task reads
  the target matrix whole and nothing large goes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.fixtures import param_value
from . import scoring
from .ranking import maybe_broadcast

ROUND = 6  # scores and vectors are reported at 6 decimals


def formula_matrix(rows: int, cols: int, salt: int) -> np.ndarray:
    """FX5 formula as numpy: ((r*31 + c*17 + salt*13) % 97) / 97 - 0.5."""
    r = np.arange(rows)[:, None]
    c = np.arange(cols)[None, :]
    return ((r * 31 + c * 17 + salt * 13) % 97) / 97.0 - 0.5


@dataclass
class ModelParams:
    token_emb: DataFrame   # (idx int, vec array<double>)
    path_emb: DataFrame
    target_emb: DataFrame
    transform: np.ndarray  # context_dim x code_dim
    attention: np.ndarray  # code_dim
    token_dim: int
    path_dim: int

    @property
    def code_dim(self) -> int:
        return self.transform.shape[1]


def formula_params(token_vocab: DataFrame, path_vocab: DataFrame, target_vocab: DataFrame,
                   token_dim: int = 4, path_dim: int = 4) -> ModelParams:
    """FX5: parameters by formula over the vocabularies built from the data."""
    code_dim = 2 * token_dim + path_dim

    def emb(v: DataFrame, dim: int, salt: int) -> DataFrame:
        return v.select(F.col("idx").cast("int").alias("idx"),
                        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                    lambda d: param_value(F.col("idx"), d, salt)).alias("vec"))

    return ModelParams(
        token_emb=emb(token_vocab, token_dim, 1), path_emb=emb(path_vocab, path_dim, 2),
        target_emb=emb(target_vocab, code_dim, 5),
        transform=formula_matrix(code_dim, code_dim, 3), attention=formula_matrix(code_dim, 1, 4)[:, 0],
        token_dim=token_dim, path_dim=path_dim)


def context_vectors(encoded: DataFrame, params: ModelParams, settings: Settings) -> DataFrame:
    """C8 + I1: (ex, target, target_idx, pos, x) for the valid contexts (masked ones are filtered, Q13)."""
    s = settings
    tok = maybe_broadcast(params.token_emb, s.word_vocab_size + 2, 8 * params.token_dim + 16, s.broadcast_limit_bytes)
    pth = maybe_broadcast(params.path_emb, s.path_vocab_size + 2, 8 * params.path_dim + 16, s.broadcast_limit_bytes)
    c = encoded.filter("valid").select("ex", "target", "target_idx", "pos", "src_idx", "path_idx", "dst_idx")
    c = c.join(tok.select(F.col("idx").alias("src_idx"), F.col("vec").alias("sv")), "src_idx", "left")
    c = c.join(pth.select(F.col("idx").alias("path_idx"), F.col("vec").alias("pv")), "path_idx", "left")
    c = c.join(tok.select(F.col("idx").alias("dst_idx"), F.col("vec").alias("dv")), "dst_idx", "left")
    return c.select("ex", "target", "target_idx", "pos", F.concat("sv", "pv", "dv").alias("x"))


def code_vectors(ctx: DataFrame, params: ModelParams) -> DataFrame:
    """(ex, target, target_idx, code, attn_pos, attn_w) per bag."""
    bags = ctx.groupBy("ex", "target", "target_idx").agg(F.collect_list("pos").alias("ps"),
                                                         F.collect_list("x").alias("xs"))
    W, a = params.transform, params.attention

    def run(batches):
        import pandas as pd

        from ..functions.kernels import segment_forward

        for pdf in batches:
            codes, ws = segment_forward(list(pdf["xs"]), W, a)
            yield pd.DataFrame({"ex": pdf["ex"], "target": pdf["target"], "target_idx": pdf["target_idx"],
                                "code": list(codes), "attn_pos": pdf["ps"], "attn_w": ws})

    schema = ("ex long, target string, target_idx int, code array<double>, attn_pos array<int>, "
              "attn_w array<double>")
    return bags.mapInPandas(run, schema)


def score_targets(codes: DataFrame, params: ModelParams, k: int, settings: Settings, code_blocks: int | None = None) -> DataFrame:
    """C9 + E6 (+ D12 parts): top-k targets by score for every code vector, plus log-sum-exp
    over all targets and the score of the true target, from block products."""
    return scoring.score_targets(codes, params.target_emb, k, settings.target_vocab_size + 2, code_blocks, dim=params.code_dim)


def predict(codes: DataFrame, scored: DataFrame, target_vocab: DataFrame, settings: Settings,
            normalize: bool | str = False) -> DataFrame:
    """I6 (+ C2, I7): (ex, original, rank, word, score); ``normalize`` applies a
    softmax over the k scores of each example, or over all targets with "full"."""
    oov = settings.target_specials.oov
    v = maybe_broadcast(target_vocab.select("idx", "word"), settings.target_vocab_size + 2,
                        settings.vocab_row_bytes, settings.broadcast_limit_bytes)
    p = scored.join(v, "idx", "left").withColumn("word", F.coalesce("word", F.lit(oov)))
    p = p.join(codes.select("ex", F.col("target").alias("original")), "ex")
    if normalize == "full":
        p = p.withColumn("score", F.exp(F.col("score") - F.col("lse")))
    elif normalize:
        w = Window.partitionBy("ex")
        e = F.exp(F.col("score") - F.max("score").over(w))
        p = p.withColumn("score", e / F.sum(e).over(w))
    return p.select("ex", "original", "rank", "word", "score")


def attention_rows(codes: DataFrame, ctx_strings: DataFrame) -> DataFrame:
    """(ex, pos, weight) joined back to the context strings (src, path, dst)."""
    a = codes.select("ex", F.explode(F.arrays_zip("attn_pos", "attn_w")).alias("a")).select(
        "ex", F.col("a.attn_pos").alias("pos"), F.col("a.attn_w").alias("weight"))
    return a.join(ctx_strings, ["ex", "pos"])


def attention_per_context(att: DataFrame) -> DataFrame:
    """I8: weight per distinct triple; equal triples overwrite, the last position wins."""
    return att.groupBy("ex", "src", "path", "dst").agg(F.max_by("weight", "pos").alias("weight"))


def attention_topk(per_ctx: DataFrame, k: int) -> DataFrame:
    """The k heaviest contexts of each example (weights compared at the
    reporting precision, ties by the triple, so the order is engine-independent)."""
    w = Window.partitionBy("ex").orderBy(F.round("weight", ROUND).desc(), "src", "path", "dst")
    return per_ctx.withColumn("arank", F.row_number().over(w)).filter(F.col("arank") <= k)


def encode_lines(lines: DataFrame, token_vocab: DataFrame, path_vocab: DataFrame, target_vocab: DataFrame,
                 settings: Settings) -> DataFrame:
    """A5 + B2 + C1 for example lines (ex, line): parse, split contexts (missing
    parts -> PAD word), look every part up. Nothing is filtered (predict path)."""
    from ..sources.lines import parse_example, split_contexts
    from .vocab import lookup

    s = settings
    c = split_contexts(parse_example(lines), s.token_specials.pad).withColumnRenamed("i", "pos")
    t = lookup(c, "src", token_vocab, "src_idx", s.token_specials.oov_idx, s.word_vocab_size, s)
    t = lookup(t, "path", path_vocab, "path_idx", s.path_specials.oov_idx, s.path_vocab_size, s)
    t = lookup(t, "dst", token_vocab, "dst_idx", s.token_specials.oov_idx, s.word_vocab_size, s)
    t = lookup(t, "target", target_vocab, "target_idx", s.target_specials.oov_idx, s.target_vocab_size, s)
    tp, pp = s.token_specials.pad_idx, s.path_specials.pad_idx
    return t.withColumn("valid", (F.col("src_idx") != tp) | (F.col("path_idx") != pp) | (F.col("dst_idx") != tp))
