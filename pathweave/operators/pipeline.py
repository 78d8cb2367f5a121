"""The dataset build wired together: roles -> histograms -> cuts -> vocabularies
-> tiers -> sampling. Each stage is a DataFrame; nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, Settings
from ..sources import fixtures as fx
from . import examples, vocab
from .ranking import reliable_checkpoint


@dataclass
class Build:
    spark: SparkSession
    sf_dir: str
    settings: Settings = FIXTURE

    @cached_property
    def ctx(self) -> DataFrame:
        """fx_ctx with role, written once to the shared checkpoint folder: the
        histograms, the cut thresholds and the sampling all read it, so the
        joins that produce it run once and executor loss does not replay them."""
        return reliable_checkpoint(fx.fx_ctx_roles(self.spark, self.sf_dir))

    @cached_property
    def train(self) -> DataFrame:
        return self.ctx.filter(F.col("role") == "train")

    @cached_property
    def token_hist(self) -> DataFrame:
        return vocab.token_histogram(self.train)

    @cached_property
    def path_hist(self) -> DataFrame:
        return vocab.path_histogram(self.train)

    @cached_property
    def target_hist(self) -> DataFrame:
        return vocab.target_histogram(self.train)

    @cached_property
    def token_ranked(self) -> DataFrame:
        return vocab.rank_words(self.token_hist)

    @cached_property
    def path_ranked(self) -> DataFrame:
        return vocab.rank_words(self.path_hist)

    @cached_property
    def target_ranked(self) -> DataFrame:
        return vocab.rank_words(self.target_hist)

    @cached_property
    def token_counts(self) -> DataFrame:
        return vocab.cut_strict(self.token_hist, self.settings.word_vocab_size)

    @cached_property
    def path_counts(self) -> DataFrame:
        return vocab.cut_strict(self.path_hist, self.settings.path_vocab_size)

    @cached_property
    def target_counts(self) -> DataFrame:
        return vocab.cut_strict(self.target_hist, self.settings.target_vocab_size)

    @cached_property
    def token_vocab(self) -> DataFrame:
        s = self.settings
        return vocab.vocab_from_counts(self.spark, self.token_counts, s.word_vocab_size, s.token_specials)

    @cached_property
    def path_vocab(self) -> DataFrame:
        s = self.settings
        return vocab.vocab_from_counts(self.spark, self.path_counts, s.path_vocab_size, s.path_specials)

    @cached_property
    def target_vocab(self) -> DataFrame:
        s = self.settings
        return vocab.vocab_from_counts(self.spark, self.target_counts, s.target_vocab_size, s.target_specials)

    @cached_property
    def tiered(self) -> DataFrame:
        return examples.context_tiers(self.ctx, self.token_counts, self.path_counts, self.settings)

    @cached_property
    def sizes(self) -> DataFrame:
        """(role, ex, n, n12, k): bag sizes before and after sampling."""
        return examples.bag_sizes(self.tiered, self.settings)

    @cached_property
    def sampled(self) -> DataFrame:
        """Kept contexts: ex, role, target, src, path, dst, pos (new)."""
        return examples.sample_contexts(self.tiered, self.sizes, self.settings).select(
            "ex", "role", "grp", "target", "src", "path", "dst", "pos")

    @cached_property
    def encoded(self) -> DataFrame:
        """C1 on the sampled contexts: src_idx, path_idx, dst_idx, target_idx, valid."""
        s = self.settings
        t = vocab.lookup(self.sampled, "src", self.token_vocab, "src_idx", s.token_specials.oov_idx,
                         s.word_vocab_size, s)
        t = vocab.lookup(t, "path", self.path_vocab, "path_idx", s.path_specials.oov_idx, s.path_vocab_size, s)
        t = vocab.lookup(t, "dst", self.token_vocab, "dst_idx", s.token_specials.oov_idx, s.word_vocab_size, s)
        t = vocab.lookup(t, "target", self.target_vocab, "target_idx", s.target_specials.oov_idx,
                         s.target_vocab_size, s)
        tp, pp = s.token_specials.pad_idx, s.path_specials.pad_idx
        valid = (F.col("src_idx") != tp) | (F.col("path_idx") != pp) | (F.col("dst_idx") != tp)
        return t.withColumn("valid", valid)
