"""Settings shared by all jobs.

Defaults follow the published settings of the path-context model; the test
fixtures use small caps so that pruning and sampling actually happen.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference for identical results:
# special vocabulary words, in the order they take indices 0, 1, ...
JOINED_PAD_OR_OOV = "<PAD_OR_OOV>"
SEPARATE_PAD = "<PAD>"
SEPARATE_OOV = "<OOV>"
# Word that replaces the unit's own name among its leaves.
METHOD_NAME = "METHOD_NAME"
# Child-id caps / limits of the extractors.
JAVA_MAX_PATH_LENGTH = 8
JAVA_MAX_PATH_WIDTH = 2
CS_MAX_PATH_LENGTH = 7
CS_MAX_PATH_WIDTH = 4
MAX_LABEL_LENGTH = 50
MIN_CODE_LENGTH = 1
MAX_CODE_LENGTH = 10000
NUMBERS_KEPT = ("0", "1", "32", "64")
HASH_COLLECTIONS_NO_OF_PAIRS = 30000
DEFAULT_SEED = 42


@dataclass(frozen=True)
class SpecialWords:
    """Special words of one vocabulary, in index order (duplicates removed)."""

    pad: str
    oov: str

    @property
    def ordered(self) -> tuple[str, ...]:
        out: list[str] = []
        for w in (self.pad, self.oov):
            if w not in out:
                out.append(w)
        return tuple(out)

    def index_of(self, word: str) -> int:
        return self.ordered.index(word)

    @property
    def pad_idx(self) -> int:
        return self.index_of(self.pad)

    @property
    def oov_idx(self) -> int:
        return self.index_of(self.oov)

    @property
    def n(self) -> int:
        return len(self.ordered)


JOINED = SpecialWords(JOINED_PAD_OR_OOV, JOINED_PAD_OR_OOV)
SEPARATE = SpecialWords(SEPARATE_PAD, SEPARATE_OOV)
# target vocabulary in separate mode only has the OOV word (index 0)
ONLY_OOV = SpecialWords(SEPARATE_OOV, SEPARATE_OOV)


@dataclass(frozen=True)
class Settings:
    max_contexts: int = 200
    word_vocab_size: int = 1301136
    path_vocab_size: int = 911417
    target_vocab_size: int = 261245
    top_k: int = 10
    separate_oov_and_pad: bool = False
    seed: int = DEFAULT_SEED
    batch_size: int = 1024
    token_dim: int = 128
    path_dim: int = 128
    dropout_keep: float = 0.75
    # bytes per vocabulary row assumed when deciding on a broadcast
    vocab_row_bytes: int = 64
    broadcast_limit_bytes: int = 256 * 1024 * 1024
    extra: dict = field(default_factory=dict)

    @property
    def token_specials(self) -> SpecialWords:
        return SEPARATE if self.separate_oov_and_pad else JOINED

    @property
    def path_specials(self) -> SpecialWords:
        return SEPARATE if self.separate_oov_and_pad else JOINED

    @property
    def target_specials(self) -> SpecialWords:
        return ONLY_OOV if self.separate_oov_and_pad else JOINED

    @property
    def context_dim(self) -> int:
        return 2 * self.token_dim + self.path_dim

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()
# Small caps used by the fixtures, so that the cuts and the sampling bite.
FIXTURE = Settings(max_contexts=4, word_vocab_size=5, path_vocab_size=20, target_vocab_size=15)
