import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathweave.llm import token_counts as T

from .util import awkward, docs_of, prose

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def expected(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 60), (32768, 512)])
def test_equals_the_library_on_whole_texts(spark, tok, chunk, overlap):
    rng = random.Random(chunk)
    odd = ["it's we're  \n\n they'll 'r 're 'v", " " * 300, "a" * 700, "x1" * 200 + "<|endoftext|>" * 20, "word <|endoftext|> " * 30, "漢字かな" * 100, "\n\n \t\n" * 90, "'" * 400]
    texts = odd + ["".join(rng.choice(["a", " ", "'", "s", "é", "1", "\n", "<|endoftext|>", "the ", "漢"]) for _ in range(900)) for _ in range(12)] + [prose(rng, 300)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + awkward(rng)[:4] + [(50, texts[3]), (50, texts[3])]
    got = T.token_counts(docs_of(spark, rows), PATH, chunk=chunk, overlap=overlap).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((i, len((t or "").encode()), expected(tok, t)) for i, t in rows)


def test_empty_table(spark):
    assert T.token_counts(docs_of(spark, []), PATH).count() == 0
