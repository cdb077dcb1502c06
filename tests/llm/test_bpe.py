from __future__ import annotations

import random

import public_tokenizers
import pytest
from plain import ODD_TEXTS, odd_documents
from tokenizers import Tokenizer

from tidewater.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    random.seed(1)
    pool = list("ab 'stll\n\t é日本語123٣½²\u0085\x1c\x1f​_-#😀́") + ["<|endoftext|>", "  ", "'re", "\U00016ff4", "࢏"]
    anywhere = lambda: chr(random.choice([random.randrange(32, 0x3000), random.randrange(0x10000, 0x1FFFF)]))
    texts = ["".join(random.choice(pool) if random.random() < 0.8 else anywhere() for _ in range(random.randrange(60))) for _ in range(3000)]
    texts += [t or "" for t in ODD_TEXTS] + ["a<|endoftext|>b", "<|endoftext|>" * 3, "<|endoftext", " " * 1000 + "x"]
    counter = bpe.Counter(PATH, remembered=500)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_merging_keeps_the_leftmost_lowest_pair():
    counter = bpe.Counter(PATH)
    brute = {}
    for key, rank in counter.ranks.items():
        brute[key >> 32, key & 0xFFFFFFFF] = rank

    def naive(data):
        symbols = list(data)
        while True:
            pairs = [(brute[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in brute]
            if not pairs:
                return len(symbols)
            rank, i = min(pairs)
            symbols[i : i + 2] = [counter.merged[rank]]

    random.seed(2)
    for _ in range(300):
        data = bytes(random.choice(b" theaninrsoulq") for _ in range(random.randrange(30)))
        assert counter.piece(data) == naive(data)


def test_rows(spark, library):
    docs = odd_documents(spark).withColumnRenamed("_id", "n_tokens_")
    out = bpe.counted(docs.select("doc_id", "text", "n_tokens_"), PATH, limit=3)
    assert out.columns == ["doc_id", "n_tokens_", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 3) for r in docs.collect())
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert bpe.counted(docs.select("doc_id", "text").limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.Counter(public_tokenizers.path("word_bpe_49k.json"))
