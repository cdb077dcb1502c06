from __future__ import annotations

import random
import string

import zstandard
from plain import ODD_TEXTS, base, odd_documents

from tidewater.llm import quality


def test_base_counts_match_plain_version():
    random.seed(3)
    texts = ODD_TEXTS + ["".join(random.choice("ab \n\t#x|") for _ in range(random.randrange(300))) for _ in range(300)]
    for text in texts:
        assert quality.base_counts((text or "").encode()) == base(text)


def test_repetitive_and_random_texts_are_rejected_and_prose_is_kept():
    random.seed(4)
    syllables = ["the", "an", "er", "ti", "on", "re", "st", "in", "ou", "ha", "wh", "ble"]
    prose = lambda n: " ".join("".join(random.choices(syllables, k=random.randrange(1, 4))) for _ in range(n))
    packer, rules = zstandard.ZstdCompressor(level=3), quality.Rules()
    for n in (60, 300, 2000, 20000):
        assert quality.judge(prose(n), rules, packer)[6]
    letters = string.ascii_letters + string.digits + "+/"
    noise = " ".join("".join(random.choices(letters, k=8)) for _ in range(2000))
    assert quality.judge(noise, rules, packer)[-1] == "incompressible"
    page = prose(200)
    varied = "\n".join(f"{i} {page}" for i in range(40))
    assert quality.judge(varied, quality.Rules(max_repeat=100), packer)[-1] == "repetitive"
    assert quality.judge(prose(3000) + " " + "ab " * 12000, quality.Rules(max_repeat=100), packer)[-1] in ("chunks", "repetitive")


def test_limits_of_the_base_rule():
    packer, rules = zstandard.ZstdCompressor(), quality.Rules()
    different = [f"w{i}" for i in range(100)]
    assert quality.judge(" ".join(different[:49]), rules, packer)[5]
    assert not quality.judge(" ".join(different[:50]), rules, packer)[5]
    half = different[:25] + different[:25] + different[25:75]
    assert quality.judge(" ".join(half), rules, packer)[4] == 50 and not quality.judge(" ".join(half), rules, packer)[5]


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark).withColumnRenamed("_id", "kept").withColumnRenamed("lang", "row")
    out = quality.judged(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.row.text)
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality.judged(docs.limit(0)).count() == 0
