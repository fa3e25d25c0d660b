from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataspark.llm import tokens
from strataspark.session import scratch_path
from llm_rows import awkward, awkward_rows, nothing  # noqa: F401

NAME = "word_bpe_49k.json"
HARD = [
    "", " ", "don't DON'T it's 'll x'vey", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "<|endoftext", "İstanbul ŞİŞLİ ǅ",
    "ΑΣ Σ", "e\u0301 \u0301x", "a\u00a0b\u0085c\u2003d", "½ ² ٣ 12,345.67", "x" * 3000, "\x1c\x1d\x1e\x1f\x00", "日本語 テスト", "naïve Ünïcödé ß ẞ ſ", "a \u0301",
    "'s's'S", "ª º µ ǆ ʰ ˈ", "!!!??? ... --- ###",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_counts_equal_the_library(library):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x2FF)] + list(" \n'stremlvd<|>") * 20
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = tokens.PieceCounter(public_tokenizers.path(NAME))
    got = counter.counts(texts)
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    counter.known = dict.fromkeys(range(tokens.REMEMBERED + 1), 0)  # a full memory starts afresh
    assert counter.counts(texts) == want


def test_folded_white_space_does_not_count(library):
    for t in HARD:
        folded = " ".join(x for x in t.replace("\t", " ").split(" "))
        assert len(library.encode(t.replace(" ", " \t\n "), add_special_tokens=False).ids) == len(library.encode(folded, add_special_tokens=False).ids)


def test_awkward_table_and_warm_cache(spark, awkward, nothing, library, monkeypatch):
    cache = scratch_path(spark, "cache")
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward_rows())
    assert tokens.count_tokens(nothing, cache, NAME).count() == 0
    for _ in range(2):
        rows = tokens.count_tokens(awkward.withColumn("digest", F.lit("x")).withColumn("n_tokens", F.lit("x")), cache, NAME).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == 11  # blank texts share one digest with none


@pytest.mark.parametrize("other", ["byte_bpe_50k.json", NAME])
def test_other_tokenizers_equal_the_library_cold_and_warm(spark, awkward, other):
    """Texts that differ in white space or case only are told apart where the tokenizer does."""
    second = Tokenizer.from_file(public_tokenizers.path(other))
    code = [(30, "def f():\n        return 1"), (31, "def f():\n\treturn 1"), (32, "DEF F(): RETURN 1"), (33, " two  spaces "), (34, "two spaces")]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([*code, *enumerate(HARD, 100)], "doc_id long, text string"))
    want = sorted((str(r[0]), len(second.encode(r[1] or "", add_special_tokens=False).ids)) for r in docs.collect())
    cache = scratch_path(spark, "cache")
    tokens.count_tokens(docs, cache, "word_bpe_49k.json").count()  # counts of another tokenizer do not disturb
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.count_tokens(docs, cache, other).collect()) == want
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == len({other, NAME})
