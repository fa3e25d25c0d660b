from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataspark.llm import bpe
from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from test_tokens import HARD

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def file(request):
    return request.param


def random_texts():
    rng = random.Random(11)
    letters = "abcdefghinoprst"
    wide = [chr(c) for c in range(0x2FF)] + list(" \n'stremlvd<|>") * 20 + list("日本語テΣςİ́ 🙂ßक्ष")
    texts = ["".join(rng.choices(wide, k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(1500)]
    texts += ["x" * n for n in range(1, 40)] + ["x" * 5000, "ab" * 3000, "aab" * 400, "-" * 777]
    return HARD + texts


def test_ids_and_text_equal_the_library(file):
    library, tool = Tokenizer.from_file(public_tokenizers.path(file)), bpe.codec(file)
    texts = random_texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = [tool.encode(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    data, ends = tool.decode_lists(np.concatenate([np.array(g, np.int64) for g in got]), np.cumsum([len(g) for g in got]))
    edges = [0, *ends.tolist()]
    for a, b, w in zip(edges, edges[1:], want):
        assert data[a:b].tobytes().decode("utf-8", "replace") == library.decode(w, skip_special_tokens=False)


def test_full_memories_start_afresh(monkeypatch):
    tool = bpe.Codec(public_tokenizers.path(FILES[0]))
    texts = random_texts()[:200]
    want = [tool.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 5)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 5)
    tool = bpe.Codec(public_tokenizers.path(FILES[0]))
    assert [tool.encode(t) for t in texts] == want
    assert len(tool.encoder.merges.fitting) <= 5


def merged(symbols, rank):
    """Merge by merge, the first of the lowest rank each time."""
    row = list(symbols)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(row, row[1:])) if p in rank]
        if not found:
            return row
        _, i = min(found)
        row[i : i + 2] = [row[i] + row[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_small_merge_lists_against_merging(seed):
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 25:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 9:
            tokens.append(a + b)
            merges.append((a, b))
    vocabulary = {t: i for i, t in enumerate(tokens)}
    made = bpe.Merges(vocabulary, merges)
    encoder, rank = bpe.Encoder(made), {m: r for r, m in enumerate(merges)}
    for t in tokens:
        assert made.whole[vocabulary[t]] == (merged(t, rank) == [t])
    sound = [t for t in tokens if made.whole[vocabulary[t]]]
    for a in sound:
        for b in sound:
            assert made.fits(vocabulary[a], vocabulary[b]) == (merged(a + b, rank) == [a, b])
    for _ in range(400):
        piece = "".join(rng.choices("abc", k=rng.randint(1, 40)))
        assert encoder.encode(piece) == [vocabulary[t] for t in merged(piece, rank)]


def test_unsound_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_awkward_and_empty_tables(file, awkward, nothing):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    clashing = awkward.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("x")).withColumn("_own", F.lit("y"))
    rows = bpe.decode(bpe.encode(clashing, file), file).collect()
    want = []
    for r in awkward_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), ids, library.decode(ids, skip_special_tokens=False), "y"))
    assert sorted((str(r.doc_id), r.ids, r.decoded, r._own) for r in rows) == sorted(want)
    assert bpe.decode(bpe.encode(nothing, file), file).collect() == []


def test_null_ids_decode_to_nothing(spark):
    rows = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [320, 320])], "k long, ids array<int>"))
    assert {r.k: r.decoded for r in rows.collect()} == {1: "", 2: "", 3: "a</w> a</w>"}


def test_query_equals_the_library(spark, sf):
    from strataspark.llm.suite import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    got = QUERIES["op13_bpe_codec"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
