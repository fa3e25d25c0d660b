from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from strataspark.llm import ppm


def plain_log10(text, training, order=3):
    """PPM with method C and exclusion, symbol by symbol, from counts of the training texts."""
    counts = {}
    for t in training:
        data = bytes((ppm.START,)) * order + t + bytes((ppm.END,))
        for i in range(order, len(data)):
            for d in range(order + 1):
                counts.setdefault(data[i - d : i], Counter())[data[i]] += 1
    data, total = bytes((ppm.START,)) * order + text + bytes((ppm.END,)), 0.0
    for i in range(order, len(data)):
        excluded, p = set(), 1.0
        for d in range(order, -1, -1):
            own = {s: n for s, n in counts.get(data[i - d : i], {}).items() if s not in excluded}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if data[i] in own:
                p *= own[data[i]] / whole
                break
            p *= len(own) / whole
            excluded |= own.keys()
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
    return total


def test_table_equals_plain_ppm():
    training = [b"abracadabra", b"abba cab", b"", "é日".encode()]
    deep, deep_counts = np.unique(np.concatenate([ppm.grams(t) for t in training]), return_counts=True)
    codes, at = np.unique(deep & 0xFFFFFF, return_inverse=True)
    counts = np.bincount(at, deep_counts)
    for n, order in ((len(deep), 3), (0, 2)):
        trie = ppm.ByteTrie(codes, counts, deep[:n], deep_counts[:n])
        for text in (b"", b"abra", b"zzz", b"cabab\x00", "é".encode(), b"abracadabra" * 20):
            assert trie.log10(text) == pytest.approx(plain_log10(text, training, order), rel=1e-6)
        assert np.power(10, trie.table.astype(float)).sum(1) == pytest.approx(np.ones(len(trie.table)), rel=1e-5)


def test_adaptive_learns():
    assert ppm.adaptive_log10(b"") == pytest.approx(-math.log10(256))
    once, many = ppm.adaptive_log10(b"some words here "), ppm.adaptive_log10(b"some words here " * 20)
    assert many > 3 * once


def brute_base(docs):
    train = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in ppm.tokens(t or ""))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        words = ppm.tokens(t or "")
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        out.append((str(i), held, len(words), sum(counts[w] > 0 for w in words), n, score, plain_log10((t or "").encode(), [(x or "").encode() for x in train])))
    return out


def scored(df):
    held = ppm.held_out(F.col("doc_id"))
    rows = ppm.score(df, df.filter(~held)).select("doc_id", held.alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    return [(str(r[0]), *r[1:]) for r in rows]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6)


@pytest.mark.parametrize("frequent", [1_000_000, 20])
def test_awkward_table(awkward, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    clash = awkward.withColumn("n_tokens", F.lit("x")).withColumn("row", F.lit("x"))
    same(scored(clash), brute_base([(r[0], r[1]) for r in awkward_rows()]))


@pytest.mark.parametrize("contexts", [1, 20])
def test_rare_contexts_are_joined(awkward, monkeypatch, contexts):
    monkeypatch.setattr(ppm, "CONTEXTS", contexts)
    same(scored(awkward), brute_base([(r[0], r[1]) for r in awkward_rows()]))


def test_nothing_to_learn_from(spark, nothing):
    assert scored(nothing) == []
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.score(df, df.filter(F.lit(False))).collect()}
    assert rows[1].base_score == 0 and rows[1].train_tokens == 0
    assert rows[1].score == pytest.approx(3 * math.log10(1 / 256)) and rows[2].score == pytest.approx(math.log10(1 / 256))


def test_held_out_texts_are_better_than_shuffled_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = docs.filter(ppm.held_out(F.col("doc_id")))
    mixed = held.select("doc_id", F.reverse("text").alias("text"))
    training = docs.filter(~ppm.held_out(F.col("doc_id")))
    good, bad = ({r.doc_id: r.score for r in ppm.score(d, training).collect()} for d in (held, mixed))
    assert sum(good.values()) > 0.9 * sum(bad.values()) and sum(g > bad[i] for i, g in good.items()) > 0.9 * len(good)


def test_adaptive_scores(awkward):
    short = awkward.filter(F.length("text") < 500)
    rows = ppm.adaptive_scores(short).collect()
    assert len(rows) == short.count() and all(r.score < 0 for r in rows)
