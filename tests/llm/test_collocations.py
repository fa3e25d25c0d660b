from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import collocations
from conftest import plan_of
from llm_rows import awkward, awkward_rows, nothing  # noqa: F401

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_grams(rows):
    """Counts by language of phrases of 1 to 4 words."""
    grams = {}
    for lang, text in rows:
        found = grams.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    found[tuple(w[i : i + k])] += 1
    return grams


def brute(rows, least, first=2000):
    out = []
    for lang, grams in brute_grams(rows).items():
        n = sum(c for g, c in grams.items() if len(g) == 1)
        kept = []
        for g, a in grams.items():
            if len(g) < 2 or a < least:
                continue
            inside = any(
                len(h) > len(g) and c >= least and 100 * c >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in grams.items()
            )
            if inside:
                continue
            score, _, l, r = min((2_000_000 * a // (grams[g[:k]] + grams[g[k:]]), k, grams[g[:k]], grams[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def taken(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def mixed_rows():
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "new", "York", "city", "é", "\x01", "日本", "x y", "re", "rea"]
    rows = []
    for _ in range(120):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ", ", "\n", "\t", "?!"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "en", None, "und", "a b%\n", ""]), " ".join(words)))
    rows += [("en", "New York City hall")] * 40 + [("fr", "sur le pont")] * 3 + [("en", None), (None, ""), ("xx", " \t. ")]
    return rows


def test_windows_are_cut_at_pieces():
    got = collocations.windows("A b\tC  d e. F\ng;;h".encode(), 3)
    assert got == [b"a b c ", b"b c d ", b"c d e ", b"d e ", b"e ", b"f ", b"g ", b"h "]
    assert collocations.windows(b" \t.\n") == [] and collocations.windows(b"") == []


def test_windows_end_at_unmarked_pairs():
    words = collocations.Words(b"a b c d.e f g")
    marked = np.array([True, True, False, True, True, False])  # the fourth pair is of two pieces
    assert words.windows(marked, 4) == [b"a b c ", b"b c ", b"c ", b"d ", b"e f ", b"f ", b"g "]
    assert words.windows(marked, 2) == [b"a b ", b"b c ", b"c ", b"d ", b"e f ", b"f ", b"g "]


def test_pair_digests_do_not_depend_on_the_batch():
    one = collocations.Words("x y z é\u00e9 x y".encode()).pair_digests("en")
    two = collocations.Words("long words before, x y".encode()).pair_digests("en")
    other = collocations.Words(b"x y").pair_digests("de")
    assert one[0] == one[-1] == two[-1] != other[0] and len(set(one.tolist())) == 4


def test_frequent_pairs_are_marked(spark):
    df = spark.createDataFrame(mixed_rows(), "lang string, text string")
    table = collocations.marked_pairs(df, 5)
    for lang, grams in brute_grams(mixed_rows()).items():
        for g, n in grams.items():
            if len(g) == 2 and n >= 5:
                for at in collocations._places(collocations.Words(" ".join(g).encode()).pair_digests(lang)):
                    assert int(table[at[0] >> 6]) >> int(at[0] & 63) & 1
    assert 0 < np.bitwise_count(table).sum() < 1000


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
@pytest.mark.parametrize("partitions", [1, 3])
def test_scan_sums_prefixes_across_batches_and_partitions(size, partitions):
    counts = Counter()
    for lang, text in mixed_rows():
        for w in collocations.windows((text or "").encode()):
            counts[collocations._escaped("und" if lang is None else lang) + b"\n" + w] += 1
    keys = sorted(counts)
    sums = Counter()
    for part in np.array_split(np.arange(len(keys)), partitions):
        scan = collocations.Scan(5, 4)
        for i in range(0, len(part), size):
            batch = [keys[j] for j in part[i : i + size]]
            scan.add(pa.array(batch, pa.binary()), np.array([counts[k] for k in batch]))
        scan.end()
        for r in scan.batch().to_pylist() if scan.out else []:
            sums[r["lang"], r["k"], r["phrase"]] += r["n"]
    want = {}
    for lang, grams in brute_grams(mixed_rows()).items():
        for g, n in grams.items():
            if n >= 5:
                want[lang, len(g), " ".join(g)] = n
    assert {k: n for k, n in sums.items() if k[1] and n >= 5} == want


@pytest.mark.parametrize("least", [2, 5, 30])
def test_rows_equal_brute_force(spark, least):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("x")).withColumn("k", F.lit("x"))
    assert taken(collocations.top(*collocations.mined(df, least))) == brute(rows, least)
    assert taken(collocations.top(*collocations.mined(df, least), 3)) == brute(rows, least, 3)


def test_awkward_and_empty_tables(awkward, nothing):
    rows = [(r[2], r[1]) for r in awkward_rows()]
    assert taken(collocations.top(*collocations.mined(awkward, 3))) == brute(rows, 3)
    assert collocations.top(*collocations.mined(nothing)).collect() == []


def test_counts_may_pass_64_bits(spark, monkeypatch):
    big = 3 * 10**17
    grams = [("en", "", 0, 9 * big), ("en", "a", 1, 2 * big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 7)]
    made = spark.createDataFrame(grams, "lang string, phrase string, k int, n long")
    monkeypatch.setattr(collocations, "gram_counts", lambda *a: made)
    rows = taken(collocations.top(*collocations.mined(made)))
    assert rows == [("en", 1, "a b", big - 7, 2 * big + 1, big, 9 * big, 2_000_000 * (big - 7) // (3 * big + 1))]


def test_streams_are_merged_and_ranks_are_limited_early(spark):
    df = spark.createDataFrame(mixed_rows(), "lang string, text string")
    plan = plan_of(collocations.top(*collocations.mined(df, 5)))
    # Only the languages' totals may meet by another join.
    assert plan.count("SortMergeJoin") >= 4 and plan.count("HashJoin") <= 1 and plan.count("Window [row_number") == 2 and "_part#" in plan
