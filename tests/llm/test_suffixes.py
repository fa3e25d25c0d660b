from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from strataspark.llm import suffixes
from strataspark.session import scratch_root


def brute(docs, length):
    data = [(str(i), (t or "").encode()) for i, t in docs]
    starts = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def actual(df, length):
    return sorted((str(r[0]), *r[1:]) for r in suffixes.summary(df, length).collect())


def planted(seed, length):
    """Texts that share passages about as long as the threshold, at edges and inside, with near misses and periods."""
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choices("abcdefghij é", k=n))

    passages = [noise(length + d) for d in (-12, -1, 0, 1, 2, 20, 200, 400)]
    docs = []
    for _ in range(50):
        parts = [noise(rng.choice([0, 0, 3, 40, 300]))]
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 1, 5, len(p) // 3])
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], noise(rng.choice([0, 1, 2, 30, 150]))]
        docs.append("".join(parts))
    docs += [docs[0], docs[1], "ab" * 200, "z" * 300, "z" * (length - 1), "z" * length, "q" * length, noise(5000), passages[5] * 3]
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 101), (3, 400)])
def test_planted_repeats(spark, seed, length):
    docs = planted(seed, length)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert actual(df, length) == brute(docs, length)


def test_awkward_and_empty_tables(awkward, nothing):
    clash = awkward.withColumn("text_id", F.lit("x")).withColumn("n_bytes", F.lit("x"))
    assert actual(clash, 400) == brute([(r[0], r[1]) for r in awkward_rows()], 400)
    assert actual(nothing, 400) == []


def test_what_only_one_level_reads_is_deleted(spark):
    root = Path(re.sub("^file:/*", "/", scratch_root(spark)))
    before = set(root.glob("*"))
    docs = planted(4, 101)
    assert actual(spark.createDataFrame(docs, "doc_id long, text string"), 101) == brute(docs, 101)
    left = {path.name.rsplit("-", 1)[0] for path in set(root.glob("*")) - before}
    assert left == {"rows", "texts", "cuts", *(f"judged_{k}" for k in range(len(suffixes.Shape(101).sizes)))}


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = random.Random(5)

    def words(n, size):
        return " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))

    short, long = words(55, 6), words(60, 6)  # 384 and 419 bytes
    docs = [(k, f"{words(80, 5)} {passage} {words(80, 5)}") for k, passage in enumerate([short, short, long, long])]
    removed = [r[2] for r in actual(spark.createDataFrame(docs, "doc_id long, text string"), 400)]
    assert removed[:2] == [0, 0] and min(removed[2:]) >= len(long)


def test_every_stretch_has_an_anchor():
    rng = random.Random(8)
    shape = suffixes.Shape(400)
    for text in ("".join(rng.choices("ab", k=3000)), "a" * 1000, "abc" * 500, "x" * 400):
        found = suffixes.anchors(text.encode(), shape).tolist()
        for p in range(len(text) - 400 + 1):
            assert any(p + shape.least <= a <= p + shape.most for a in found)


def test_too_short_strings_are_refused():
    with pytest.raises(ValueError):
        suffixes.Shape(30)
