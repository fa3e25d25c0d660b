from __future__ import annotations

import random
import re
import tracemalloc

from pyspark.sql import functions as F

from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from strataspark.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(docs, items, width=10):
    windows = {}
    for name, text in items:
        w = WORDS.findall(lower(text))
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("null" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, names = WORDS.findall(lower(text)), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                found = windows.get(tuple(w[i : i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    names |= found
        out.append((str(doc_id), len(w), len(hit), sorted(names)))
    return sorted(out)


def actual(docs, items, **more):
    rows = decontaminate.hits(docs, items, **more).collect()
    assert all(sum(s.end - s.start for s in r.hit_spans) == r.n_hit for r in rows)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.hit_items) for r in rows)


def random_tables(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "é", "1"]
    items = [(rng.choice([i, i, None]), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 10, 11, 25])))) for i in range(12)]
    docs = [(i, " ".join(rng.choices([*vocabulary, "zz", "yy"], k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"zz, {text.upper()}! zz") for i, (_, text) in enumerate(items)]
    return docs, items


def test_random_tables_in_one_and_many_blocks(spark):
    for seed, width in ((1, 10), (2, 4)):
        docs, items = random_tables(seed)
        items = [i for i in items if len(i[1].split()) > 2 or seed == 2]
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items, width)
        assert actual(d, b, width=width) == want
        assert actual(d, b, width=width, block_bytes=60) == want


def test_awkward_table(spark, awkward):
    items = [(1, awkward_rows()[0][1]), (2, None), (3, "..."), (4, "one Two")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert actual(awkward, b) == brute([(r[0], r[1]) for r in awkward_rows()], items)


def test_empty_tables_and_clashes(spark, awkward, nothing):
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.hits(nothing, b).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.hits(awkward, b.filter(F.lit(False))).collect())
    clash = awkward.withColumn("n_hit", F.lit("mine"))
    kept = decontaminate.clean(clash, b)
    assert kept.columns == clash.columns and kept.count() == len(awkward_rows()) - 1
    assert {r.n_hit for r in kept.collect()} == {"mine"}


def test_real_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = actual(docs, items, keep=["doc_id"])
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_shifts_never_skip_an_occurrence():
    rng = random.Random(7)
    for _ in range(200):
        m = rng.randint(1, 6)
        windows = {tuple(rng.choices(range(1, 4), k=m)): {"x"} for _ in range(4)}
        ids = rng.choices(range(0, 4), k=50)
        spans = []
        decontaminate.Searcher(m, windows).search(ids, spans, set())
        assert spans == [(i, i + m) for i in range(50 - m + 1) if tuple(ids[i : i + m]) in windows]


def test_memory_of_a_full_block_is_bounded():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=100))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = decontaminate.Searchers(items, 10)
    taken, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held.searchers and taken * decontaminate.BLOCK_BYTES / size < 200 << 20


def test_equal_benchmark_rows_are_one(spark):
    items = [(1, "one two three four")] * 50 + [(2, "one two three four")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, "zero one two three four five")], "doc_id long, text string")
    rows = decontaminate.hits(d, b, block_bytes=len("one two three four")).collect()
    assert rows[0].hit_items == ["1", "2"] and rows[0].n_hit == 4
