from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataspark.llm import simhash
from strataspark.llm.components import components
from llm_rows import awkward, awkward_rows, nothing  # noqa: F401


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Index of the component of each print."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(docs):
    prints = [brute_print(t) for _, t in docs]
    groups = brute_components(prints)
    least = {}
    for (doc_id, _), g in zip(docs, groups):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted((str(d), f"{p:016x}", str(least.get(g))) for (d, _), p, g in zip(docs, prints, groups))


def actual(df):
    prints = simhash.fingerprints(df).select("row", "doc_id", "fingerprint")
    rows = simhash.components_of(prints).select("doc_id", simhash.hexed().alias("f"), "component_id").collect()
    return sorted((str(r.doc_id), r.f, str(r.component_id)) for r in rows)


def test_awkward_texts(awkward):
    assert actual(awkward) == expected([(r[0], r[1]) for r in awkward_rows()])


def test_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert actual(docs) == expected([tuple(r) for r in docs.collect()])


def test_empty_table(nothing):
    assert actual(nothing) == []
    assert simhash.keep_one(nothing).count() == 0


def test_fingerprint_follows_spark_hash(spark):
    df = spark.createDataFrame([("Ab cd ef gh",)], "text string")
    hashed = df.select(F.xxhash64(F.lower("text"))).first()[0] & (2**64 - 1)
    assert simhash.fingerprint("Ab cd ef gh", 4) == hashed


def test_forest_spans_all_links_of_dense_groups():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 40), np.uint64)
    bits = np.unique(np.concatenate([centres, (centres[:, None] ^ flips).ravel()]))
    for left, right in ((bits, None), (bits[::2], bits[1::2])):
        a, b = simhash.forest_of(left, right, 4)
        values = left if right is None else np.concatenate([left, right])
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
        members = values.tolist()
        for i, x in enumerate(members):
            for y in members[:i] if right is None else right.tolist():
                if (x ^ y).bit_count() <= 4:
                    assert find(x) == find(y)
        assert all(find(x) == find(y) for x, y in zip(a.tolist(), b.tolist()))


def test_cells_cover_every_popcount():
    cells = simhash._cells({0: 1, 20: 50, 30: 500, 31: 90, 64: 2}, 100)
    assert cells[0][0] == 0 and cells[-1][1] == 64
    assert all(b[0] == a[1] + 1 for a, b in zip(cells, cells[1:]))
    assert [c for c in cells if c[0] == 30] == [(30, 30, 5)]


@pytest.mark.parametrize("total", [10**5, 10**8, 10**11])
def test_cells_stay_bounded(total):
    counts = {p: int(total * math.comb(64, p) / 2**64) for p in range(65)}
    size = simhash.cell_size(total)
    assert size <= simhash.MOST_CELL
    for first, last, parts in simhash._cells(counts, size):
        assert sum(counts[p] for p in range(first, last + 1)) <= parts * size


def test_many_cells_give_the_same_links(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 300)
    near = base[:100] ^ (1 << rng.integers(0, 62, 100))
    nodes = spark.createDataFrame([(int(v),) for v in np.unique(np.concatenate([base, near]))], "fingerprint long")
    few = {frozenset(r) for r in components(simhash.links(nodes)).collect()}
    many = {frozenset(r) for r in components(simhash.links(nodes, least_cell=20, most_cell=20)).collect()}
    assert few == many and len(few) >= 200


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100 + i, 1000) for i in range(60)]
    df = spark.createDataFrame([*chain, *hub, (7, 7), (3, 4)], "a long, b long")
    groups = {}
    for r in components(df).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [41, 61]


def test_keep_one_keeps_the_smallest_id(awkward):
    extra = awkward.withColumn("row", F.lit("mine")).withColumn("fingerprint", F.lit("mine"))
    kept = simhash.keep_one(extra)
    assert kept.columns == extra.columns
    rows = kept.collect()
    docs = [(r[0], r[1]) for r in awkward_rows()]
    groups = brute_components([brute_print(t) for _, t in docs])
    assert len(rows) == len(set(groups))
    assert 1 in {r.doc_id for r in rows} and 2 not in {r.doc_id for r in rows}
