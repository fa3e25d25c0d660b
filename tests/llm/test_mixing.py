from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from strataspark.llm import mixing
from strataspark.llm.suite import MIX_TILTS, MIX_WEIGHTS
from llm_rows import WORD, awkward, awkward_rows, nothing  # noqa: F401


def water_fill(sizes, weights, repeats=3):
    """Targets by repeated resharing."""
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        if not open_:
            return capped
        left = total - sum(capped.values())
        out = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if out[s] > repeats * sizes[s]]
        if not over:
            return capped | out
        capped |= {s: float(repeats * sizes[s]) for s in over}


def mixed(df):
    return mixing.assign(mixing.sized(df), mixing.ranked_knots(MIX_WEIGHTS, MIX_TILTS))


def check(rows, docs):
    sizes = {}
    for _, text, _, source, *_ in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: MIX_WEIGHTS[i % 3] for i, s in enumerate(order)}
    targets = water_fill(sizes, weights)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == sum(p.words for p in r.placements)
        assert all(0 <= p.position <= 1 for p in r.placements)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == math.floor(targets[s] + 1e-9) or abs(taken[s] - targets[s]) <= 1


def test_awkward_table(awkward):
    rows = mixed(awkward).collect()
    assert len(rows) == len(awkward_rows())
    check(rows, awkward_rows())


def test_real_table_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixed(docs).collect()
    check(rows, [tuple(r) for r in docs.collect()])
    again = mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_order_is_by_digest_and_position(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("source = 'src0'")
    rows = mixed(docs).collect()
    rows.sort(key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
    firsts = [r.placements[0].position for r in rows if r.placements]
    assert firsts == sorted(firsts)


def test_positions_invert_the_demand(spark):
    docs = spark.createDataFrame([(i, "s", 100) for i in range(50)], "doc_id long, source string, size long")
    rows = mixing.assign(docs, mixing.ranked_knots((4.0,), (0.5,))).collect()
    for r in rows:
        for p in r.placements:
            demand = (1.5 * p.position - 0.5 * p.position**2) * r.target  # integral of 1.5 - t
            assert abs(demand - round((demand - 50) / 100) * 100 - 50) < 1e-6


def test_training_order_and_cut_texts(awkward):
    ordered = mixing.in_training_order(mixed(awkward)).collect()
    places = [r.position for r in ordered]
    assert places == sorted(places)
    for r in ordered:
        assert len(WORD.findall(r.text or "")) == r.words


def test_whole_documents(spark):
    rows = [(i, "long " * 100 if i % 2 else "w " * 7, f"s{i % 9}") for i in range(40)] + [(99, "alone " * 500, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assigned = mixing.assign(mixing.sized(docs), mixing.ranked_knots(MIX_WEIGHTS, MIX_TILTS), whole=True)
    texts = {i: t for i, t, _ in rows}
    placed = mixing.in_training_order(assigned).collect()
    assert placed and all(r.text == texts[r.doc_id] and r.words == r["size"] == len(WORD.findall(r.text)) for r in placed)
    assert all(0 <= r.position <= 1 for r in placed)
    taken, target, size, largest = {}, {}, {}, {}
    for r in assigned.collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    assert all(target[s] <= taken[s] + 1e-6 and taken[s] < target[s] + largest[s] and taken[s] <= 3 * size[s] for s in target)


def test_query_derives_its_rows_from_the_stored_training_order(spark, sf, monkeypatch):
    from strataspark.llm import suite

    kept, plain = {}, suite.stored
    monkeypatch.setattr(suite, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = suite.QUERIES["op1_mix_sources"](spark, sf).collect()
    order = kept["training_order"]
    # Files come in order, and every position of a file is at least the last one of the file before.
    files = order.withColumn("file", F.input_file_name()).collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r.file, []).append((r.position is None, r.position or 0.0, r.doc_id))
    assert all(v == sorted(v) for v in by_file.values())
    spans = sorted((v[0], v[-1]) for v in by_file.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    taken = {}
    for r in files:
        taken[r.row] = taken.get(r.row, 0) + r.words
    assert len(rows) == len(taken) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(r.taken for r in rows) == sorted(taken.values())


def test_unplaced_documents_end_the_order(awkward):
    assigned = mixed(awkward)
    ordered = mixing.in_training_order(assigned, keep=["target"], unplaced=True).collect()
    ends = [r.position is None for r in ordered]
    assert ends == sorted(ends) and "target" in ordered[0]
    idle = assigned.filter("taken = 0").count()
    assert idle and sum(ends) == idle and all(r.words == 0 for r in ordered if r.position is None)


def test_empty_table_and_clashing_columns(nothing, awkward):
    assert mixed(nothing).count() == 0
    clash = awkward.withColumn("taken", F.lit("x")).withColumn("target", F.lit("x"))
    assert dict(mixed(clash).dtypes)["taken"] == "bigint"
