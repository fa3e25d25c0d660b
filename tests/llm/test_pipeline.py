from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_rows import WORD, awkward, awkward_rows, nothing  # noqa: F401
from strataspark.llm.common import stored
from test_decontaminate import brute as brute_hits
from test_pii import brute as brute_spans
from test_quality import brute as brute_measures
from test_simhash import brute_components, brute_print


def clean_of_rules(text):
    n, chars, symbols, lines, dup, repeat = brute_measures(text)
    return not (n < 50 or 100 * repeat > 50 * n or 5 * symbols > n or 100 * dup > 60 * lines or chars > 25 * n or chars < 2 * n)


def test_stages_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        got = docs.collect()
        if name == "quality_rules":
            left = {i: t for i, t in left.items() if clean_of_rules(t)}
        elif name == "simhash_dedup":
            ids = sorted(left)
            groups = brute_components([brute_print(left[i]) for i in ids])
            left = {i: left[i] for k, i in enumerate(ids) if groups[k] == k}
        elif name == "decontaminate":
            bad = {int(i) for i, _, n, _ in brute_hits(list(left.items()), items) if n}
            left = {i: t for i, t in left.items() if i not in bad}
        elif name == "mask_pii":
            assert {r.doc_id for r in got} == set(left)
            for r in got:
                assert not brute_spans(r.text) and r.n_chars == len(r.text)
                if not brute_spans(left[r.doc_id]) and "token" not in left[r.doc_id] and "password" not in left[r.doc_id]:
                    assert r.text == left[r.doc_id]
            left = {r.doc_id: r.text for r in got}
        else:
            assert [r.position for r in got] == sorted(r.position for r in got)
            assert {r.doc_id for r in got} <= set(left)
            # Whole documents are placed, so a source misses its target by one document at most.
            assert all(r.text == left[r.doc_id] and r.words == r["size"] == len(WORD.findall(r.text)) for r in got)
            sizes = {i: len(WORD.findall(t)) for i, t in left.items()}
            largest = {}
            for i, source in sources.items():
                largest[source] = max(largest.get(source, 0), sizes.get(i, 0))
            assert abs(sum(r.words for r in got) - sum(sizes.values())) <= sum(largest.values())
            continue
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in got} == left
    assert left


def test_names_and_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", ["awkward", "nothing"])
def test_awkward_and_empty_tables(spark, sf, request, rows):
    docs = request.getfixturevalue(rows).withColumn("failed", F.lit("mine")).withColumn("row", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, sf), name)
        if name != "mix_sources":
            assert docs.columns == before
    assert (docs.count() > 0) == (rows == "awkward" and len(awkward_rows()) > 0)
