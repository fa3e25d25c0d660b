from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from strataspark.llm import quality
from llm_rows import WORD, awkward, awkward_rows, nothing  # noqa: F401


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures_of_awkward_texts(awkward):
    got = quality.ledger(awkward).collect()
    assert len(got) == len(awkward_rows())
    want = sorted((str(r[0]), *brute(r[1])) for r in awkward_rows())
    assert sorted((str(r.doc_id), *(r[m] for m in quality.MEASURES)) for r in got) == want


def test_bits_and_filters_agree(awkward):
    book = quality.ledger(awkward)
    kept = {str(r.doc_id) for r in book.filter(~quality.rejected(quality.PRODUCTION)).collect()}
    for r in book.collect():
        n, chars, symbols, lines, dup, repeat = (r[m] for m in quality.MEASURES)
        fails = [n < 50, 100 * repeat > 50 * n, 5 * symbols > n, 100 * dup > 60 * lines, chars > 25 * n, chars < 2 * n]
        assert r.failed == sum(1 << k for k, f in enumerate(fails) if f)
        assert (r.failed == 0) == (str(r.doc_id) in kept)


def test_ablation_counts(awkward):
    book = quality.ledger(awkward)
    rows = {r.rule: r for r in quality.ablation(book, quality.PRODUCTION).collect()}
    failed = [r.failed for r in book.collect()]
    for k, rule in enumerate(quality.RULES):
        got = rows[rule.name]
        assert got.n_failed == sum(1 for f in failed if f >> k & 1)
        assert got.n_only_this == sum(1 for f in failed if f == 1 << k)
        assert got.n_kept_without == sum(1 for f in failed if not f & ~(1 << k))


def test_empty_table_and_clashing_columns(awkward, nothing):
    assert quality.ledger(nothing).count() == 0
    clash = awkward.withColumn("n_words", F.lit("mine")).withColumn("failed", F.lit("mine")).withColumn("_words", F.lit(1))
    got = quality.ledger(clash)
    assert dict(got.dtypes)["n_words"] == "bigint" and dict(got.dtypes)["failed"] == "bigint"
    assert got.count() == len(awkward_rows())


def test_no_python_in_the_plan(awkward):
    plan = quality.ledger(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
