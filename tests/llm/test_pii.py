from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import functions as F

from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from strataspark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fails = {
                "ip": any(int(p) > 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": not (14 <= len(digits) <= 19 and luhn(digits)),
                "phone": not 10 <= len(digits) <= 15,
            }.get(kind, False)
            if not fails:
                out.append((m.start(), n, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


HARD = [
    "a@b.com%x@d.com_e@f.g.h a@b a@b. @c.d e@-.-", "🙂 é x.y+z@host.co.uk, 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.1.1.0001",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 1 2 3", "+1 (456) 555-2186 +49 30 123456 +1 +12 +1-.-.-.-2 +123456789012345678",
    "call (456) 555-2186 now", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=changeme', "123-45-6789 version 1.2.3.4", "", None,
    "ip 10.0.0.1 host 10.0.0.2", "a@b.c" * 50, "1" * 40, "+" * 30 + "1234567890", "mail a@b.com a@b.com",
]


def found(df):
    rows = pii.find(df).select(
        "doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans"), pii.digest(F.col("base")).alias("digest")
    )
    return {r.doc_id: r for r in rows.collect()}


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = found(df)
    for i, text in enumerate(HARD):
        want = ",".join(brute(text))
        assert got[i].base == want, text
        assert got[i].digest == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_real_table_and_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = found(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {i: r.base for i, r in got.items()} == {i: ",".join(brute(t)) for i, t in texts.items()}
    plan = pii.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_and_empty_tables(awkward, nothing):
    assert pii.find(awkward).count() == len(awkward_rows())
    assert pii.find(nothing).count() == 0
    clash = awkward.withColumn("spans", F.lit("x")).withColumn("row", F.lit("x")).withColumn("kind", F.lit("x"))
    assert pii.find(clash).columns == ["doc_id", "base", "spans"]
    assert pii.masked(clash).columns == clash.columns


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000 + "@", "1" * 300_000 + ".", "+" + "1 " * 100_000, "a@b" + ".c" * 50_000, "1 " * 150_000, "1.1." * 30_000]
    start = time.time()
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert time.time() - start < 60
    assert got[3].base == "email:0:100003"


def test_masks(spark):
    text = "x a@b.com y 10.0.0.1 🙂 +1 (456) 555-2186 z"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None), (1, text)], "doc_id long, text string")
    got = sorted((str(r.text) for r in pii.masked(df).collect()))
    assert got == ["None", "none", "x <EMAIL> y <IP> 🙂 <PHONE> z", "x <EMAIL> y <IP> 🙂 <PHONE> z"]


def test_long_secrets_are_masked_whole(spark):
    texts = ["token=" + "a1b2c3d4e5" * 20 + " end", 'password: "' + "Zy-9_xW8" * 5_000 + '" end']
    rows = pii.masked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.text for r in rows) == ["<SECRET> end", '<SECRET>" end']


def test_em_recovers_reliabilities():
    import itertools
    import random

    rng = random.Random(4)
    right = {"pattern": 0.9, "gazetteer": 0.8, "context": 0.7}
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < right[n]) == truth else -1) for n in pii.LABELERS)
        counts[votes] = counts.get(votes, 0) + 1
    state = pii.reliabilities([(dict(zip(pii.LABELERS, v)), n) for v, n in counts.items()])
    assert abs(state.prior - 0.4) < 0.05
    for n, p in right.items():
        assert abs(state.yes[n] - p) < 0.06 and abs(state.false_yes[n] - (1 - p)) < 0.06
    assert len(counts) <= len(list(itertools.product((-1, 0, 1), repeat=3)))
