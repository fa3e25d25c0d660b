from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataspark.llm import align
from llm_rows import awkward, awkward_rows, nothing  # noqa: F401
from test_tokens import HARD

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def spelt(text, libraries):
    """Ids and bytes of the tokens of both, or none."""
    if not text:
        return [], []
    a, b = libraries
    hidden = [x for x in range(256) if x not in SHOWN]
    byte_of = {chr(x): x for x in SHOWN} | {chr(0x100 + k): x for k, x in enumerate(hidden)}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    said = (" " + text).encode()
    if any(b"".join(x for _, x in side) != said for side in (left, right)):
        return [], []
    return left, right


def brute_links(left, right):
    """All overlapping pairs, one by one, and the groups between common ends."""
    def spans(side):
        at, out = 0, []
        for _, x in side:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    a, b = spans(left), spans(right)
    links = [(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e]
    common = sorted({e for _, e in a} & {e for _, e in b})
    groups, start = [], 0
    for end in common:
        groups.append(
            ",".join(str(left[i][0]) for i, (s, e) in enumerate(a) if start < e <= end) + "|" + ",".join(str(right[j][0]) for j, (s, e) in enumerate(b) if start < e <= end)
        )
        start = end
    return links, groups


def brute(rows, libraries):
    made = []
    for key, text in rows:
        left, right = spelt(text, libraries)
        links, groups = brute_links(left, right)
        made.append((key, len(left), len(right), [(left[i][0], right[j][0]) for i, j in links], groups))
    documents = Counter(p for m in made for p in set(m[3]))
    most = {}
    for (a, _), n in documents.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for key, n_a, n_b, pairs, groups in made:
        best = sum(documents[p] == most[p[0]] for p in pairs)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((str(key), n_a, n_b, len(groups), len(pairs), best, sum(documents[p] for p in pairs), sha))
    return sorted(out)


def taken(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def short(text):
    return text if text is None else text[:2000]


def test_encoders_agree_with_the_libraries(libraries):
    rng = random.Random(2)
    wide = [chr(c) for c in range(1, 0x2FF)] + list(" \n'stremlvd<|>▁") * 20 + list("日本語テΣςİ́🙂")
    texts = [t for t in HARD if t] + ["".join(rng.choices(wide, k=rng.randint(1, 80))) for _ in range(2000)]
    texts += ["<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, " " * 900 + "a", "a" + "\n" * 900]
    a, b = align.tokens(A, B).encode(texts)
    assert a == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert b == [libraries[1].encode(t) for t in texts]


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lockstep_equals_all_pairs(lane):
    rng = random.Random(lane)
    for _ in range(200):
        lengths = [rng.choice([0, 1, 2, 5, 60]) for _ in range(rng.randint(1, 6))]
        a_ends, b_ends, a_edges, b_edges, at = [], [], [0], [0], 0
        for n in lengths:
            if n:
                inner = [p for p in range(at + 1, at + n)]
                a_ends += sorted({*rng.sample(inner, rng.randint(0, len(inner))), at + n})
                b_ends += sorted({*rng.sample(inner, rng.randint(0, len(inner))), at + n})
                at += n
            a_edges.append(len(a_ends))
            b_edges.append(len(b_ends))
        x, y = np.array(a_ends, np.int64), np.array(b_ends, np.int64)
        starts = align.lanes(x, y, np.array(a_edges), np.array(b_edges), lane)
        link_a, link_b, cut = align.lockstep(x, y, *starts)
        spans = lambda ends: list(zip([0, *ends], ends))
        want = [(i, j) for i, (s, e) in enumerate(spans(a_ends)) for j, (t, f) in enumerate(spans(b_ends)) if s < f and t < e]
        assert list(zip(link_a.tolist(), link_b.tolist())) == want
        assert [a_ends[i] for i in link_a[cut]] == sorted(set(a_ends) & set(b_ends))


def test_long_documents_enter_as_lanes():
    ends = np.arange(1, 20_001)
    a_first, b_first = align.lanes(ends, ends, np.array([0, 20_000]), np.array([0, 20_000]))
    assert len(a_first) > 30 and (a_first == b_first).all() and np.diff(a_first).max() <= align.LANE


@pytest.mark.parametrize("most_sent", [1, 40, align.MOST_SENT])
def test_awkward_table(awkward, libraries, most_sent):
    cut = awkward.withColumn("text", F.substring("text", 1, 2000)).withColumn("a_ids", F.lit("x")).withColumn("row", F.lit("x"))
    extra = cut.sparkSession.createDataFrame([(20, "▁ marked"), (21, "\x00 nul"), (22, "<s> <|endoftext|>"), (23, " two  spaces\n")], "doc_id long, text string")
    rows = [(r[0], short(r[1])) for r in awkward_rows()] + [tuple(r) for r in extra.collect()]
    assert taken(align.summary(cut.unionByName(extra, allowMissingColumns=True), most_sent=most_sent)) == brute(rows, libraries)


def test_empty_table(nothing):
    assert align.summary(nothing).collect() == []


def test_lists_of_one_document(spark, libraries):
    text = "Tokenizers naïvely align 日本."
    own = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, lang string")
    row = align.align(own).first()
    left, right = spelt(text, libraries)
    links, groups = brute_links(left, right)
    assert row.a_ids == [i for i, _ in left] and row.b_ids == [i for i, _ in right] and row.lang == "kept"
    assert list(zip(row.link_a, row.link_b)) == links and len(row.cuts) == len(groups)


def test_very_long_text(spark, libraries):
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60_000))
    row = align.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    left, right = spelt(text, libraries)
    assert (row.n_a, row.n_b) == (len(left), len(right)) and row.n_groups + max(row.n_a, row.n_b) <= row.n_links + row.n_groups


def test_query_equals_brute_force(spark, sf, libraries):
    from strataspark.llm.suite import QUERIES

    got = QUERIES["op12_align_tokens"](spark, sf)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert taken(got.select(columns)) == fast_brute(rows, libraries)


def fast_brute(rows, libraries):
    """``brute`` with links found by walking both rows of spans, for whole tables."""
    made = []
    for key, text in rows:
        left, right = spelt(text, libraries)
        i = j = at_a = at_b = 0
        pairs, groups, open_a, open_b = [], [], [], []
        while i < len(left):
            pairs.append((left[i][0], right[j][0]))
            end_a, end_b = at_a + len(left[i][1]), at_b + len(right[j][1])
            if end_a <= end_b:
                open_a.append(str(left[i][0]))
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                open_b.append(str(right[j][0]))
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(open_a) + "|" + ",".join(open_b))
                open_a, open_b = [], []
        made.append((key, len(left), len(right), pairs, groups))
    documents = Counter(p for m in made for p in set(m[3]))
    most = {}
    for (a, _), n in documents.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(
        (str(k), a, b, len(g), len(p), sum(documents[x] == most[x[0]] for x in p), sum(documents[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for k, a, b, p, g in made
    )
