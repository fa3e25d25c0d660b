"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

Test strings are windows of ``width`` consecutive words of an item (a shorter
item is one window).  Windows of equal length form a searcher: a table of
shifts by the last block of words skips positions where no window can end,
buckets by that block's hash hold the windows that may, and a comparison word
by word confirms them.  Documents are streamed; nothing is shuffled.

The searchers are broadcast.  Benchmark texts above ``block_bytes`` are dealt
into blocks of about that size, and each block is searched in a pass of its
own that carries the spans found so far, so any benchmark can be used.  Equal
rows are one before they are dealt, so none can fill a block.  Searchers take
some 80 bytes a byte of benchmark text, on the driver and in every worker:
about 170 MB for a full block.

Defined results: null or wordless texts have no words and no windows; items
with the same words are all reported; an item without an id is reported as
``null``; repeated documents are judged one by one; an empty benchmark or
table gives no hits; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import map_texts, need_columns, stored, text_of

RESULTS = ("n_words", "n_hit", "hit_spans", "hit_items")
# Fixed value: words of the lower-cased text, as UTF-8 bytes: digits, a-z and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 3
# Benchmark text searched in one pass.
BLOCK_BYTES = 2 << 20


def words(text: str) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased."""
    return _WORD.findall(text.encode().lower())


class Searcher:
    """Windows of one length over word numbers 1..n; 0 is any other word."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], set[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[int, tuple[int, ...], frozenset[str]]]] = defaultdict(list)
        same: dict[frozenset[str], frozenset[str]] = {}  # one object for equal sets of names
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            names = frozenset(items)
            self.buckets[window[-self.block :]].append((window[0], window, same.setdefault(names, names)))

    def search(self, ids: list[int], spans: list[tuple[int, int]], items: set[str]) -> None:
        length, block, default, shift, buckets = self.length, self.block, self.default, self.shift, self.buckets
        end, n = length, len(ids)
        while end <= n:
            if not ids[end - 1]:
                end += length
                continue
            last = tuple(ids[end - block : end])
            step = shift.get(last, default)
            if step:
                end += step
                continue
            start = end - length
            first = ids[start]
            for head, window, names in buckets[last]:
                if head == first and tuple(ids[start:end]) == window:
                    spans.append((start, end))
                    items |= names
            end += 1


class Searchers:
    """All searchers of one benchmark block."""

    def __init__(self, items: Iterable[tuple[str, str]], width: int):
        self.number: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            length = min(width, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                windows[length][tuple(ids[i : i + length])].add(name)
        self.searchers = [Searcher(length, found) for length, found in windows.items()]

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        ids = list(map(self.number.get, found, [0] * len(found)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for searcher in self.searchers:
            searcher.search(ids, spans, items)
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as sorted disjoint spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_hit, hit_spans (word numbers, end exclusive) and hit_items (sorted)."""
    need_columns(docs, "text")
    need_columns(benchmark, "item_id", "text")
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), text_of().alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    empty = "array()"
    state = docs.select(
        *[F.col(c) for c in keep if c != "text"],
        F.col("text").alias("text") if "text" in keep else text_of().alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.expr(f"cast({empty} as array<struct<start:bigint,end:bigint>>)").alias("hit_spans"),
        F.expr(f"cast({empty} as array<string>)").alias("hit_items"),
    )
    at = {c: i for i, c in enumerate(state.columns)}

    for k in range(blocks):
        # One block of bounded size comes to the driver.
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Searchers([(r["name"], r["text"]) for r in part], width))

        def search(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            find = shared.value.find
            counts, covered, spans, names = [], [], [], []
            before = zip(batch.column(at["hit_spans"]).to_pylist(), batch.column(at["hit_items"]).to_pylist())
            for text, (old_spans, old_items) in zip(batch.column(at["text"]).to_pylist(), before):
                found = words(text or "")
                new_spans, new_items = find(found)
                union = merged([*new_spans, *((s["start"], s["end"]) for s in old_spans)])
                counts.append(len(found))
                covered.append(sum(b - a for a, b in union))
                spans.append([{"start": a, "end": b} for a, b in union])
                names.append(sorted(new_items.union(old_items)))
            columns = list(batch.columns)
            columns[at["n_words"]], columns[at["n_hit"]] = pa.array(counts, pa.int64()), pa.array(covered, pa.int64())
            columns[at["hit_spans"]], columns[at["hit_items"]] = pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        state = map_texts(state, search, _nullable(state))
        if k + 1 < blocks:
            state = stored(state, "decontaminated")
    return state.select(*keep, *RESULTS)


def _nullable(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    own = docs.columns
    aside = {c: f"_own_{c}" for c in own if c in RESULTS}
    renamed = docs.withColumnsRenamed(aside)
    found = hits(renamed, benchmark, width)
    return found.filter("n_hit = 0").drop(*RESULTS).withColumnsRenamed({v: k for k, v in aside.items()}).select(*own)
