"""Alignment of two tokenizers' tokens, many documents at a time.

Both token rows of a text cover the same bytes.  Two tokens are linked where
their bytes overlap; where tokens of both rows end together, a cut ends a
group.  Merging the two rows of ends gives both, and here one NumPy vector of
states merges all documents of a batch in lockstep: in each step every open
document links its current tokens, then moves the pointer whose token ends
first, or both at a cut.  Documents that are through leave the vector.  A long
document enters as several lanes that begin at cuts, so that a step always
has many documents to work on.

How many documents hold a linked pair of ids is counted by Spark over all
documents.  Pairs with at least a ``MOST_SENT``-th of all (document, pair)
rows, hence at most ``MOST_SENT`` pairs, are sent to the workers as sorted
arrays; the rows of all other pairs are joined to their counts, and none of
these is hot.

Defined results: null and empty texts, and texts whose tokens do not spell a
space and the text, have no tokens, links or groups; repeated rows are
documents of their own and all count; an empty table gives no rows; columns
of the table pass through ``align`` but for those whose names its results take.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.bpe import byte_characters
from strataspark.llm.common import map_texts, need_columns, stored, text_of

# Tokens of the first row after which a document goes on in another lane, at the next cut found.
LANE = 512
# Ends that are tried for a lane's beginning; without a cut among them the lane before goes on.
TRIED = 32
MOST_SENT = 1 << 20
# Fixed value: the pre-tokenizer of the byte-level file.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LONG_RUN = re.compile(r"\S{400}|\s{400}")
RESULTS = ("a_ids", "b_ids", "link_a", "link_b", "cuts")


class Table:
    """Bytes of the tokens of a vocabulary: one blob, and where each id begins."""

    def __init__(self, texts: list[bytes]):
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.cumsum([0, *map(len, texts)])

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens in a row, and where each token ends."""
        begin = self.offset[ids]
        width = self.offset[ids + 1] - begin
        ends = np.cumsum(width)
        at = np.repeat(begin - (ends - width), width)
        at += np.arange(len(at))
        return self.blob[at], ends


class Tokens:
    """Two tokenizers: a byte-level BPE file and a piece model.

    The byte-level file's vocabulary, whose ids are its merge ranks, is also
    given to a faster library with the same pattern; texts with very long runs,
    on which that one is slow, go to the file's own library.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_texts = [names.get(i, "") for i in range(max(names) + 1)]
        self.a_table = Table([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in a_texts])
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"] != BYTE_LEVEL or not _ranked_ids(spec["model"]):
            raise ValueError(f"{a_path} is no byte-level BPE file whose ids are its merge ranks")
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        b_texts = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_texts.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_table = Table(b_texts)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that are not empty; the first is given the space that the second adds."""
        a = []
        for t in texts:
            a.append(self.a.encode(" " + t, add_special_tokens=False).ids if LONG_RUN.search(t) else self.fast.encode_ordinary(" " + t))
        return a, self.b.encode(texts, num_threads=1)


def _ranked_ids(model: dict) -> bool:
    """Whether the vocabulary numbers merged tokens in the order of their merges."""
    made = [model["vocab"][m if isinstance(m, str) else "".join(m)] for m in (x.replace(" ", "") if isinstance(x, str) else x for x in model["merges"])]
    return made == sorted(made)


@lru_cache(maxsize=2)
def tokens(a_name: str, b_name: str) -> Tokens:
    """Both tokenizers, from names of installed files or paths."""
    import public_tokenizers

    return Tokens(*(n if os.path.exists(n) else public_tokenizers.path(n) for n in (a_name, b_name)))


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1])), ends


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_edges: np.ndarray, b_edges: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of both rows at which lanes begin: each document's, and cuts within long documents."""
    more_a, more_b = [a_edges[:-1]], [b_edges[:-1]]
    for first, last in zip(a_edges[:-1].tolist(), a_edges[1:].tolist()):
        if last - first <= lane + TRIED:
            continue
        last_tried = np.arange(first + lane - 1, last - TRIED, lane)
        for _ in range(TRIED):
            if not len(last_tried):
                break
            at = np.searchsorted(b_ends, a_ends[last_tried])
            cut = b_ends[at] == a_ends[last_tried]
            more_a.append(last_tried[cut] + 1)
            more_b.append(at[cut] + 1)
            last_tried = last_tried[~cut] + 1
    # Beginnings of empty documents and of those that follow them are the same.
    return np.unique(np.concatenate(more_a)), np.unique(np.concatenate(more_b))


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of the first row, token of the second) in order of the text, and whether each ends at a cut.

    Lanes lie one behind another, each from its first tokens to those of the next.
    """
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    a_first, b_first = a_first[a_first < len(a_ends)], b_first[b_first < len(b_ends)]
    a_stop = np.append(a_first[1:], len(a_ends))
    room = a_stop - a_first + np.append(b_first[1:], len(b_ends)) - b_first
    place = np.cumsum(room) - room
    link_a, link_b = np.full(room.sum(), -1), np.empty(room.sum(), np.int64)
    cut = np.zeros(len(link_a), bool)
    a, b = a_first.copy(), b_first.copy()
    while len(a):
        link_a[place], link_b[place] = a, b
        x, y = a_ends[a], b_ends[b]
        cut[place] = x == y
        a += x <= y
        b += y <= x
        place += 1
        open_ = a < a_stop
        if not open_.all():
            a, b, place, a_stop = a[open_], b[open_], place[open_], a_stop[open_]
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def align_texts(texts: list[str], tool: Tokens) -> list[pa.ListArray]:
    """``RESULTS`` of some texts."""
    a_lists: list[list[int]] = [[] for _ in texts]
    b_lists: list[list[int]] = [[] for _ in texts]
    filled = [i for i, t in enumerate(texts) if t]
    for i, a, b in zip(filled, *tool.encode([texts[i] for i in filled])):
        a_lists[i], b_lists[i] = a, b
    sides = []
    for lists, table in ((a_lists, tool.a_table), (b_lists, tool.b_table)):
        ids, edges = _flat(lists)
        data, ends = table.gather(ids)
        sides.append((data.tobytes(), np.concatenate([[0], ends])[edges].tolist()))
    (a_raw, a_at), (b_raw, b_at) = sides
    for i in filled:
        said = b" " + texts[i].encode()
        if a_raw[a_at[i] : a_at[i + 1]] != said or b_raw[b_at[i] : b_at[i + 1]] != said:
            a_lists[i], b_lists[i] = [], []
    (a_ids, a_edges), (b_ids, b_edges) = _flat(a_lists), _flat(b_lists)
    a_ends, b_ends = (np.cumsum(np.diff(t.offset)[ids]) for t, ids in ((tool.a_table, a_ids), (tool.b_table, b_ids)))
    link_a, link_b, cut = lockstep(a_ends, b_ends, *lanes(a_ends, b_ends, a_edges, b_edges))
    link_edges = np.searchsorted(link_a, a_edges)
    of_link = np.repeat(np.arange(len(texts)), np.diff(link_edges))
    cut_links = np.flatnonzero(cut)
    cut_edges = np.searchsorted(cut_links, link_edges)
    return [
        _lists(a_ids, a_edges),
        _lists(b_ids, b_edges),
        _lists(link_a - a_edges[of_link], link_edges),
        _lists(link_b - b_edges[of_link], link_edges),
        _lists(cut_links - link_edges[of_link[cut_links]], cut_edges),
    ]


def align(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", text_column: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``a_ids`` and ``b_ids``, links as places in them (``link_a``, ``link_b``), and ``cuts``, the places of links after which a group ends."""
    need_columns(docs, text_column)
    own = [c for c in docs.columns if c not in (*RESULTS, text_column)]
    rows = docs.select(*own, text_of(text_column).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), *(f"{r} array<int>" for r in RESULTS)])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        made = align_texts(piece.column(piece.num_columns - 1).to_pylist(), tokens(a_name, b_name))
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=[*piece.schema.names[:-1], *RESULTS])

    return map_texts(rows, run, schema, "_text", limit=1 << 20)


_decimals: list[Table] = []


def group_texts(a_ids: np.ndarray, a_edges: np.ndarray, b_ids: np.ndarray, b_edges: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each document; ``a_last`` and ``b_last`` number the last tokens of all groups."""
    highest = int(max(a_ids.max(initial=0), b_ids.max(initial=0)))
    if not _decimals or len(_decimals[0].offset) <= highest + 1:
        _decimals[:] = [Table([b"%d," % i for i in range(max(highest + 1, 1 << 16))])]
    a_group = np.searchsorted(a_last, np.arange(len(a_ids)))
    b_group = np.searchsorted(b_last, np.arange(len(b_ids)))
    b_before = np.concatenate([[0], b_last + 1])
    a_at = np.arange(len(a_ids)) + b_before[a_group]
    b_at = np.arange(len(b_ids)) + a_last[b_group] + 1 if len(b_ids) else np.empty(0, np.int64)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[a_at], ids[b_at] = a_ids, b_ids
    data, ends = _decimals[0].gather(ids)
    data[ends[a_at[a_last]] - 1] = ord("|")
    data[ends[b_at[b_last]] - 1] = ord(";")
    raw, stops = data.tobytes(), np.concatenate([[0], ends])[a_edges + b_edges].tolist()
    return [raw[x : y - 1] if y > x else b"" for x, y in zip(stops, stops[1:])]


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
MEASURED = [m.split()[0] for m in MEASURES.split(", ")]


def _opened(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array(column.value_lengths().to_pylist(), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def measures_of(lists: list[pa.ListArray]) -> list[pa.Array]:
    """``MEASURED`` of the documents whose ``RESULTS`` are given."""
    (a_ids, a_edges), (b_ids, b_edges), (link_a, link_edges), (link_b, _), (cuts, cut_edges) = map(_opened, lists)
    n = len(lists[0])
    of_link = np.repeat(np.arange(n), np.diff(link_edges))
    of_cut = np.repeat(np.arange(n), np.diff(cut_edges))
    link_a, link_b = link_a + a_edges[of_link], link_b + b_edges[of_link]
    cuts = cuts + link_edges[of_cut]
    texts = group_texts(a_ids, a_edges, b_ids, b_edges, link_a[cuts], link_b[cuts])
    shas = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
    pair = a_ids[link_a] << 32 | b_ids[link_b]
    order = np.lexsort((pair, of_link))
    pair, of_pair = pair[order], of_link[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (of_pair[1:] != of_pair[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(pair)))
    pair_edges = np.searchsorted(of_pair[starts], np.arange(n + 1)).astype(np.int32)
    return [
        *(pa.array(np.diff(e)) for e in (a_edges, b_edges, cut_edges, link_edges)),
        pa.array(shas, pa.string()),
        pa.ListArray.from_arrays(pa.array(pair_edges), pa.array(pair[starts])),
        pa.ListArray.from_arrays(pa.array(pair_edges), pa.array(times.astype(np.int32))),
    ]


def measured(
    docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", text_column: str = "text"
) -> DataFrame:
    """``docs`` with its text replaced by n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs (a << 32 | b) with the links of each.

    Equal to measuring the lists of :func:`align`, which stay in the worker here.
    """
    need_columns(docs, text_column)
    own = [c for c in docs.columns if c not in (*MEASURED, text_column)]
    rows = docs.select(*own, text_of(text_column).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), MEASURES])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        lists = align_texts(piece.column(piece.num_columns - 1).to_pylist(), tokens(a_name, b_name))
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], *measures_of(lists)], names=[*piece.schema.names[:-1], *MEASURED])

    return map_texts(rows, run, schema, "_text", limit=1 << 20)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Stored: (pair, documents, best) for every pair in ``pairs`` of ``rows``; best if no pair of its first id is in more documents."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pair_counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("_a")).agg(F.max("documents").alias("_most"))  # a row for each id of the vocabulary
    judged = counts.join(most, first == F.col("_a")).select("pair", "documents", (F.col("documents") == F.col("_most")).alias("best"))
    return stored(judged, "pair_best")


def scored(rows: DataFrame, counts: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``rows`` (row, pairs, times and more) with n_best and count_sum in place of the lists."""
    total = counts.agg(F.sum("documents").alias("n")).first()["n"] or 0
    sent = counts.filter(F.col("documents") * F.lit(most_sent) >= F.lit(total)).toArrow()
    order = np.argsort(sent.column("pair").to_numpy())
    known = rows.sparkSession.sparkContext.broadcast(
        (sent.column("pair").to_numpy()[order], sent.column("documents").to_numpy()[order], sent.column("best").to_numpy()[order])
    )
    own = [c for c in rows.columns if c not in ("pairs", "times")]
    shaped = rows.select(*own, "pairs", "times")
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)]
        + ["n_best long, count_sum long, rare array<struct<pair:bigint,times:bigint>>"]
    )

    def run(batches):
        pairs_known, documents, best = known.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            edges = np.concatenate([[0], np.cumsum([k or 0 for k in lists.value_lengths().to_pylist()])]).astype(np.int64)
            pair = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pairs_known, pair).clip(max=max(len(pairs_known) - 1, 0))
            hit = pairs_known[at] == pair if len(pairs_known) else np.zeros(len(pair), bool)
            sums = []
            for value in (best, documents):
                worth = np.zeros(len(pair), np.int64)
                worth[hit] = value[at[hit]].astype(np.int64) * times[hit]
                run_of = np.concatenate([[0], np.cumsum(worth)])[edges]
                sums.append(pa.array(np.diff(run_of)))
            left = np.flatnonzero(~hit)
            kind = pa.struct([("pair", pa.int64()), ("times", pa.int64())])
            values = pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(times[left])], fields=list(kind))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, edges).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums, rare], names=[*batch.schema.names[:-2], "n_best", "count_sum", "rare"])

    near = stored(shaped.mapInArrow(run, schema), "scored")
    apart = near.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(counts, "pair")
    added = apart.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("documents")).alias("_sum")
    )
    plus = {c: F.col(c) + F.coalesce(F.col(a), F.lit(0)) for c, a in (("n_best", "_best"), ("count_sum", "_sum"))}
    return near.join(added, "row", "left").select(*own, *(v.alias(c) for c, v in plus.items()))


def summary(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", most_sent: int = MOST_SENT) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    need_columns(docs, "doc_id", "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # Row numbers are drawn once: the result is stored.
    rows = stored(measured(numbered, a_name, b_name), "aligned")
    made = scored(rows, pair_counts(rows), most_sent)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
