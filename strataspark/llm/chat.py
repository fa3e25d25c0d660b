"""Chat formatting: token-level assembly of conversations with a loss mask.

A conversation becomes one sequence of token ids:

    <start> role newline text <end> newline      (for every turn)

Role and text are encoded separately by a lossless byte-level tokenizer; the
ids of ``<start>`` and ``<end>`` are reserved ones above its vocabulary and are
spliced in, so no text can produce them.  Control strings inside a text are
escaped as well: one backslash is put after the ``<`` of every
``<`` + any number of backslashes + ``|``, so that the decoded sequence can be
taken apart again as plain text.  The mask comes from prefix sums of +1 and -1
at the borders of assistant texts.

Turns are encoded where they lie; conversations are then sorted into
partitions and streamed.  A conversation leaves as numbered chunks of whole
turns, each closed at ``CHUNK`` tokens, and is read back chunk by chunk, so one
of any length needs memory for an Arrow batch.

Defined results: null text and null role are empty; turns are ordered by
turn (null first), then role and text; repeated turns are all kept; a null
conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import need_columns, ship, text_of

ROLE_WITH_LOSS = "assistant"
START, END = "<|im_start|>", "<|im_end|>"
SEQUENCES = "conv_id long, chunk long, ids array<int>, loss_mask array<tinyint>"
# Tokens at which a chunk is closed; an Arrow batch of 10,000 such chunks is some 200 MB.
CHUNK = 1 << 12
# Very long texts are encoded in parts; any cut between characters is lossless.
PART = 1 << 16
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class ChatTokenizer:
    """Ordinary ids from a file of byte-level ranks; the two ids after them are the control tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={START: self.start, END: self.end})

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i in range(0, len(text), PART):
            ids += self.encoding.encode_ordinary(text[i : i + PART])
        return ids

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")


@lru_cache(maxsize=4)
def tokenizer(name: str) -> ChatTokenizer:
    """The tokenizer of a file that every machine has installed; ``name`` is a name or a path."""
    import os

    import public_tokenizers

    return ChatTokenizer(name if os.path.exists(name) else public_tokenizers.path(name), public_tokenizers.PATTERN)


def assemble(turns: list[tuple[str, list[int], list[int]]], tok: ChatTokenizer, newline: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns given as (role, role ids, text ids)."""
    parts: list[list[int]] = []
    learnt: list[int] = []  # indices of the parts that count for the loss
    for role, role_ids, text_ids in turns:
        if role == ROLE_WITH_LOSS:
            learnt.append(len(parts) + 3)
        parts += [[tok.start], role_ids, newline, text_ids, [tok.end], newline]
    ends = np.cumsum([len(p) for p in parts])
    ids = np.fromiter((i for p in parts for i in p), np.int32, int(ends[-1]) if len(parts) else 0)
    steps = np.zeros(len(ids) + 1, np.int32)
    np.add.at(steps, ends[np.array(learnt, int) - 1], 1)
    np.add.at(steps, ends[np.array(learnt, int)], -1)
    return ids, np.cumsum(steps[:-1]).astype(np.int8)


def sequences(conversations: DataFrame, tokenizer_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows conv_id, chunk, ids, loss_mask: each conversation's chunks in order, within one partition."""
    need_columns(conversations, "conv_id", "turn", "role", "text")
    ship(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                role_ids = [tok.encode(escape(r)) for r in part.column(2).to_pylist()]
                text_ids = [tok.encode(escape(t)) for t in part.column(3).to_pylist()]
                ids = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(role_ids, ids), pa.array(text_ids, ids)],
                    names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"],
                )

    rows = turns.mapInArrow(encoded, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "text")

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_name)
        newline = tok.encode("\n")
        names, kinds = ["conv_id", "chunk", "ids", "loss_mask"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8())]
        open_id, open_turns, open_tokens, chunk, done, held = None, [], 0, 0, [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for conv_id, role, role_ids, text_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if open_turns and (conv_id != open_id or open_tokens >= CHUNK):
                    done.append((open_id, chunk, *assemble(open_turns, tok, newline)))
                    held += len(done[-1][2])
                    chunk = chunk + 1 if conv_id == open_id else 0
                    open_turns, open_tokens = [], 0
                    if held > 1 << 20:
                        yield flushed()
                        done, held = [], 0
                open_id = conv_id
                open_turns.append((role, role_ids, text_ids))
                open_tokens += len(role_ids) + len(text_ids) + 2 + 2 * len(newline)
        if open_turns:
            done.append((open_id, chunk, *assemble(open_turns, tok, newline)))
        if done:
            yield flushed()

    return ordered.mapInArrow(assembled, SEQUENCES)


def read_back(ids, mask, tok: ChatTokenizer) -> dict:
    """Take a sequence apart again: turns, text under the mask, and size of the decoded form."""
    ids, mask = np.asarray(ids), np.asarray(mask)
    starts, ends = np.flatnonzero(ids == tok.start), np.flatnonzero(ids == tok.end)
    turns = []
    for a, b in zip(starts, ends):
        role, _, text = tok.decode(ids[a + 1 : b]).partition("\n")
        turns.append((unescape(role), unescape(text)))
    borders = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    learnt = "".join(unescape(tok.decode(ids[a:b])) for a, b in zip(borders[::2], borders[1::2]))
    return {"turns": turns, "loss_text": learnt, "formatted_chars": len(tok.decode(ids))}


def digests(formatted: DataFrame, tokenizer_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """What the sequences, as ``sequences`` returns them, say when they are decoded: turns, loss text and lengths, as counts and SHA-256."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_name)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        open_id, sums, hashes = None, None, None

        def closed() -> tuple:
            n_turns, loss_chars, chars, n_tokens = sums
            return (open_id, n_turns, hashes[0].hexdigest(), loss_chars, hashes[1].hexdigest(), chars, n_tokens)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                conv_id, chunk = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if chunk == 0:
                    if sums is not None:
                        out.append(closed())
                    open_id, sums, hashes = conv_id, [0, 0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                ids = batch.column(2)[i].values
                back = read_back(ids, batch.column(3)[i].values, tok)
                turns, loss = "".join(f"{r}\n{t}\n" for r, t in back["turns"]), back["loss_text"]
                hashes[0].update(turns.encode())
                hashes[1].update(loss.encode())
                sums = [x + y for x, y in zip(sums, (len(back["turns"]), len(loss), back["formatted_chars"], len(ids)))]
            if out:
                yield rows(out)
        if sums is not None:
            yield rows([closed()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    return formatted.select("conv_id", "chunk", "ids", "loss_mask").mapInArrow(run, schema)
