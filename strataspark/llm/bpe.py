"""Byte-pair encoding by backtracking, and decoding by an offset table.

A piece of text is a row of symbols.  An Aho-Corasick automaton over all
tokens finds every token at every place; the encoder takes the longest one
that may stand after the token before it, and steps back to a shorter one
where nothing fits.  Whether token b may follow token a is told by the pair
table: the pieces at a's right edge and at b's left edge, with the ranks of
the merges that swallow them, must hold no merge across the seam that comes
first.  A row of tokens whose neighbours all fit is the result of the merges,
and there is only one; so a place that led nowhere never has to be tried
again, and the work is linear in the piece.

Tokens that merging their own symbols does not give are left out of the
automaton.  Merge lists in which a merge comes before one of its parts is
made are refused: the table would not hold for them.

Decoding looks up each id's stretch in one blob of all token texts.

Files of the ``tokenizers`` library with a BPE model are served.  Its
normalizer and pre-tokenizer cut texts into pieces; for the normalizer and
pattern of word_bpe_49k.json, texts below U+0300 are cut by an equal regular
expression here.  Added tokens in a text get their own ids, as by default.

Defined results: a null or blank text has no ids and the empty decoded text;
repeated rows are each returned; an empty table gives no rows; columns of the
table pass through, also those whose names the results would take, which are
replaced by the results.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataspark.llm.common import map_texts, need_columns, text_of

NEVER = 1 << 62
# Entries a worker remembers before it starts afresh: bounds on its memory, not on what is encoded.
REMEMBERED_PIECES = 300_000
REMEMBERED_PAIRS = 2_000_000
LONGEST_REMEMBERED = 64
# Added to a symbol's character where it ends a piece and the file marks ends.
END = 0x1000

# What the file's front end must be for the short way of cutting texts.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_front_end(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts as word_bpe_49k.json does: lower-cased, by the word pattern, white space dropped."""
    cutting = json.dumps(spec.get("pre_tokenizer"))
    return spec.get("normalizer") == WORD_NORMALIZER and json.dumps(WORD_PATTERN) in cutting and '"behavior": "Removed"' in cutting


def byte_characters() -> list[str]:
    """The character that byte-level files write for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    out |= {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class Merges:
    """Tokens as rows of symbols, and which of them may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        marked = {c + end: chr(ord(c) + END) for c in byte_characters()} if end else {}
        self.symbols: dict[int, str] = {}
        for text in (*byte_characters(), *marked):
            if text in vocabulary:
                self.symbols[vocabulary[text]] = marked.get(text, text)
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, int] = {}
        right: dict[int, list[tuple[int, int]]] = {t: [(t, NEVER)] for t in self.symbols}
        left: dict[int, list[tuple[int, int]]] = {t: [(t, NEVER)] for t in self.symbols}
        parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if x not in self.symbols or y not in self.symbols or t in self.symbols:
                raise ValueError(f"merge {rank} uses a token before it is made, or makes one again")
            self.rank[x, y], made[t], parts[t] = rank, rank, (x, y)
            self.symbols[t] = self.symbols[x] + self.symbols[y]
            # What stands at the edges of t while it is built, each with the rank of the merge that swallows it.
            right[t] = [(t, NEVER), (y, rank), *right[y][1:]]
            left[t] = [(t, NEVER), (x, rank), *left[x][1:]]
        self.right, self.left = right, left
        self.length = {t: len(s) for t, s in self.symbols.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        whole: dict[int, bool] = {}
        for t in self.symbols:  # in the order of the merges: parts come first
            whole[t] = t not in parts or (whole[parts[t][0]] and whole[parts[t][1]] and not self._crossed(*parts[t], made[t]))
        self.whole = whole

    def _crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a merge across the seam of a and b comes first, and before rank ``before``."""
        rank = self.rank
        for x, swallowed_x in self.right[a]:
            for y, swallowed_y in self.left[b]:
                m = rank.get((x, y))
                # Of equal merges the one further left is made first.
                if m is not None and m < before and m < swallowed_x and m <= swallowed_y:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """The entry of the pair table, filled in when it is first asked for."""
        known = self.fitting.get((a, b))
        if known is None:
            if len(self.fitting) >= REMEMBERED_PAIRS:
                self.fitting = {}
            known = self.fitting[a, b] = not self._crossed(a, b)
        return known


class Encoder:
    """Longest matches checked against the pair table."""

    def __init__(self, merges: Merges):
        import ahocorasick

        self.merges = merges
        self.automaton = ahocorasick.Automaton()
        for t, symbols in merges.symbols.items():
            if merges.whole[t]:
                self.automaton.add_word(symbols, t)
        self.automaton.make_automaton()

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece, given as symbols."""
        length, fits = self.merges.length, self.merges.fits
        starting: list[list[int]] = [[] for _ in piece]
        for last, t in self.automaton.iter(piece):
            starting[last - length[t] + 1].append(t)  # shorter ones end earlier, so they come first
        ids: list[int] = []
        taken: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, choice = 0, len(starting[0]) - 1 if piece else -1
        while at < len(piece):
            choices = starting[at]
            while choice >= 0:
                t = choices[choice]
                if not dead[at + length[t]] and (not ids or fits(ids[-1], t)):
                    break
                choice -= 1
            if choice >= 0:
                ids.append(t)
                taken.append(choice)
                at += length[t]
                choice = len(starting[at]) - 1 if at < len(piece) else -1
            elif ids:
                dead[at] = 1
                at -= length[ids.pop()]
                choice = taken.pop() - 1
            else:
                raise ValueError("a symbol of the piece is no token")
        return ids


class Codec:
    """Ids of texts and texts of ids, as the library gives them for one file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} holds no plain BPE model")
        self.library = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.encoder = Encoder(Merges(model["vocab"], merges, self.end))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        # Pieces as text, and pieces in byte characters.
        self.known: dict[bool, dict[str, tuple[int, ...]]] = {True: {}, False: {}}
        self.byte_table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.short = word_front_end(spec)
        letter, digit = _low_class("L"), _low_class("N")
        blank = r"\t-\r \u0085 "
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{blank}{letter}{digit}]+")
        near = [chr(c) for c in range(0x300) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x300]
        self.high = re.compile("[^" + "".join(f"\\u{ord(c):04x}" for c in near) + "]")
        self._offsets(model["vocab"], spec.get("decoder"))

    def _offsets(self, vocabulary: dict[str, int], decoder: dict | None) -> None:
        """One blob of the texts of all ids, and where each begins."""
        if decoder is not None and decoder.get("type") != "ByteLevel":
            raise ValueError(f"decoder {decoder.get('type')} is not served")
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        # Without a decoder the library writes tokens as they are, with spaces between them.
        self.between = b" " if decoder is None else b""
        texts = [b""] * (max(names) + 1)
        for i, t in names.items():
            plain = decoder is None or any(c not in byte_of for c in t)
            texts[i] = (t.encode() if plain else bytes(map(byte_of.__getitem__, t))) + self.between
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.cumsum([0, *map(len, texts)])

    def _symbols(self, piece: str) -> str:
        return piece[:-1] + chr(ord(piece[-1]) + END) if self.end else piece

    def _remembered(self, found: list[str], raw: bool) -> list[tuple[int, ...]]:
        """Ids of pieces; ``raw`` pieces are text, others are in byte characters already."""
        if len(self.known[raw]) > REMEMBERED_PIECES:
            self.known[raw] = {}
        known = self.known[raw]
        out = []
        for p in found:
            ids = known.get(p)
            if ids is None:
                written = p.encode().decode("latin-1").translate(self.byte_table) if raw else p
                ids = tuple(self.encoder.encode(self._symbols(written)))
                if len(p) <= LONGEST_REMEMBERED:
                    known[p] = ids
            out.append(ids)
        return out

    def _segment(self, text: str) -> list[tuple[int, ...]]:
        if self.short and not self.high.search(text):
            return self._remembered(self.pieces.findall(text.lower()), True)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return self._remembered([p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)], False)

    def encode(self, text: str) -> list[int]:
        if self.cut_added is None:
            return list(chain.from_iterable(self._segment(text)))
        out: list[int] = []
        for k, part in enumerate(self.cut_added.split(text)):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(self._segment(part)))
        return out

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row and where each ends, for lists of ids in a row that end at ``ends``."""
        begin = self.offset[ids]
        width = self.offset[ids + 1] - begin
        counts = np.diff(ends, prepend=0)
        width[ends[counts > 0] - 1] -= len(self.between)
        stops = np.cumsum(width)
        source = np.repeat(begin - (stops - width), width)
        source += np.arange(len(source))
        return self.blob[source], np.concatenate([[0], stops])[ends]


def _low_class(category: str) -> str:
    """The characters below U+0300 of a Unicode category, for a regular-expression class."""
    return "".join(f"\\u{c:04x}" for c in range(0x300) if unicodedata.category(chr(c))[0] == category)


@lru_cache(maxsize=4)
def codec(name: str) -> Codec:
    """The codec of a tokenizer file that every machine has installed; ``name`` is a name or a path."""
    import public_tokenizers

    return Codec(name if os.path.exists(name) else public_tokenizers.path(name))


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text_column: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``ids``."""
    need_columns(docs, text_column)
    own = [c for c in docs.columns if c not in ("ids", text_column)]
    rows = docs.select(*own, text_of(text_column).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), "ids array<int>"])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(tokenizer)
        lists = [tool.encode(t) for t in piece.column(piece.num_columns - 1).to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], made], names=[*piece.schema.names[:-1], "ids"])

    return map_texts(rows, run, schema, "_text", limit=2 << 20)


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for, special tokens included; null ids count as none."""
    need_columns(encoded, "ids")
    own = [c for c in encoded.columns if c not in ("ids", "decoded")]
    rows = encoded.select(*own, "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"])
    step = 1 << 19

    def run(batches):
        tool = codec(tokenizer)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
            total = np.cumsum(counts)
            start = 0
            while start < batch.num_rows:
                before = int(total[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(total, before + step, "right")))
                part = batch.slice(start, stop - start)
                ids = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                data, ends = tool.decode_lists(ids.astype(np.int64), np.cumsum(counts[start:stop]))
                edges = [0, *ends.tolist()]
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
                start = stop

    return rows.mapInArrow(run, schema)
