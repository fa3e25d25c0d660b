"""Phrases whose words occur together, mined from count streams kept in order.

The layout is that of external language-model estimation: everything is a
stream of counted word rows in sorted order, and streams are merged in step.

0. A first pass counts pairs of neighbouring words by 64-bit digests and marks
   those of ``least`` and more in a bit map of fixed size.  A phrase holds no
   pair below ``least``; digests and bits that fall together only let more through.
1. Every word occurrence gives one window: it and the words behind it in its
   piece, up to the first pair that is not marked, ``longest`` in all.  The
   n-grams that begin at a word are the prefixes of its window, so this one
   stream holds the counts of all lengths.  Equal windows of a batch are added
   up before they leave the worker.
2. The stream is range-sorted: windows lie in *prefix order*, and all windows
   that begin with an n-gram are neighbours.  One pass over each partition
   sums them by length.  Groups inside a partition are whole; the first and
   last of each length may go on next door, so these are passed on at any
   count and added up.  A frequent first word, pair or window is spread over as
   many partitions as it fills.
3. N-grams below ``least`` are gone: parts of a candidate occur as often as it
   does, so nothing that is asked for later is among them.  The count stream is
   stored twice, in prefix order and in *suffix order* (words reversed).
4. First parts of all cuts meet their counts by a sort-merge join in prefix
   order, last parts in suffix order; the counts of phrases one word longer
   meet the phrase without their last word in prefix order and the phrase
   without their first word in suffix order.  A phrase inside any longer one
   is inside one that is a word longer and at least as frequent, so that is enough.

Everything is exact; products are decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``; repeated
rows count each time; ties are ordered by the phrase's bytes; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.common import map_texts, need_columns, stored, text_of

LEAST = 30
LONGEST = 4
# What ends a piece, and what parts words inside one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"


def _table() -> bytes:
    """Byte for byte: A-Z to a-z, ends of pieces to a line feed, blanks to a space."""
    table = bytearray(bytes(range(256)).lower())
    for b in PIECE_ENDS:
        table[b] = 10
    for b in BLANKS:
        table[b] = 32
    return bytes(table)


TABLE = _table()


class Words:
    """The words of UTF-8 texts that line feeds keep apart, in one buffer with a space behind each."""

    def __init__(self, data: bytes):
        raw = data.translate(TABLE)
        buffer = np.frombuffer(raw, np.uint8)
        blank = (buffer == 32) | (buffer == 10)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        piece = np.searchsorted(np.flatnonzero(buffer == 10), first)
        self.joined = b" ".join(raw.split()) + b" "
        self.starts = np.concatenate([[0], np.cumsum(last - first + 1)])
        self.count = len(first)
        # Whether a word and the next one stand in one piece.
        self.paired = piece[1:] == piece[:-1] if self.count else np.empty(0, bool)

    def pair_digests(self, lang: str) -> np.ndarray:
        """A 64-bit digest of each word with the next one."""
        if self.count < 2:
            return np.empty(0, np.uint64)
        data = np.frombuffer(self.joined, np.uint8)
        power = np.full(len(data), BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power)])
        begin, end = self.starts[:-2], self.starts[2:]
        # Shifted to one common power instead of dividing by the power of the place.
        h = (sums[end] - sums[begin]) * power[len(data) - 1 - begin]
        h *= _power(np.uint64(BASE), SHIFT - len(data))
        h += np.uint64(zlib.crc32(lang.encode()))
        h *= MIX
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ h >> np.uint64(29)

    def windows(self, marked: np.ndarray, longest: int) -> list[bytes]:
        """The window of every word: it and those behind it, as far as pairs of one piece are marked."""
        going = np.concatenate([marked & self.paired, [False]])[: self.count]
        stop, on = np.arange(1, self.count + 1), np.ones(self.count, bool)
        for k in range(longest - 1):
            on = on & np.concatenate([going[k:], np.zeros(min(k, self.count), bool)])[: self.count]
            stop += on
        return [self.joined[a:b] for a, b in zip(self.starts[:-1].tolist(), self.starts[stop].tolist())]


BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
# Every digest is written to this power of the base, so it does not depend on the batch.
SHIFT = 1 << 40
BITS = 1 << 27


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def windows(data: bytes, longest: int = LONGEST) -> list[bytes]:
    """The window of every word where every pair is marked."""
    words = Words(data)
    return words.windows(np.ones(len(words.paired), bool), longest)


def _escaped(lang: str) -> bytes:
    return lang.encode().replace(b"%", b"%25").replace(b" ", b"%20").replace(b"\n", b"%0A")


def _unescaped(lang: bytes) -> str:
    return lang.replace(b"%0A", b"\n").replace(b"%20", b" ").replace(b"%25", b"%").decode()


def _rows(docs: DataFrame) -> DataFrame:
    need_columns(docs, "text", "lang")
    return docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), text_of().alias("text"))


def _by_lang(piece: pa.RecordBatch) -> list[tuple[str, Words]]:
    held: dict[str, list[str]] = {}
    for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
        held.setdefault(lang, []).append(text)
    return [(lang, Words("\n".join(texts).encode())) for lang, texts in held.items()]


def _places(digests: np.ndarray) -> list[np.ndarray]:
    """The two bits of each digest in the map."""
    return [(digests & np.uint64(BITS - 1)).astype(np.int64), (digests >> np.uint64(37)).astype(np.int64) & (BITS - 1)]


def marked_pairs(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """The bit map of pairs of at least ``least`` occurrences; 16 MB, whatever the table."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [w.pair_digests(lang)[w.paired] for lang, w in _by_lang(piece)]
        digests, counts = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(counts)], names=["digest", "n"])

    counted = map_texts(_rows(docs), run, "digest long, n long", limit=4 << 20)
    often = counted.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    places = F.array(F.col("digest").bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned("digest", 37).bitwiseAND(F.lit(BITS - 1)))
    bits = often.select(F.explode(places).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")
    )
    # One row for a word of the map: two million at most.
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def window_counts(docs: DataFrame, pairs: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(window, n): language, line feed and the words of each window, counted by batch; ``pairs`` is the map of marked pairs."""
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        table, one = sent.value, np.uint64(1)
        keys, counts = [], []
        for lang, words in _by_lang(piece):
            first, second = (table[at >> 6] >> (at & 63).astype(np.uint64) & one for at in _places(words.pair_digests(lang)))
            found = Counter(words.windows((first & second).astype(bool), longest))
            before = _escaped(lang) + b"\n"
            keys += [before + w for w in found]
            counts += found.values()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["window", "n"])

    return map_texts(_rows(docs), run, "window binary, n long", limit=4 << 20)


class Scan:
    """Sums of windows in prefix order, by the language and by 1 to ``longest`` words."""

    def __init__(self, least: int, longest: int):
        self.least, self.levels = least, longest + 1
        self.open: list[tuple[bytes, int] | None] = [None] * self.levels
        self.closed = [0] * self.levels
        self.out: list[tuple[bytes, int, int]] = []

    def _close(self, level: int) -> None:
        """Pass on the open group if it is frequent, a language, or the first of the partition."""
        if self.open[level] is not None:
            key, n = self.open[level]
            if n >= self.least or level == 0 or not self.closed[level]:
                self.out.append((key, level, n))
            self.closed[level] += 1
            self.open[level] = None

    def add(self, column: pa.Array, counts: np.ndarray) -> None:
        """Take a batch of windows that follow those before in order."""
        if not len(column):
            return
        column = pa.concat_arrays([column])  # without an offset
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1).astype(np.int64)
        raw = memoryview(column.buffers()[2])
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]]
        ends = np.flatnonzero((data == 10) | (data == 32)) + 1
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), column.buffers()[2]])
        codes = parts.dictionary_encode().indices.to_numpy()
        before = np.searchsorted(ends, offsets[:-1], "right")
        row = np.searchsorted(offsets[1:], ends)
        place = np.arange(len(ends)) - before[row]
        code = np.full((len(column), self.levels), -1, np.int64)
        end = np.zeros((len(column), self.levels), np.int64)
        code[row, place], end[row, place] = codes, ends
        new = np.ones((len(column), self.levels), bool)
        new[1:] = np.logical_or.accumulate(code[1:] != code[:-1], axis=1)
        for level in range(self.levels):
            starts = np.flatnonzero(new[:, level])
            sums = np.add.reduceat(counts, starts)
            real = code[starts, level] >= 0
            starts, sums = starts[real], sums[real]
            if not len(starts):
                continue
            key = lambda k: bytes(raw[offsets[starts[k]] : end[starts[k], level]])  # noqa: E731, B023
            if self.open[level] is not None and self.open[level][0] == key(0):
                sums[0] += self.open[level][1]
                self.open[level] = None
            else:
                self._close(level)
            # All but the last group are through; the partition's first is passed on whatever its count.
            through = len(starts) - 1
            pick = np.flatnonzero(sums[:through] >= (0 if level == 0 else self.least)).tolist()
            if through and not self.closed[level] and (not pick or pick[0] != 0):
                pick.insert(0, 0)
            self.out += [(key(k), level, int(sums[k])) for k in pick]
            self.closed[level] += through
            self.open[level] = (key(through), int(sums[through]))

    def end(self) -> None:
        """Pass on the last group of each length, which may go on in the next partition."""
        for level in range(self.levels):
            if self.open[level] is not None:
                key, n = self.open[level]
                self.out.append((key, level, n))
                self.open[level] = None

    def batch(self) -> pa.RecordBatch:
        langs, phrases = [], []
        for key, _, _ in self.out:
            lang, phrase = key.split(b"\n", 1)
            langs.append(_unescaped(lang))
            phrases.append(phrase[:-1].decode())
        made = [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([o[1] for o in self.out], pa.int32()), pa.array([o[2] for o in self.out], pa.int64())]
        self.out = []
        return pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "k", "n"])


def gram_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Stored: (lang, phrase, k, n) of every phrase of 1 to ``longest`` words with n >= least, and each language's words as k = 0."""
    # Stored, because dealing by ranges looks at the rows twice.
    counted = stored(window_counts(docs, marked_pairs(docs, least), longest), "windows")
    ordered = counted.repartitionByRange("window").sortWithinPartitions("window")

    def run(batches):
        scan = Scan(least, longest)
        for batch in batches:
            scan.add(batch.column(0), batch.column(1).to_numpy())
            if scan.out:
                yield scan.batch()
        scan.end()
        if scan.out:
            yield scan.batch()

    parts = stored(ordered.mapInArrow(run, "lang string, phrase string, k int, n long"), "gram_parts")
    summed = parts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return stored(summed.filter((F.col("n") >= least) | (F.col("k") == 0)), "grams")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 80, scale: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a, cut, l, r, score) of every candidate that no longer phrase stands for; and (lang, n), the words of each language."""
    grams = gram_counts(docs, least, longest)
    words = F.split("phrase", " ")
    counted = grams.filter("k > 0").select("lang", "phrase", "k", "n", words.alias("words"), _joined(F.reverse(words)).alias("back"))
    prefix_order = stored(counted.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase"), "prefix_order")
    suffix_order = stored(prefix_order.select("lang", "back", "k", "n").repartitionByRange("lang", "back").sortWithinPartitions("lang", "back"), "suffix_order")

    found = prefix_order.filter("k >= 2")
    at = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = found.select("lang", "phrase", "back", "n", "k", "words", at).select(
        "lang", "phrase", "back", "n", "k", "cut",
        _joined(F.slice("words", 1, F.col("cut"))).alias("first"),
        _joined(F.reverse(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")))).alias("rest_back"),
    )
    firsts = prefix_order.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")).hint("merge")
    rests = suffix_order.select("lang", F.col("back").alias("rest_back"), F.col("n").alias("r")).hint("merge")
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    score = F.expr(f"({scale} * {wide('n')}) DIV ({wide('l')} + {wide('r')})")
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest_back"]).withColumn("score", score)
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    judged = scored.groupBy("lang", "phrase", "back", "k", F.col("n").alias("a")).agg(lowest).select("lang", "phrase", "back", "k", "a", "low.*")

    longer = prefix_order.filter("k >= 3").select("lang", "words", "k", "n")
    to_right = longer.groupBy("lang", _joined(F.slice("words", F.lit(1), F.col("k") - 1)).alias("phrase")).agg(F.max("n").alias("right"))
    to_left = longer.groupBy("lang", _joined(F.reverse(F.slice("words", F.lit(2), F.col("k") - 1))).alias("back")).agg(F.max("n").alias("left"))
    most = F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0)))
    covered = F.lit(100).cast("decimal(10,0)") * most.cast("decimal(20,0)") >= F.lit(percent).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
    kept = judged.join(to_right.hint("merge"), ["lang", "phrase"], "left").join(to_left.hint("merge"), ["lang", "back"], "left").filter(~covered)
    return kept.select("lang", "phrase", "k", "a", "cut", "l", "r", "score"), grams.filter("k = 0").select("lang", "n")


def top(found: DataFrame, totals: DataFrame, first: int = 2000, parts: int = 64) -> DataFrame:
    """The ``first`` rows of each language, ranked by score, count and phrase, with its words.

    Phrases compete in parts of their language first, so the last ranking sees
    at most ``parts`` times ``first`` rows of a language; only those that are
    left meet the totals.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    near = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
