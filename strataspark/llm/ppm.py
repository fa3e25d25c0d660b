"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A context trie counts which byte follows which bytes.  A symbol is predicted
from the longest context that has seen it; each shorter step costs the escape
probability (method C: distinct symbols / (total + distinct)), and symbols the
longer contexts already offered are excluded from the shorter ones.  The last
step is uniform over the bytes not yet excluded.  The end of a text is the
byte 0xFF and the place before it the byte 0xFE, which UTF-8 never uses.

*Pretrained*: counts of four bytes in a row are gathered by Spark from the
whole training corpus.  There are at most 65,536 contexts of two bytes, and at
most ``CONTEXTS`` contexts of three bytes can each precede a ``CONTEXTS``-th
of all symbols.  So the table of their log probabilities has a proven bound
(130 MB; some 10 MB in practice) and is broadcast.  All rarer contexts of three
bytes stay in Spark, a row of the table each; a document's symbols after them,
counted, are joined by context.  *Adaptive*: each document starts with an empty
trie of any depth and learns as it is read.

Beside it stands a unigram score with add-one smoothing.  Word counts stay in
Spark: words that make up at least ``1 / FREQUENT`` of the training tokens are
at most ``FREQUENT`` many and are broadcast, all others are joined by word.

Defined results: a null text is empty, so it is scored as its end alone; a
null doc_id hashes as the empty text; repeated rows are scored one by one;
without training texts every count is 0 and the trie predicts uniformly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import map_texts, need_columns, ship, stored, text_of

FREQUENT = 1_000_000
START, END = 0xFE, 0xFF
# The token that ends every text; no word holds white space.
END_TOKEN = b" "
CONTEXTS = 60_000


def grams(text: bytes) -> np.ndarray:
    """Codes of the symbols of a text, each with the three before it."""
    a = np.frombuffer(bytes((START,) * 3) + text + bytes((END,)), np.uint8).astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]


class ByteTrie:
    """Log10 probabilities of all symbols in all contexts of up to three bytes.

    ``deep`` lists the contexts of three bytes that have a row of their own,
    after the rows of single bytes and of two bytes; ``row[c]`` is the row of
    the two-byte context ``c``, which unseen ones share with their last byte.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, deep_codes: np.ndarray, deep_counts: np.ndarray):
        """``codes`` are symbols after two bytes, ``deep_codes`` after three, each with its count."""
        codes, counts, deep_codes = (np.asarray(x, np.int64) for x in (codes, counts, deep_codes))
        contexts, at = np.unique(codes >> 8, return_inverse=True)
        after_two = np.zeros((len(contexts) + 1, 256))
        np.add.at(after_two, (at, codes & 255), counts)
        after_one = np.zeros((256, 256))
        np.add.at(after_one, ((codes >> 8) & 255, codes & 255), counts)
        alone = np.bincount(codes & 255, counts, 256) if len(codes) else np.zeros(256)
        self.deep, deep_at = np.unique(deep_codes >> 8, return_inverse=True)
        self.row = np.tile(np.arange(256, dtype=np.int32), 256)
        self.row[contexts] = 256 + np.arange(len(contexts), dtype=np.int32)
        self.first_deep = 256 + len(contexts)
        self.table = np.empty((self.first_deep + len(self.deep), 256), np.float32)

        def fill(first: int, ends: np.ndarray, levels_of) -> None:
            for i in range(0, len(ends), 1024):
                part = slice(i, min(i + 1024, len(ends)))
                lower = [after_one[ends[part] & 255], np.broadcast_to(alone, (part.stop - i, 256))]
                self.table[first + i : first + part.stop] = _blend([*levels_of(part), *lower])

        fill(0, np.arange(256), lambda part: [])
        fill(256, contexts, lambda part: [after_two[part]])
        # Counts after three bytes are unfolded for a part of the contexts at a time.
        order = np.argsort(deep_at, kind="stable")
        borders = np.searchsorted(deep_at[order], np.arange(len(self.deep) + 1))
        deep_counts = np.asarray(deep_counts, np.float64)
        place = np.full(1 << 16, len(contexts))
        place[contexts] = np.arange(len(contexts))

        def deep_levels(part: slice) -> list[np.ndarray]:
            own = order[borders[part.start] : borders[part.stop]]
            seen = np.zeros((part.stop - part.start, 256))
            seen[deep_at[own] - part.start, deep_codes[own] & 255] = deep_counts[own]
            return [seen, after_two[place[self.deep[part] & 0xFFFF]]]

        fill(self.first_deep, self.deep, deep_levels)
        self.deep = self.deep.astype(np.uint32)

    def log10(self, text: bytes) -> float:
        return self.measure(text)[0]

    def measure(self, text: bytes) -> tuple[float, np.ndarray]:
        """Log10 probability of a text, and its codes whose contexts of three bytes have no row here."""
        codes = grams(text)
        contexts = codes >> 8
        row = self.row[contexts & 0xFFFF]
        other = np.ones(len(codes), bool)
        if len(self.deep):
            at = np.searchsorted(self.deep, contexts)
            at[at == len(self.deep)] = 0
            other = self.deep[at] != contexts
            row = np.where(other, row, self.first_deep + at)
        return float(self.table[row, codes & 255].sum(dtype=np.float64)), codes[other]


def _blend(levels: list[np.ndarray]) -> np.ndarray:
    """Log10 probabilities from counts of ever shorter contexts, with escapes and exclusion."""
    p, escape = np.zeros(levels[0].shape), np.ones(len(levels[0]))
    excluded = np.zeros(levels[0].shape, bool)
    for counts in levels:
        open_counts = np.where(excluded, 0.0, counts)
        total, distinct = open_counts.sum(1), (open_counts > 0).sum(1)
        whole = np.maximum(total + distinct, 1.0)
        p = np.where(open_counts > 0, (escape / whole)[:, None] * open_counts, p)
        escape = np.where(distinct > 0, escape * distinct / whole, escape)
        excluded |= counts > 0
    rest = np.maximum(256 - excluded.sum(1), 1)
    p = np.where(excluded, p, (escape / rest)[:, None])
    return np.log10(p)


def _unfolded(codes: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One row of 256 counts for each context, from sorted codes."""
    first, end = np.searchsorted(codes, contexts << 8), np.searchsorted(codes, (contexts + 1) << 8)
    size = end - first
    row = np.repeat(np.arange(len(contexts)), size)
    at = np.arange(len(row)) + np.repeat(first - (np.cumsum(size) - size), size)
    out = np.zeros((len(contexts), 256))
    out[row, codes[at] & 255] = counts[at]
    return out


def adaptive_log10(text: bytes, order: int = 4) -> float:
    """Log10 probability of a text by a trie that starts empty and learns each symbol after predicting it."""
    data = bytes((START,)) * order + text + bytes((END,))
    trie: dict[bytes, Counter] = {}
    total = 0.0
    for i in range(order, len(data)):
        symbol, excluded, p = data[i], set(), 1.0
        for depth in range(order, -1, -1):
            counts = trie.get(data[i - depth : i])
            if not counts:
                continue
            open_counts = {s: n for s, n in counts.items() if s not in excluded}
            if not open_counts:
                continue
            whole = sum(open_counts.values()) + len(open_counts)
            if symbol in open_counts:
                p *= open_counts[symbol] / whole
                break
            p *= len(open_counts) / whole
            excluded |= open_counts.keys()
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
        for depth in range(order + 1):
            trie.setdefault(data[i - depth : i], Counter())[symbol] += 1
    return total


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """True for the ids whose CRC-32, as text, falls into the part that training leaves out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def tokens(text: str) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased, as UTF-8, and its end."""
    return [*text.encode().lower().split(), END_TOKEN]


def corpus_counts(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (code, n): token counts and counts of four symbols in a row of all training texts.

    Each piece of a task is counted in its worker; Spark adds up the rest.
    """

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        words: Counter = Counter()
        codes = []
        for text in piece.column(0).to_pylist():
            words.update(tokens(text))
            codes.append(grams(text.encode()))
        found, times = np.unique(np.concatenate(codes), return_counts=True)
        n = len(words)
        word = pa.array([*words, *[None] * len(found)], pa.binary())
        code = pa.array(np.concatenate([np.zeros(n, np.int64), found.astype(np.int64)]), mask=np.arange(n + len(found)) < n)
        times = pa.array(np.concatenate([np.fromiter(words.values(), np.int64, n), times.astype(np.int64)]))
        return pa.RecordBatch.from_arrays([word, code, times], names=["word", "code", "n"])

    counted = map_texts(training.select(text_of().alias("text")), count, "word binary, code long, n long", limit=12 << 20)
    # One shuffle adds up both kinds; each row has either a word or a code.
    both = stored(counted.groupBy("word", "code").agg(F.sum("n").alias("n")), "corpus_counts")
    return both.filter("word IS NOT NULL").select("word", "n"), both.filter("code IS NOT NULL").select("code", "n")


def trie_of(codes: DataFrame) -> tuple[ByteTrie, DataFrame]:
    """The trie of the frequent contexts from summed counts, and ``rare_rows`` of all others.

    At most 2 ** 24 counts after two bytes and 256 * ``CONTEXTS`` after three
    reach the driver.
    """
    whole = codes.agg(F.sum("n")).first()[0] or 0
    context = F.shiftright("code", 8).alias("context")
    shallow = codes.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    often = codes.groupBy(context).agg(F.sum("n").alias("m")).filter(F.col("m") >= whole / CONTEXTS).select("context")
    placed = codes.withColumn("context", context)
    deep = placed.join(often, "context", "left_semi").select("code", "n").toArrow()
    order = np.argsort(shallow.column("code").to_numpy())
    low = tuple(shallow.column(c).to_numpy()[order] for c in ("code", "n"))
    trie = ByteTrie(*low, *(deep.column(c).to_numpy() for c in ("code", "n")))
    return trie, rare_rows(placed.join(often, "context", "left_anti"), low)


def rare_rows(codes: DataFrame, low: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Stored: (context, gain) for each context of ``codes``; ``gain`` has for all 256 symbols how far
    the log10 probability after the three bytes lies above that after the last two.

    ``low`` are the codes and counts after two bytes.
    """
    spark = codes.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(low)
    listed = codes.groupBy("context").agg(F.collect_list(F.struct("code", "n")).alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_codes, low_n = shared.value
        after_one = np.zeros((256, 256))
        np.add.at(after_one, ((low_codes >> 8) & 255, low_codes & 255), low_n)
        alone = after_one.sum(0)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                contexts = part.column(0).to_numpy()
                ends, at = np.unique(contexts & 0xFFFF, return_inverse=True)
                after_two = _unfolded(low_codes, low_n, ends)[at]
                own = part.column(1).flatten()
                codes = own.field(0).to_numpy()
                after_three = np.zeros(after_two.shape)
                row = np.repeat(np.arange(len(contexts)), pc.list_value_length(part.column(1)).to_numpy())
                after_three[row, codes & 255] = own.field(1).to_numpy()
                lower = [after_two, after_one[contexts & 255], np.broadcast_to(alone, after_two.shape)]
                gain = _blend([after_three, *lower]) - _blend(lower)
                borders = pa.array(np.arange(len(contexts) + 1, dtype=np.int32) * 256)
                rows = pa.ListArray.from_arrays(borders, pa.array(gain.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["context", "gain"])

    return stored(listed.mapInArrow(run, "context long, gain array<float>"), "rare_contexts")


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs``' doc_id with n_tokens, n_known, train_tokens, base_score and score, the trie's log10 probability."""
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    counts, codes = corpus_counts(training)
    summed = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_train, n_words = summed[0] or 0, summed[1]
    least = max(1, n_train / FREQUENT)
    # At most FREQUENT words can each be that share of all tokens.
    frequent = counts.filter(F.col("n") >= least).toArrow()
    table = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist()))
    trie, rare_contexts = trie_of(codes)
    shared = spark.sparkContext.broadcast((trie, table))
    log_whole = math.log10(n_train + n_words + 1)

    def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
        trie, known = shared.value
        rows = []
        for text in piece.column(piece.num_columns - 1).to_pylist():
            own = Counter(tokens(text))
            n_tokens, n_known, logs, rare = 0, 0, 0.0, []
            for word, times in own.items():
                n_tokens += times
                c = known.get(word)
                if c is None:
                    rare.append({"word": word, "times": times})
                else:
                    n_known += times
                    logs += times * math.log10(c + 1)
            log10, other = trie.measure(text.encode())
            deeper = [{"code": int(c), "times": int(n)} for c, n in zip(*np.unique(other, return_counts=True))]
            rows.append((n_tokens, n_known, logs, rare, deeper, log10))
        pair = pa.struct([("word", pa.binary()), ("times", pa.int64())])
        code_pair = pa.struct([("code", pa.int64()), ("times", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pair), pa.list_(code_pair), pa.float64()]
        names = ["n_tokens", "n_frequent", "logs", "rare", "deeper", "score"]
        made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=["row", "doc_id", *names])

    # A document is known by its place in the stored result, so repeated ids stay apart; the numbers are drawn once.
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_of().alias("text"))
    measured = stored(
        map_texts(
            texts,
            measure,
            "row long, doc_id long, n_tokens long, n_frequent long, logs double, rare array<struct<word:binary,times:bigint>>, "
            "deeper array<struct<code:bigint,times:bigint>>, score double",
            limit=2 << 20,
        ),
        "scored",
    )
    rare = measured.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(counts.filter(F.col("n") < least), "word").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs")
    )
    after = measured.select("row", F.explode("deeper").alias("d")).select(
        "row", F.shiftright("d.code", 8).alias("context"), F.col("d.code").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "d.times"
    )
    gained = after.join(rare_contexts, "context").groupBy("row").agg(F.sum(F.col("times") * F.get("gain", F.col("symbol"))).alias("gained"))
    return measured.drop("rare", "deeper").join(found, "row", "left").join(gained, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_whole)).alias("base_score"),
        (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"),
    )


def adaptive_scores(docs: DataFrame, order: int = 4) -> DataFrame:
    """doc_id and the log10 probability of each text by a trie of its own."""

    def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
        scores = [adaptive_log10(t.encode(), order) for t in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), measure, "doc_id long, score double")
