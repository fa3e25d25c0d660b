"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the
SHA-256 of its file and library version.  Counts are stored by both digests;
only distinct contents that the cache lacks are encoded, once each, and are
appended to it.

Two short ways serve files that cut texts as word_bpe_49k.json does, and no
others.  Normalising folds runs of ASCII white space into one space, which
such files ignore between words; texts for all other files are known as they
are.  And counting avoids the library's slow whole-text pass: a text whose characters, lower-cased too, are all below U+0300 is cut into the library's
own pre-token pieces (they cannot interact), each distinct piece is encoded by
the library once and remembered; any other text, and every text for other
files, is encoded whole.

Defined results: a null text is the empty text with 0 tokens; repeated rows
are all returned; an empty table gives no rows and leaves the cache alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.bpe import word_front_end
from strataspark.llm.common import map_texts, need_columns, stored, text_of

CACHE = "digest string, tokenizer string, n_tokens long"
# Pieces a worker remembers before it starts afresh: a bound on its memory, not on what is counted.
REMEMBERED = 400_000


def _class(*categories: str) -> str:
    """A regular-expression class of the characters below U+0300 of some Unicode categories."""
    found = [c for c in range(0x300) if unicodedata.category(chr(c))[0] in categories]
    return "".join(f"\\u{c:04x}" for c in found)


class PieceCounter:
    """Counts tokens as ``encode(text, add_special_tokens=False)`` of the tokenizer file gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_pieces = _short(path)
        letter, digit, blank = _class("L"), _class("N"), r"\t-\r \u0085 "
        # Fixed value: the pre-token pattern of the tokenizer file, with classes spelt out below U+0300.
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{blank}{letter}{digit}]+")
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)))
        # Characters whose lower case stays one character below U+0300 take the fast way.
        near = [chr(c) for c in range(0x300) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x300]
        self.high = re.compile("[^" + "".join(f"\\u{ord(c):04x}" for c in near) + "]")
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_pieces:
            return self.whole(texts)
        plain = [i for i, t in enumerate(texts) if not self.high.search(t)]
        rest = sorted(set(range(len(texts))) - set(plain))
        out = [0] * len(texts)
        for i, n in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = n
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for i in plain:
            segments = self.special.split(texts[i])
            total = len(segments) - 1
            for segment in segments:
                found = self.piece.findall(segment.lower())
                fresh = [p for p in set(found) if p not in known]
                if fresh:
                    known.update(zip(fresh, self.whole(fresh)))
                total += sum(map(known.__getitem__, found))
            out[i] = total
        return out


@lru_cache(maxsize=4)
def counter(name: str) -> PieceCounter:
    """The counter of a tokenizer file that every machine has installed; ``name`` is a name or a path."""
    return PieceCounter(_path(name))


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.path.exists(name) else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _short(path: str) -> bool:
    """Whether the short ways hold for a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return word_front_end(json.load(f))


@lru_cache(maxsize=4)
def version_digest(name: str) -> str:
    import tokenizers

    with open(_path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def content_digest(text: Column, fold: bool) -> Column:
    """Digest of a text, with runs of ASCII white space folded where the tokenizer ignores them."""
    return F.sha2((F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if fold else text).cast("binary"), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_name: str, key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes and n_tokens of every row of ``docs``; new counts are appended to the cache.

    The first pass keeps digests only.  One row stands for each missing
    digest, so a text that a third of all rows share travels and is encoded
    once.  The texts are joined to those rows by (key, digest), which deals
    them out evenly.
    """
    need_columns(docs, key, "text")
    spark = docs.sparkSession
    version = version_digest(tokenizer_name)
    texts = docs.select(F.col(key).alias("key"), text_of().alias("text"))
    digest = content_digest(F.col("text"), _short(_path(tokenizer_name))).alias("digest")
    keyed = stored(texts.select("key", F.octet_length("text").cast("long").alias("n_bytes"), digest), "digests")
    had = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    missing = keyed.groupBy("digest").agg(F.min("key").alias("least")).join(had, "digest", "left_anti")

    wanted = missing.select(F.col("digest").alias("wanted"), "least").hint("shuffle_hash")
    fresh = texts.withColumn("digest", digest).join(
        wanted, (F.col("digest") == F.col("wanted")) & F.col("key").eqNullSafe(F.col("least")), "left_semi"
    )

    def encode(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(tokenizer_name).counts(piece.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([piece.column(1), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    counted = map_texts(fresh.select("text", "digest"), encode, "digest string, n_tokens long", limit=4 << 20)
    # A repeated row may have been encoded twice; the cache gets one row.
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    # Stored apart, so that the join below is a plain one whose large partitions (a hot digest) can be split.
    have = stored(read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(have, "digest", "left").select(F.col("key").alias(key), "n_bytes", "n_tokens")
