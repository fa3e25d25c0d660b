"""Suffix-array style removal of long repeats: prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else, in another text or in the same one.

Ranking every byte position at doubling offsets would move some twenty bytes
per byte of text and round, so positions are sampled by content first: the
positions with the smallest hash in a stretch of ``REACH`` bytes (*anchors*).
Equal stretches have equal anchors, so two equal strings share an anchor at
the same offset.  An anchor stands for all strings that hold it at offsets
``LEAST..MOST``, and Spark ranks anchors by ever longer surroundings, dropping
those that are unique and settling those past the threshold:

1. the bytes all of these strings share (half the length): unique, none repeats;
2. all the bytes they cover (one and a half lengths): repeated, all repeat;
3. the same two tests for blocks of a sixth of the offsets, of a 36th and so
   on, down to each string by itself.

What all strings of a block repeat is told by 128-bit digests, what none can
repeat by 64-bit ones, which only let more through.  The narrow test comes
first and most blocks end there; only the others are counted by both digests
and meet their verdicts in one join.  Counts are partial aggregations, so a
passage in a third of all texts is one row per task.  A single string is what
it shares and what it covers, so the last level has one test.  What only one
level reads is deleted after it.  Texts that are equal as a whole are known by
digest, count once as partners and go whole.

Defined results: a null text is empty; texts shorter than ``length`` keep
everything; repeated rows are copies of each other; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import map_texts, need_columns, passing, stored, text_of
from strataspark.session import scratch_path

LENGTH = 400
SEED_BYTES = 16
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class Shape:
    """Offsets and extents that follow from the length of the strings."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.offsets = length // 2 + 1
        if length < 4 * SEED_BYTES:
            raise ValueError(f"strings of at least {4 * SEED_BYTES} bytes are needed")
        reach = self.offsets + SEED_BYTES - 1
        self.least = (length - reach) // 2
        self.most = self.least + self.offsets - 1
        # Blocks of offsets shrink sixfold from all of them down to one.
        self.sizes = [self.offsets]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // 6))

    def shared(self, anchor: int, low: int, high: int) -> tuple[int, int]:
        """Bytes that all strings with the anchor at offsets low..high have in common."""
        return anchor - low, anchor - high + self.length

    def covered(self, anchor: int, low: int, high: int) -> tuple[int, int]:
        """Bytes that these strings cover together."""
        return anchor - high, anchor - low + self.length


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least (or greatest) of every run of ``width`` values, from running bests of fixed blocks."""
    n = len(values) - width + 1
    fill = values[-1]
    padded = np.concatenate([values, np.full(-len(values) % width, fill, values.dtype)]).reshape(-1, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, shape: Shape) -> np.ndarray:
    """Positions whose seed hash is the least of some ``shape.offsets`` neighbouring seeds."""
    return _anchors(_seeds(data), shape) if len(data) >= shape.length else np.empty(0, np.int64)


def _anchors(h: np.ndarray, shape: Shape) -> np.ndarray:
    least = _sliding(h, shape.offsets, np.minimum)
    edge = np.zeros(shape.offsets - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), shape.offsets, np.maximum)
    return np.flatnonzero(h == chosen)


def _seeds(data: bytes) -> np.ndarray:
    """A hash of the seed that starts at each byte."""
    n = len(data) - SEED_BYTES + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:n] * _MULTIPLIERS[0] ^ words[8 : 8 + n] * _MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[2]
    h ^= h >> np.uint64(32)
    return h


def own_offsets(h: np.ndarray, places: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of each anchor in the strings whose middle it is the least seed of.

    Every string is seen at the anchor that is least in its own middle, so the
    others may leave it out.  The nearest smaller seed on either side of an
    anchor, if some middle could hold both, is an anchor too, so the anchors'
    own seeds ``h[places]`` tell.
    """
    seeds = h[places]
    first = np.maximum(places - shape.offsets + 1, 0)
    last = np.minimum(places, len(h) - shape.offsets)
    for k in range(1, len(places)):
        before, after = places[:-k], places[k:]
        near = after - before < shape.offsets
        if not near.any():
            break
        np.maximum(first[k:], before + 1, out=first[k:], where=near & (seeds[:-k] < seeds[k:]))
        np.minimum(last[:-k], after - shape.offsets, out=last[:-k], where=near & (seeds[k:] < seeds[:-k]))
    return places - last + shape.least, places - first + shape.least


def _sampled(texts: DataFrame, shape: Shape) -> DataFrame:
    """``texts`` without the text, with the anchors of each, their own offsets and digests of what all their strings share."""
    import xxhash

    short = xxhash.xxh3_64_intdigest
    kinds = {"places": pa.int32(), "leasts": pa.int16(), "mosts": pa.int16(), "cores": pa.int64()}

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        ends, columns = [0], {k: [] for k in kinds}
        for data in piece.column(piece.num_columns - 1).cast(pa.binary()).to_pylist():
            if len(data) >= shape.length:
                h = _seeds(data)
                found = _anchors(h, shape)
                least, most = own_offsets(h, found, shape)
                start, end = shape.shared(found, shape.least, shape.most)
                inside = (start >= 0) & (end <= len(data))
                columns["places"].append(found[inside])
                columns["leasts"].append(least[inside])
                columns["mosts"].append(most[inside])
                columns["cores"] += [short(data[s:e]) for s, e in zip(start[inside].tolist(), end[inside].tolist())]
            ends.append(len(columns["cores"]))
        columns["cores"] = [np.array(columns["cores"], np.uint64).view(np.int64)]
        made = []
        for name, kind in kinds.items():
            values = np.concatenate(columns[name]).astype(kind.to_pandas_dtype()) if columns[name] else []
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)))
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=[*piece.schema.names[:-1], *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop("text").schema)
    made = "places array<int>, leasts array<short>, mosts array<short>, cores array<bigint>"
    return map_texts(texts, run, f"{schema}, {made}", limit=2 << 20)


def _ranked(texts: DataFrame, opened: DataFrame, shape: Shape, level: int) -> DataFrame:
    """Ranks of the blocks that the open ranges of offsets fall into; of single strings only ``whole``.

    ``opened`` has text_row, place, low, high and the anchor's own offsets,
    least and most.  Texts lie in buckets by text_row, so only the ranges move.
    """
    import xxhash

    short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    size = shape.sizes[level]

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, ranges, texts = piece.columns
        data = texts.cast(pa.binary()).to_pylist()
        held = pc.list_value_length(ranges).to_numpy()
        place, low, high, least, most = (c.to_numpy().astype(np.int64) for c in ranges.flatten().flatten())
        # One entry per block of each range.
        blocks = (high - low) // size + 1
        of = np.repeat(np.arange(len(place)), blocks)
        low = low[of] + size * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        high = np.minimum(low + size - 1, high[of])
        place, least, most, text = place[of], least[of], most[of], np.repeat(np.arange(len(held)), held)[of]
        length = np.array([len(d) for d in data])[text]
        start, end = shape.shared(place, low, high)
        # Where the shared bytes leave the text, no string of these offsets lies in it.
        kept = (high >= least) & (low <= most) & (start >= 0) & (end <= length)
        if not kept.any():
            return None
        place, low, high, least, most, text, length = (c[kept] for c in (place, low, high, least, most, text, length))
        start, end = shape.covered(place, low, high)
        inside = (start >= 0) & (end <= length)
        wholes = [
            long(data[t][s:e], o) if fits else b""
            for t, s, e, o, fits in zip(text.tolist(), start.tolist(), end.tolist(), low.tolist(), inside.tolist())
        ]
        columns = [(place, "i4"), (low, "i2"), (high, "i2"), (least, "i2"), (most, "i2")]
        if size > 1:
            start, end = shape.shared(place, low, high)
            cores = [short(data[t][s:e], o) for t, s, e, o in zip(text.tolist(), start.tolist(), end.tolist(), low.tolist())]
            columns.append((np.array(cores, np.uint64).view(np.int64), "i8"))
        made = [ids.take(pa.array(text)), *(pa.array(c.astype(k)) for c, k in columns), pa.array(wholes, pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=names)

    ranges = opened.groupBy("text_row").agg(F.collect_list(F.struct("place", "low", "high", "least", "most")).alias("ranges"))
    joined = texts.join(ranges, "text_row").select("text_row", "ranges", "text")
    schema = "text_row long, place int, low short, high short, least short, most short, "
    schema += "shared long, whole binary" if size > 1 else "whole binary"
    names = [column.split()[0] for column in schema.split(", ")]
    return map_texts(joined, run, schema, limit=512 << 10)


def _judged(ranks: DataFrame, brief) -> DataFrame:
    """Blocks in which some string may repeat, with ``all_repeat`` (every string does) and ``reopen``.

    A block is a row of its own, so counts tell what repeats.  To be looked at
    more closely are the open blocks, and one of each settled content that
    shares a rank with an open one.  What is counted is stored by ``brief`` and
    read back: then it meets the rows in plain joins, whose large partitions (a
    rank that very many places share) can be split.
    """
    columns = ["text_row", "place", "low", "high", "least", "most"]
    rank = "shared" if "shared" in ranks.columns else "whole"
    some = brief(ranks.groupBy(rank).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(rank), "repeated")
    left = ranks.join(some, rank, "left_semi")
    if rank == "whole":
        return left.select(*columns, F.lit(True).alias("all_repeat"), F.lit(False).alias("reopen"))
    left, row = brief(left, "left"), F.hash("text_row", "place")
    counted = left.groupBy("shared", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    all_repeat = (F.col("n") > 1) & (F.octet_length("whole") > 0)
    counted = brief(counted.select("shared", "whole", "first", all_repeat.alias("all_repeat")), "counted")
    by_rank = brief(counted.groupBy("shared").agg(F.max(~F.col("all_repeat")).alias("open")), "open")
    return left.join(counted.join(by_rank, "shared"), ["shared", "whole"]).select(
        *columns, "all_repeat", (~F.col("all_repeat") | (F.col("open") & (row == F.col("first")))).alias("reopen")
    )


def _level(texts: DataFrame, opened: DataFrame, shape: Shape, level: int) -> DataFrame:
    """Stored verdicts on the blocks of the open ranges; ranks and counts are gone by then."""
    with passing(texts.sparkSession) as brief:
        return stored(_judged(brief(_ranked(texts, opened, shape, level), "rank"), brief), f"judged_{level}")


def _bucketed(texts: DataFrame, key: str) -> DataFrame:
    """Store a table in buckets by ``key`` below the shared folder, so that joins on it do not move it again."""
    spark = texts.sparkSession
    path = scratch_path(spark, "texts")
    name = "texts_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def cuts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows, cut texts): every row's doc_id, text_row, n_bytes, sha256 and ``copied``; and spans and kept bytes by text_row.

    ``text_row`` stands for the text: the number of one row that has it.
    ``copied`` rows of at least ``length`` bytes are equal to another row and
    go whole; they have no entry among the cut texts.
    """
    need_columns(docs, "doc_id", "text")
    shape = Shape(length)
    texts = docs.select("doc_id", F.unhex(F.md5(text_of().cast("binary"))).alias("text_id"), text_of().alias("text"))
    with passing(docs.sparkSession) as brief:
        # Row numbers are drawn once: the sample is stored.
        sampled = brief(
            _sampled(
                texts.select(
                    F.monotonically_increasing_id().alias("row"),
                    "doc_id",
                    "text_id",
                    F.octet_length("text").cast("long").alias("n_bytes"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
                    "text",
                ),
                shape,
            ),
            "anchors",
        )
        standing = sampled.groupBy("text_id").agg(
            F.min(F.struct("row", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")
        ).select("text_id", F.col("first.row").alias("text_row"), F.col("first.doc_id").alias("first_id"), "n")
        standing = brief(standing, "standing")
        rows = sampled.select("doc_id", "text_id", "n_bytes", "sha256").join(
            standing.select("text_id", "text_row", (F.col("n") > 1).alias("copied")), "text_id"
        )
        rows = stored(rows.drop("text_id"), "rows")

        of_texts = sampled.select("row", "places", "leasts", "mosts", "cores").join(
            standing.select(F.col("text_row").alias("row")), "row", "left_semi"
        )
        seen = of_texts.select(F.explode("cores").alias("core")).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
        again = brief(seen.filter("n > 1").select("core"), "repeated")
        unfolded = of_texts.select("row", F.explode(F.arrays_zip("places", "leasts", "mosts", "cores")).alias("e")).select(
            F.col("row").alias("text_row"),
            F.col("e.places").alias("place"),
            F.col("e.leasts").alias("least"),
            F.col("e.mosts").alias("most"),
            F.col("e.cores").alias("core"),
        )
        kept = brief(unfolded.join(again, "core", "left_semi").drop("core"), "repeated_anchors")
        # One row stands for each text; (text, id) deals the texts out evenly.
        wanted = kept.select("text_row").distinct().join(standing, "text_row").withColumnRenamed("text_id", "_id").hint("shuffle_hash")
        repeated = texts.join(wanted, (F.col("text_id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        bucketed = _bucketed(repeated.select("text_row", "n", "text"), "text_row")
        every = [F.lit(o).cast("short").alias(name) for o, name in ((shape.least, "low"), (shape.most, "high"))]
        judged = _level(bucketed, kept.select("text_row", "place", *every, "least", "most"), shape, 0)
    spans = judged
    for level in range(1, len(shape.sizes)):
        judged = _level(bucketed, judged.filter("reopen"), shape, level)
        spans = spans.unionByName(judged)
    # Strings of one anchor overlap, so the offsets' extremes give their union.
    per_anchor = spans.filter("all_repeat").groupBy("text_row", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    per_text = per_anchor.groupBy("text_row").agg(
        F.collect_list(F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))).alias("spans")
    )

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        out_spans, kept_bytes = [], []
        for found, text in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
            data, merged = text.encode(), []
            for start, end in sorted((s["start"], s["end"]) for s in found):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept_bytes.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            out_spans.append([{"start": a, "end": b} for a, b in merged])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        made = [pa.array(out_spans, pa.list_(span)), pa.array(kept_bytes, pa.binary())]
        return pa.RecordBatch.from_arrays([piece.column(0), *made], names=["text_row", "spans", "kept"])

    own = bucketed.filter(F.col("n") == 1).join(per_text, "text_row").select("text_row", "spans", "text")
    cut_texts = map_texts(own, cut, "text_row long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return rows, cut_texts


def summary(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    rows, cut_texts = cuts(docs, length)
    measured = cut_texts.select(
        "text_row",
        F.size("spans").cast("long").alias("spans"),
        F.octet_length("kept").cast("long").alias("left"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    joined = rows.join(stored(measured, "cuts"), "text_row", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
