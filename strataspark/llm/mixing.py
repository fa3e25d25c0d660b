"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise linear weight over training time 0..1.  Its
integral is the source's share; shares are scaled to the budget and cut at
``repeats`` times the source's size, the excess going to the others by share.
The documents of a source follow one another in a fixed pseudo-random order
(a digest of their id), round after round; the words taken so far, put through
the inverse of the source's cumulative demand, give each document its training
positions.  Where a target ends inside a document, only the words up to it are
taken, so every source takes its target to the word; with ``whole`` that
document is taken to its end, so a source exceeds its target by less than one
document and no text is cut.

The running sums of a source are split into parts by the digest's first
digits: sums per part, then sums within a part, so no source meets in one task.

Defined results: a null source is a source of its own, last in order; a null
text has size 0 and takes no words; repeated rows are documents of their own;
an empty table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.llm.common import WORD, need_columns, text_of

# Digits of the order digest that split a source into parts: 16 ** 3 parts.
PART_DIGITS = 3
RESULTS = ("source_size", "target", "taken", "placements")
_KEYS = ("_none", "_source")


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Add the source's join keys, free of nulls, and the order digest."""
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16)
    return docs.select(
        *[c for c in docs.columns if c not in RESULTS],
        F.col("source").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_source"),
        digest.alias("_order"),
    )


def ranked_knots(weights: Sequence[float], tilts: Sequence[float]) -> Column:
    """Knots of a source by its rank: its weight, repeating, tilted in time but with the same integral.

    A tilt of 0.5 starts at 1.5 times the weight and ends at half of it.
    """
    each = [
        F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(w * (1 + tilt * (1 - 2 * at))).alias("weight")) for at in (0.0, 1.0)])
        for w, tilt in zip(weights, tilts)
    ]
    return F.get(F.array(*each), (F.col("rank") % len(each)).cast("int"))


def targets(parts: DataFrame, knots: Column, repeats: int = 3) -> DataFrame:
    """One row per source: rank, size, knots with the area before each segment, target.

    ``parts`` has one row per source and part.  Capped sources are those with
    the smallest cap per share; the share of the rest follows from the sums
    over the capped ones.  The windows run over one row per source.
    """
    sources = parts.groupBy(*_KEYS).agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy("_none", "_source")) - 1)
    segments = F.transform(
        "_knots",
        lambda k, i: F.struct(
            k["at"].alias("at"),
            k["weight"].alias("weight"),
            F.coalesce(F.get("_knots", i + 1)["at"] - k["at"], F.lit(0.0)).alias("width"),
            F.coalesce(F.get("_knots", i + 1)["weight"], k["weight"]).alias("next"),
        ),
    )
    area = F.aggregate("_segments", F.lit(0.0), lambda total, s: total + (s["weight"] + s["next"]) / 2 * s["width"])
    shared = ranked.withColumn("_knots", knots).withColumn("_segments", segments).withColumn("share", area)
    cap = F.lit(repeats) * F.col("source_size")
    level = F.when(F.col("share") > 0, cap / F.col("share")).otherwise(F.lit(float("inf")))
    before = everything.orderBy("_level", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(before), F.lit(0))).cast("double")
    open_share = F.sum("share").over(everything) - F.coalesce(F.sum("share").over(before), F.lit(0.0))
    filled = shared.withColumn("_level", level).select(
        "*", F.when(open_share > 0, left / open_share).alias("_rate"), F.row_number().over(everything.orderBy("_level", "rank")).alias("_k")
    )
    first = F.min(F.when(F.col("_rate") <= F.col("_level"), F.struct("_k", "_rate"))).over(everything)["_rate"]
    return filled.withColumn("_first", first).select(
        *_KEYS, "source_size", "share", "_segments", F.least(cap.cast("double"), F.coalesce(F.col("_first") * F.col("share"), cap.cast("double"))).alias("target")
    )


def _position(words_before: Column) -> Column:
    """Training time at which the source's cumulative demand reaches a number of words."""
    need = words_before / F.col("target") * F.col("share")
    reached = F.aggregate(
        "_segments",
        F.struct(F.lit(0.0).alias("area"), F.lit(None).cast("double").alias("at")),
        lambda done, s: F.struct(
            (done["area"] + (s["weight"] + s["next"]) / 2 * s["width"]).alias("area"),
            F.when(
                done["at"].isNull() & (need <= done["area"] + (s["weight"] + s["next"]) / 2 * s["width"]),
                s["at"] + _inside(need - done["area"], s),
            ).otherwise(done["at"]).alias("at"),
        ),
    )
    return F.coalesce(reached["at"], F.lit(1.0))


def _inside(area: Column, s: Column) -> Column:
    """Solve weight * x + slope * x^2 / 2 = area inside one segment."""
    slope = F.when(s["width"] > 0, (s["next"] - s["weight"]) / F.nullif(s["width"], F.lit(0.0))).otherwise(0.0)
    root = s["weight"] + F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * slope * area, F.lit(0.0)))
    return F.when(root > 0, 2 * area / F.nullif(root, F.lit(0.0))).otherwise(0.0)


def assign(docs: DataFrame, knots: Column, repeats: int = 3, whole: bool = False) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target, taken and placements.

    ``placements`` has one entry per round that takes words of the document:
    its round, position and number of words.
    """
    need_columns(docs, "doc_id", "source", "size")
    own = [c for c in docs.columns if c not in RESULTS]
    rows = keyed(docs).withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    parts = rows.groupBy(*_KEYS, "_part").agg(F.sum("size").alias("size"))
    earlier = W.partitionBy(*_KEYS).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    offsets = offsets.join(targets(parts, knots, repeats), list(_KEYS))
    placed = rows.join(offsets, [*_KEYS, "_part"])
    inside = W.partitionBy(*_KEYS, "_part").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def round_of(r: Column) -> Column:
        start = F.col("_start") + r * F.col("source_size")
        if whole:
            words = F.when(start < F.col("target"), F.col("size")).otherwise(F.lit(0).cast("long"))
        else:
            words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start))
        return F.struct(r.alias("round"), start.alias("start"), words.alias("words"))

    rounds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), round_of), lambda p: p["words"] > 0)
    placed = placed.withColumn("_rounds", rounds)
    entries = F.transform(
        "_rounds", lambda p: F.struct(p["round"].alias("round"), _position(p["start"] + p["words"] / 2).alias("position"), p["words"].alias("words"))
    )
    taken = F.aggregate("_rounds", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return placed.select(*own, "source_size", "target", taken.alias("taken"), entries.alias("placements"))


def in_training_order(assigned: DataFrame, keep: Sequence[str] = (), unplaced: bool = False) -> DataFrame:
    """One row per placement, range-sorted by position; a text is cut where the target ends inside it.

    ``keep`` names results of ``assign`` that stay beside the placement.  With
    ``unplaced`` a document of which nothing is taken stays as one row at the
    end, without round and position and with 0 words.
    """
    rest = [c for c in assigned.columns if c not in (*RESULTS, "round", "position", "words")] + list(keep)
    unfold = F.inline_outer if unplaced else F.inline
    rows = assigned.select(*rest, unfold("placements"))
    if unplaced:
        rows = rows.withColumn("words", F.coalesce("words", F.lit(0).cast("long")))
    if "text" in rest and "size" in rest:
        head = F.concat(F.lit(r"^(?s:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("words"), F.lit("}+"))
        rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), F.call_function("regexp_extract", F.col("text"), head, F.lit(0))).otherwise(F.col("text")))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def per_document(ordered: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """One row per document (``key``) of a training order: ``keep``, the words taken in all rounds, the first position."""
    return ordered.groupBy(key, *keep).agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words of its text as ``size``."""
    return docs.withColumn("size", n_words(text_of()))
