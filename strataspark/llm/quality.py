"""Rule bitmask ledger: every quality rule is evaluated once, policies are applied afterwards.

``ledger`` measures each document and stores one bit per failed rule.  A policy
is a versioned set of rules; it is applied to the stored bits, so a new policy
or an ablation never reads a text again.  All of it is DataFrame expressions:
one scan, no shuffle but for the ablation counts.

Defined results: a null text has no words and fails ``few_words``; an empty
table gives an empty ledger; repeated rows are judged one by one; columns of
the input that share a name with a measurement are dropped from the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import fence, need_columns, text_of, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_INNER = ("_text", "_words", "_lines", "_windows", "_sorted", "_places")

# Fixed value: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements, as SQL; its bit is its place in the rule list."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the filter: the rules that reject a document."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
PRODUCTION = Policy("2", tuple(r.name for r in RULES))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``.

    Windows are compared as 64-bit hashes of their three words.  Only texts
    that hold an equal pair of windows are sorted with positions; a position
    is a repeat if a neighbour in hash order is equal, and the words covered
    are summed from the gaps between such positions: n log n for any text.
    """
    need_columns(docs, "text")
    own = [c for c in docs.columns if c not in MEASURES and c not in _INNER]
    step = docs.select(*own, text_of().alias("_text"))
    step = step.select(
        *own,
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.size(F.split("_text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    step = step.select(
        *own,
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= 3,
            F.transform(
                F.slice("_words", 1, F.greatest(n - 2, F.lit(0))),
                lambda word, i: F.xxhash64(word, F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).alias("_windows"),
    )
    kept = [*own, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(*kept, F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(placed)).alias("_sorted"))
    twin = F.filter(
        "_sorted", lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"])
    )
    step = step.select(*kept, F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twin, lambda x: x["i"]))).alias("_places"))
    gaps = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    return step.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with measurements and ``failed``, whose bit k is set if rule k rejects the document."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    own = measured(docs)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    failed = bits[0] if bits else F.lit(0).cast("long")
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return own.drop("failed").withColumn("failed", fence(failed))


def mask_of(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(r) for r in policy.rules)


def rejected(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where any rule of the policy has failed."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) != 0


def ablation(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it rejects, documents kept without it.

    The ledger is first counted per bit mask (one row per mask and task), so
    only the counts are unfolded per rule.
    """
    whole = F.lit(mask_of(policy, rules)).cast("long")
    masks = book.groupBy(F.col("failed").bitwiseAND(whole).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in rules]
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = masks.select("mask", "n", F.explode(entries).alias("e")).select("mask", "n", "e.rule", "e.bit")
    without = F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy(F.lit(policy.version).alias("version"), "rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
