"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns propose spans.  Three labelers vote on each: the *pattern* labeler
checks its form (checksum, parts, number of digits), the *gazetteer* knows
top-level domains, issuer prefixes, country codes and placeholder words, the
*context* labeler looks for cue words around it.  A vote is 1 (personal), -1
(not) or 0 (abstains).  Expectation-maximisation over the counts of vote
patterns (a few per kind: the only thing that reaches the driver) estimates
how reliable each labeler is, and its posteriors train a naive Bayes span
classifier over votes and shape, by one aggregation.

Base spans are reported whatever the classifier says; it decides about the
others (secrets, local phone numbers, identity numbers, numbers that fail a
check).  Offsets are code points, end exclusive.

Only candidates, a few short rows, are shuffled; texts are scanned once.

Defined results: a null text is empty; repeated rows are searched one by one;
a text without matches has no spans; an empty table gives no rows; columns of
the input other than the id and the text play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.llm.common import need_columns, sha256_hex, stored, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "local_phone", "identity")
LABELERS = ("pattern", "gazetteer", "context")
ROUNDS = 40

# The base patterns.  Their languages are those of the plain forms
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+
#   \+[0-9][\x20().0-9-]+[0-9]
# A failed start inside a run fails at the run's other places too, so starts are
# tried at the head of a run or at the last match's end; quantifiers that never
# need to give back are possessive.  Both keep the time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9_-]{8,}+",
    "local_phone": r"(?<![0-9+(-])(?<!\+[0-9]{1,3}[\x20-])\([0-9]{3}\)[\x20-]?[0-9]{3}-[0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A cheap test that every text with a match passes.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: t.rlike(r"(?i)(?:token|secret|passw|api[_-]?key)[a-z]{0,3}\x20?[=:]"),
    "local_phone": lambda t: t.rlike(r"\([0-9]{3}\)"),
    "identity": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "eu")
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "your")
CUES = {
    "email": r"mail|contact|write|reply",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|credit|pay",
    "phone": r"phone|tel|call|mobile|fax",
    "secret": r"key|auth|login|config",
    "local_phone": r"phone|tel|call|mobile|fax",
    "identity": r"ssn|social|security|identity",
}
COUNTER_CUES = r"version|release|isbn|invoice|order n|chapter|section|figure"


NO_MATCHES = "cast(array() as array<struct<kind:int,i:int,gap:int,match:string,before:string,after:string>>)"


def with_matches(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``, the matches of all kinds in the order of each kind; no shuffle."""
    own = [c for c in docs.columns if c != "found"]
    text = text_of()
    parts = []
    for kind in KINDS:
        guard = GUARDS[kind](text)
        parts += [
            F.when(guard, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).alias(f"_m_{kind}"),
            F.when(guard, F.split(text, PATTERNS[kind], -1)).alias(f"_p_{kind}"),
        ]
    step = docs.select(*own, *parts)

    def rows(kind: str) -> Column:
        gaps = F.col(f"_p_{kind}")
        listed = F.transform(
            f"_m_{kind}",
            lambda m, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                i.alias("i"),
                F.char_length(F.get(gaps, i)).alias("gap"),
                m.alias("match"),
                F.right(F.get(gaps, i), F.lit(40)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(20)).alias("after"),
            ),
        )
        return F.coalesce(listed, F.expr(NO_MATCHES))

    return step.select(*own, F.concat(*[rows(k) for k in KINDS]).alias("found"))


def has_match(text: Column) -> Column:
    """Whether any pattern matches."""
    out = F.lit(False)
    for kind in KINDS:
        out = out | (GUARDS[kind](text) & text.rlike(PATTERNS[kind]))
    return out


def candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored: one row per document with ``row`` (a key of its own), the key and its matches."""
    need_columns(docs, key, "text")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_of().alias("text"))
    return stored(with_matches(slim).drop("text"), "candidates")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    by_kind = {"ip": small, "card": card, "phone": F.length(digits).between(10, 15)}
    out = F.lit(True)
    for name, check in by_kind.items():
        out = F.when(kind == KINDS.index(name), check).otherwise(out)
    return out


def _votes(kind: Column, match: Column, before: Column, after: Column, valid: Column) -> dict[str, Column]:
    yes, no, silent = F.lit(1), F.lit(-1), F.lit(0)
    low, digits = F.lower(match), _digits(match)
    around = F.lower(F.concat(before, F.lit(" "), after))

    def is_kind(*names: str) -> Column:
        return kind.isin(*[KINDS.index(n) for n in names])

    pattern = F.when(~valid, no).when(is_kind("card", "phone", "ip", "email"), yes)
    pattern = pattern.when(is_kind("secret") & low.rlike(r"[0-9]") & low.rlike(r"[a-z]"), yes).otherwise(silent)
    gazetteer = (
        F.when(is_kind("email") & F.element_at(F.split(low, r"\."), -1).isin(*TOP_DOMAINS), yes)
        .when(is_kind("secret") & low.rlike("|".join(PLACEHOLDERS)), no)
        .when(is_kind("card"), F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6011|35)"), yes).otherwise(no))
        .when(is_kind("phone"), F.when(digits.rlike("^(?:1|33|34|39|41|43|44|49)"), yes).otherwise(silent))
        .when(is_kind("ip") & match.rlike(r"^(?:0|255)\."), no)
        .when(is_kind("identity") & match.rlike("^(?:000|666|9)"), no)
        .otherwise(silent)
    )
    context = F.when(around.rlike(COUNTER_CUES), no)
    for name, cue in CUES.items():
        context = context.when(is_kind(name) & around.rlike(cue), yes)
    return {"pattern": pattern, "gazetteer": gazetteer, "context": context.otherwise(silent)}


def spans_with_votes(found: DataFrame) -> DataFrame:
    """One row per match that is worth judging: row, kind, start, end, valid, base, the votes and shape features."""
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    earlier = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.char_length("match")
    placed = each.withColumn("size", size).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(earlier))
    checked = placed.withColumn("valid", _valid(F.col("kind"), F.col("match")))
    votes = _votes(F.col("kind"), F.col("match"), F.col("before"), F.col("after"), F.col("valid"))
    # A number that fails the card check is only worth a vote if it has the length of one.
    worth = F.col("valid") | (F.col("kind") != KINDS.index("card")) | F.length(_digits(F.col("match"))).between(14, 19)
    return checked.filter(worth).select(
        "row",
        "kind",
        (F.col("end") - F.col("size")).alias("start"),
        "end",
        (F.col("valid") & (F.col("kind") < len(BASE_KINDS))).alias("base"),
        *[v.cast("int").alias(n) for n, v in votes.items()],
        F.least(F.lit(8), F.floor(F.col("size") / 4)).cast("int").alias("length"),
        F.col("after").rlike("^[A-Za-z0-9]").cast("int").alias("joined"),
    )


@dataclass(frozen=True)
class Reliability:
    """What expectation-maximisation found: the share of personal spans, and vote probabilities by truth."""

    prior: float
    yes: dict[str, float]  # P(vote 1 | personal, votes)
    false_yes: dict[str, float]  # P(vote 1 | not personal, votes)

    def posterior(self, votes: dict[str, int]) -> float:
        log = math.log(self.prior) - math.log(1 - self.prior)
        for name, vote in votes.items():
            if vote:
                p, q = self.yes[name], self.false_yes[name]
                log += math.log(p / q) if vote > 0 else math.log((1 - p) / (1 - q))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, log))))


def reliabilities(patterns: list[tuple[dict[str, int], float]]) -> Reliability:
    """EM over (votes, count); it starts from labelers that are right more often than not."""
    state = Reliability(0.5, dict.fromkeys(LABELERS, 0.8), dict.fromkeys(LABELERS, 0.2))
    for _ in range(ROUNDS):
        weighted = [(votes, n, state.posterior(votes)) for votes, n in patterns]
        whole = sum(n for _, n, _ in weighted)
        prior = (sum(n * p for _, n, p in weighted) + 1) / (whole + 2)
        yes, false_yes = {}, {}
        for name in LABELERS:
            own = [(v[name], n, p) for v, n, p in weighted if v[name]]
            yes[name] = (sum(n * p for v, n, p in own if v > 0) + 4) / (sum(n * p for _, n, p in own) + 5)
            false_yes[name] = (sum(n * (1 - p) for v, n, p in own if v > 0) + 1) / (sum(n * (1 - p) for _, n, p in own) + 5)
        state = Reliability(prior, yes, false_yes)
    return state


FEATURES = ("kind", *LABELERS, "length", "joined")


def classified(spans: DataFrame) -> DataFrame:
    """``spans`` with ``personal``: base spans, and those the trained classifier accepts."""
    patterns = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    if not patterns:
        return spans.withColumn("personal", F.lit(True))
    per_votes = [({name: r[name] for name in LABELERS}, r["n"]) for r in patterns]
    found = reliabilities(per_votes)
    # Posteriors by vote pattern, at most 27 of them.
    known = {tuple(v.values()): found.posterior(v) for v, _ in per_votes}
    posterior = F.lit(found.prior)
    for votes, p in known.items():
        same = F.lit(True)
        for name, vote in zip(LABELERS, votes):
            same = same & (F.col(name) == vote)
        posterior = F.when(same, F.lit(p)).otherwise(posterior)
    # Soft counts of every feature value train the classifier in one aggregation.
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in FEATURES])
    counts = spans.select(posterior.alias("p"), F.explode(values).alias("f")).groupBy("f.feature", "f.value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")
    )
    table = {(r["feature"], r["value"]): (r["yes"], r["no"]) for r in counts.collect()}
    n_yes, n_no = (sum(t[k] for (f, _), t in table.items() if f == "kind") for k in (0, 1))
    score = F.lit(math.log((n_yes + 1) / (n_no + 1)))
    for feature in FEATURES:
        own = {v: t for (f, v), t in table.items() if f == feature}
        weight = F.lit(0.0)
        for value, (yes, no) in own.items():
            log = math.log((yes + 1) / (n_yes + len(own))) - math.log((no + 1) / (n_no + len(own)))
            weight = F.when(F.col(feature) == value, F.lit(log)).otherwise(weight)
        score = score + weight
    return spans.withColumn("personal", F.col("base") | (score > 0))


def _accepted(found: DataFrame) -> DataFrame:
    """Per row of ``found`` that has any: ``base`` and ``spans``."""
    judged = classified(stored(spans_with_votes(found), "spans")).filter("personal")
    earlier = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    judged = judged.withColumn("past", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    entry = F.struct("start", "kind", "end", "past")
    return judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), entry))).alias("base"), F.sort_array(F.collect_list(entry)).alias("spans")
    )


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: the key, ``base`` and ``spans``, arrays of (start, kind, end, past) in order.

    ``past`` is the furthest end of the spans before.
    """
    found = candidates(docs, key)
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,past:bigint>>)")
    return found.select("row", "key").join(_accepted(found), "row", "left").select(
        F.col("key").alias(key), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def digest(spans: Column) -> Column:
    return sha256_hex(written(spans))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans become one mask of the first.

    Texts without any match stay where they are; only the others are stored
    with their matches and meet their spans by row.
    """
    need_columns(docs, "text")
    own = docs.columns
    packed = docs.select("text", F.struct(*[F.col(c) for c in own]).alias("doc"))
    matched = packed.filter(F.coalesce(has_match(F.col("text")), F.lit(False)))
    held = stored(with_matches(matched.select(F.monotonically_increasing_id().alias("row"), "doc", "text")), "to_mask")
    spans = _accepted(held.select("row", "found")).select("row", "spans")
    joined = held.select("row", "doc", "text").join(spans, "row", "left")
    # Kept pieces lie between the furthest end so far and the next start; a span inside an earlier one adds nothing.
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("text")
    parts = F.transform(
        "spans",
        lambda s: F.when(
            s["start"] >= s["past"],
            F.concat(F.substring(text, s["past"].cast("int") + 1, (s["start"] - s["past"]).cast("int")), F.get(names, s["kind"])),
        ).otherwise(F.lit("")),
    )
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    rest = F.substring(text, last.cast("int") + 1, F.char_length(text))
    new = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    rewritten = joined.select(*[(new if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in own])
    return docs.filter(~F.coalesce(has_match(F.col("text")), F.lit(False))).unionByName(rewritten)
