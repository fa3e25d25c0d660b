"""Cohort definition: who qualifies, for how long, and with which flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.months import blocks_of, month_masks, month_span, months_held
from strataspark.functions.scalar import any_of, in_list, safe_ratio
from strataspark.sources.codes import flatten


def distinct_keys(df: DataFrame, key: str = "common_key") -> DataFrame:
    """Each key once.  Repeats collapse before the shuffle, so a hot key costs one row per task."""
    return df.select(key).distinct()


def claims_with(facts: DataFrame, claims: DataFrame, claim: str = "receipt_id") -> DataFrame:
    """Claims that occur among the facts, each fact's claim counted once."""
    return claims.join(distinct_keys(facts, claim), claim, "left_semi")


def cohort_by_code(
    facts: DataFrame,
    codes: Sequence[str],
    key: str = "common_key",
    code: str = "code",
    claims: DataFrame | None = None,
    claim: str = "receipt_id",
) -> DataFrame:
    """Persons with at least one fact whose code is listed.

    Facts without a person key are resolved through ``claims``: only distinct
    claim keys take part in that join, never the facts themselves.
    """
    listed = facts.filter(in_list(F.col(code), codes))
    if key in facts.columns:
        return distinct_keys(listed, key)
    return distinct_keys(claims_with(listed, claims.select(key, claim), claim), key)


def exposure_masks(
    facts: DataFrame,
    claims: DataFrame,
    codes: Sequence[str],
    key: str = "common_key",
    claim: str = "receipt_id",
    month: str = "service_month",
    code: str = "code",
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """The set of exposure months per person, as bits (:mod:`strataspark.functions.months`).

    Facts are reduced to distinct claims first, so neither side of the join
    holds a claim more often than needed and a claim with very many facts is
    one row.  When the facts name the person themselves that key counts,
    otherwise the claim's person does and the join is only a semi join.  Months
    are united in every task before persons are shuffled, once.

    ``period`` names the first and last month of the claims; without it one
    pass over their months finds them.  Tables of several periods merge with
    ``merge_month_masks``.  Texts that are no ``yyyyMM`` count as no month.
    """
    listed = facts.filter(in_list(F.col(code), codes))
    if key in facts.columns:
        dated = listed.select(key, claim).distinct().join(claims.select(claim, month), claim)
    else:
        dated = claims_with(listed, claims.select(key, claim, month), claim)
    blocks = blocks_of(period or month_span(claims, month))
    return dated.groupBy(key).agg(*month_masks(F.col(month), blocks))


def exposure_months(
    facts: DataFrame,
    claims: DataFrame,
    codes: Sequence[str],
    key: str = "common_key",
    claim: str = "receipt_id",
    month: str = "service_month",
    code: str = "code",
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct claim months per person over the claims that carry a listed code."""
    masks = exposure_masks(facts, claims, codes, key, claim, month, code, period)
    return masks.select(key, months_held(masks.columns).alias("prescription_months"))


def cohort_by_exposure(
    candidates: DataFrame, months: DataFrame, min_months: int, key: str = "common_key"
) -> DataFrame:
    """Candidates with at least ``min_months`` exposure months; a threshold of 0 keeps them all, with 0 months."""
    if min_months > 0:
        return candidates.join(months, key).filter(F.col("prescription_months") >= min_months)
    return with_exposure(candidates, months, key)


def with_exposure(candidates: DataFrame, exposure: DataFrame, key: str = "common_key") -> DataFrame:
    """Candidates with their exposure columns, 0 where they have none."""
    added = [c for c in exposure.columns if c != key]
    return candidates.join(exposure, key, "left").fillna(0, subset=added)


def _counts_by_threshold(exposed: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """One row with one count per threshold, from one pass over the persons."""
    held = F.col("prescription_months")
    return exposed.agg(*[F.count_if(held >= t).alias(name) for name, t in thresholds.items()])


def threshold_sensitivity(exposed: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Cohort size for every threshold on exposure months; 0 counts all candidates."""
    wide = _counts_by_threshold(exposed, {f"t{t}": t for t in thresholds})
    entries = [F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_patients")) for t in thresholds]
    return wide.select(F.inline(F.array(*entries)))


def definition_summary(exposed: DataFrame, population: DataFrame, definitions: Mapping[str, int]) -> DataFrame:
    """Members and prevalence per named definition (its least number of exposure months)."""
    wide = _counts_by_threshold(exposed, definitions)
    entries = [F.struct(F.lit(d).alias("definition"), F.col(d).alias("n_patients")) for d in definitions]
    people = population.agg(F.count(F.lit(1))).scalar()
    return wide.select(F.inline(F.array(*entries))).withColumn(
        "prevalence_pct", safe_ratio(F.col("n_patients"), people, 100.0)
    )


def attrition_cascade(df: DataFrame, steps: Sequence[tuple[str, Column]], start: str = "all") -> DataFrame:
    """Survivors after each inclusion step, from one aggregation.

    A null test does not survive, as in a filter.
    """
    passed = F.lit(True)
    counts = [(start, F.count(F.lit(1)))]
    for label, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append((label, F.count_if(passed)))
    wide = df.agg(*[expr.alias(f"s{i}") for i, (_, expr) in enumerate(counts)])
    entries = [
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("criterion"), F.col(f"s{i}").alias("n_remaining"))
        for i, (label, _) in enumerate(counts)
    ]
    return wide.select(F.inline(F.array(*entries)))


_BITS = 62


def _mask_name(position: int) -> str:
    return f"__mask{position // _BITS}"


def _masks(groups: Mapping[str, Sequence[str]], code: str) -> list[Column]:
    """Aggregates that collect which groups occur, one bit per group.

    A whole set of flags travels through shuffles as one number instead of one
    column each.
    """
    bits: dict[str, list[Column]] = {}
    for i, codes in enumerate(groups.values()):
        hit = F.when(in_list(F.col(code), codes), F.lit(1 << (i % _BITS))).otherwise(F.lit(0)).cast("long")
        bits.setdefault(_mask_name(i), []).append(hit)
    return [
        F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), column)).alias(name) for name, column in bits.items()
    ]


def _merged(groups: Mapping[str, Sequence[str]]) -> list[Column]:
    """Aggregates that unite masks of parts."""
    return [F.bit_or(name).alias(name) for name in dict.fromkeys(_mask_name(i) for i in range(len(groups)))]


def _bit(position: int) -> Column:
    return F.getbit(F.col(_mask_name(position)), F.lit(position % _BITS)).cast("int")


def _flags(groups: Mapping[str, Sequence[str]]) -> list[Column]:
    return [_bit(i).alias(name) for i, name in enumerate(groups)]


def claims_of(claims: DataFrame, members: DataFrame, key: str = "common_key") -> DataFrame:
    """The members' claims."""
    return claims.join(members.select(key), key, "left_semi")


def flag_pivot(
    facts: DataFrame,
    groups: Mapping[str, Sequence[str]],
    key: str = "common_key",
    code: str = "code",
    listed_only: bool = False,
    claims: DataFrame | None = None,
    claim: str = "receipt_id",
    members: DataFrame | None = None,
    own_claims: DataFrame | None = None,
) -> DataFrame:
    """Long facts to one row per key with a 0/1 column per code group.

    Groups nobody has still get a column of zeros.  ``listed_only`` drops facts
    outside every group before the shuffle; keys without a listed code are then
    absent and left to the caller's left join.  Facts without the key become
    one row per claim first, and those rows meet ``claims``.

    With ``members`` only their facts are aggregated: facts meet the members'
    claims in one join, which the planner makes a broadcast where these are
    few.  ``own_claims`` are the members' claims, when they are stored.
    """
    rows = facts.filter(in_list(F.col(code), flatten(groups))) if listed_only else facts
    if key in facts.columns:
        mine = rows if members is None else rows.join(members.select(key), key, "left_semi")
        per_key = mine.groupBy(key).agg(*_masks(groups, code))
    elif members is not None or own_claims is not None:
        own = claims_of(claims, members, key) if own_claims is None else own_claims
        per_key = rows.join(own.select(claim, key), claim).groupBy(key).agg(*_masks(groups, code))
    else:
        per_claim = rows.groupBy(claim).agg(*_masks(groups, code))
        per_key = per_claim.join(claims.select(claim, key), claim).groupBy(key).agg(*_merged(groups))
    return per_key.select(key, *_flags(groups))


def flags_and_months(
    facts: DataFrame,
    claims: DataFrame,
    groups: Mapping[str, Sequence[str]],
    codes: Sequence[str],
    key: str = "common_key",
    claim: str = "receipt_id",
    month: str = "service_month",
    code: str = "code",
    members: DataFrame | None = None,
    own_claims: DataFrame | None = None,
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """Code-group flags and exposure months per person from a single pass over the facts.

    Equal to :func:`flag_pivot` (listed codes only) beside
    :func:`exposure_months`, at the price of one scan and one join.  Persons
    without exposure have 0 months.  ``members`` and ``own_claims`` are those
    of :func:`flag_pivot`, ``period`` is that of :func:`exposure_masks`.
    """
    wanted = {**groups, "__exposed": list(codes)}
    listed = facts.filter(in_list(F.col(code), flatten(wanted)))
    dates = claims if own_claims is None else own_claims
    blocks = blocks_of(period or month_span(dates, month))
    months = month_masks(F.col(month), blocks, _bit(len(groups)) == 1)
    if key not in facts.columns and (members is not None or own_claims is not None):
        own = claims_of(claims, members, key) if own_claims is None else own_claims
        exposed = month_masks(F.col(month), blocks, in_list(F.col(code), codes))
        per_key = listed.join(own.select(claim, key, month), claim).groupBy(key).agg(*exposed, *_masks(wanted, code))
    else:
        if key in facts.columns:
            mine = listed if members is None else listed.join(members.select(key), key, "left_semi")
            per_claim = mine.groupBy(key, claim).agg(*_masks(wanted, code))
            # A fact whose claim is unknown keeps its flags and adds no month.
            dated = per_claim.join(claims.select(claim, month), claim, "left")
        else:
            per_claim = listed.groupBy(claim).agg(*_masks(wanted, code))
            dated = per_claim.join(claims.select(claim, key, month), claim)
        per_key = dated.groupBy(key).agg(*months, *_merged(wanted))
    return per_key.select(key, months_held(per_key.columns).alias("prescription_months"), *_flags(groups))


def coalesce_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Null flags become 0."""
    return df.fillna(0, subset=list(flags))


def add_composites(df: DataFrame, composites: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per named group of flags: any member set."""
    return df.withColumns({name: any_of(members) for name, members in composites.items()})


def restrict_population(persons: DataFrame, keys: DataFrame, key: str = "common_key") -> DataFrame:
    """Attributes of the members only."""
    return persons.join(keys.select(key), key, "left_semi")


def cohort_master(
    members: DataFrame,
    persons: DataFrame,
    flag_tables: Sequence[tuple[DataFrame, Sequence[str]]],
    composites: Mapping[str, Sequence[str]],
    key: str = "common_key",
) -> DataFrame:
    """Members with attributes, exposure months and all flags, one row per person.

    Every input is already one row per person and hashed by the person key, so
    the joins add no shuffle beyond the one for the attributes.
    """
    master = members.join(persons, key)
    names: list[str] = []
    for table, flags in flag_tables:
        master = master.join(table, key, "left")
        names += flags
    return add_composites(coalesce_flags(master, names), composites)
