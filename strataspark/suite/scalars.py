"""Projections, predicates and scalar functions, applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import bands, hashing, scalar
from strataspark.operators.cohort import add_composites, coalesce_flags, flag_pivot
from strataspark.operators.quantiles import impute_median
from strataspark.operators.sampling import explode_n
from strataspark.sources import codes, star
from strataspark.suite.registry import query
from strataspark.suite.sql import band, masked, with_


@query(
    "band_left_closed",
    with_("patients")
    + f"SELECT common_key, age, {band('(age - 4)', codes.AGE_EDGES, codes.AGE_LABELS)} AS age_band FROM patients",
)
def _(spark, sf):
    banded = bands.band_left_closed(F.col("age") - 4, codes.AGE_EDGES, codes.AGE_LABELS)
    return star.patients(spark, sf).select("common_key", "age", banded.alias("age_band"))


@query(
    "band_between",
    f"""WITH v AS (SELECT c_custkey, {masked('16 + c_custkey % 80', 'c_custkey', 'age', 0.1)} AS age FROM customer)
        SELECT c_custkey, CASE WHEN age IS NULL THEN 'Unknown' WHEN age BETWEEN 16 AND 19 THEN '16-19'
          WHEN age BETWEEN 20 AND 29 THEN '20-29' WHEN age BETWEEN 30 AND 39 THEN '30-39'
          WHEN age BETWEEN 40 AND 49 THEN '40-49' WHEN age BETWEEN 50 AND 59 THEN '50-59'
          WHEN age BETWEEN 60 AND 69 THEN '60-69' WHEN age BETWEEN 70 AND 79 THEN '70-79'
          WHEN age BETWEEN 80 AND 84 THEN '80-84' ELSE '85+' END AS age_band FROM v""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    age = hashing.mask_at_rate(F.lit(16) + key % 80, key, "age", 0.1)
    return star.read(spark, sf, "customer").select(
        "c_custkey", bands.band_between(age, codes.AGE_RANGES, "85+", "Unknown").alias("age_band")
    )


@query(
    "band_right_closed",
    with_("chronic")
    + f"SELECT patient_id, {band('bmi', codes.BMI_EDGES, codes.BMI_LABELS, False)} AS bmi_category FROM chronic",
)
def _(spark, sf):
    return star.chronic_cohort(spark, sf).select(
        "patient_id", bands.band_right_closed(F.col("bmi"), codes.BMI_EDGES, codes.BMI_LABELS).alias("bmi_category")
    )


@query(
    "decode_labels",
    with_("chronic")
    + """SELECT patient_id, CASE prefecture_code WHEN '01' THEN 'Hokkaido' WHEN '11' THEN 'Saitama' WHEN '12' THEN 'Chiba'
         WHEN '13' THEN 'Tokyo' WHEN '14' THEN 'Kanagawa' WHEN '22' THEN 'Shizuoka' WHEN '23' THEN 'Aichi'
         WHEN '27' THEN 'Osaka' WHEN '28' THEN 'Hyogo' WHEN '40' THEN 'Fukuoka' ELSE 'Other' END AS prefecture_name
         FROM chronic""",
)
def _(spark, sf):
    name = bands.decode(F.col("prefecture_code"), codes.PREFECTURE_NAMES, "Other")
    return star.chronic_cohort(spark, sf).select("patient_id", name.alias("prefecture_name"))


@query(
    "in_list",
    with_("disease")
    + "SELECT code, COUNT(*) AS n FROM disease WHERE code IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY code",
)
def _(spark, sf):
    hits = star.disease_lines(spark, sf).filter(scalar.in_list(F.col("code"), star.DIAGNOSIS_BRANDS))
    return hits.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_range_date",
    """SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_totalprice >= 200000 AND o_totalprice <= 400000 AND o_orderdate <= TIMESTAMP '1998-12-31 00:00:00'""",
)
def _(spark, sf):
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    kept = star.read(spark, sf, "orders").filter(
        (price >= 200000) & (price <= 400000) & (day <= F.lit("1998-12-31 00:00:00").cast("timestamp_ntz"))
    )
    return kept.select("o_orderkey", "o_totalprice", day.cast("date").alias("day"))


@query(
    "filter_not_null",
    with_("visits") + "SELECT visit_id, visit_date, birth_date FROM visits WHERE visit_date IS NOT NULL AND birth_date IS NOT NULL",
)
def _(spark, sf):
    visits = star.checkups(spark, sf).select("visit_id", "visit_date", "birth_date")
    return visits.filter(F.col("visit_date").isNotNull() & F.col("birth_date").isNotNull())


@query(
    "in_range_open",
    with_("visits")
    + """SELECT visit_id, weight >= 60 AS from_60, weight <= 80 AS to_80, weight >= 60 AND weight <= 80 AS between_60_80,
           TRUE AS unbounded FROM visits""",
)
def _(spark, sf):
    weight = F.col("weight")
    return star.checkups(spark, sf).select(
        "visit_id",
        scalar.in_range(weight, 60.0, None).alias("from_60"),
        scalar.in_range(weight, None, 80.0).alias("to_80"),
        scalar.in_range(weight, 60.0, 80.0).alias("between_60_80"),
        scalar.in_range(weight, None, None).alias("unbounded"),
    )


@query(
    "bin_floor",
    """SELECT event_id, floor(value / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS bin_half,
              floor(value / CAST(2 AS DOUBLE)) * CAST(2 AS DOUBLE) AS bin_two FROM events""",
)
def _(spark, sf):
    value = F.col("value")
    return star.read(spark, sf, "events").select(
        "event_id", bands.bin_floor(value, 0.5).alias("bin_half"), bands.bin_floor(value, 2).alias("bin_two")
    )


@query(
    "age_at_date",
    with_("visits") + "SELECT visit_id, CAST(floor((visit_date - birth_date) / 365.25) AS INTEGER) AS age FROM visits",
)
def _(spark, sf):
    return star.checkups(spark, sf).select(
        "visit_id", scalar.age_at(F.col("visit_date"), F.col("birth_date")).alias("age")
    )


@query(
    "calendar_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y%m') AS service_month,
         substr(strftime(o_orderdate, '%Y%m'), 5, 2) AS month_text,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 365 AS INTEGER) AS DATE) AS due,
         o_orderdate <= TIMESTAMP '1997-10-01 00:00:00' AS before_cut FROM orders""",
)
def _(spark, sf):
    day = F.col("o_orderdate")
    month = scalar.service_month(day)
    return star.read(spark, sf, "orders").select(
        "o_orderkey",
        F.year(day).alias("year"),
        month.alias("service_month"),
        F.substring(month, 5, 2).alias("month_text"),
        F.date_add(day.cast("date"), (F.col("o_orderkey") % 365).cast("int")).alias("due"),
        (day <= F.lit("1997-10-01 00:00:00").cast("timestamp_ntz")).alias("before_cut"),
    )


@query(
    "pad_concat_keys",
    """SELECT 'RCP' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || strftime(o_orderdate, '%Y%m') AS receipt_key,
         'INS' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS insurer_number,
         CAST(2017 - 16 - o_custkey % 80 AS VARCHAR) || '-' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') AS birth_date, o_orderkey FROM orders""",
)
def _(spark, sf):
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    return star.read(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(scalar.padded_key("RCP", person), scalar.service_month(F.col("o_orderdate"))).alias("receipt_key"),
        scalar.padded_key("INS", person).alias("insurer_number"),
        F.concat_ws(
            "-",
            (F.lit(2017 - 16) - person % 80).cast("string"),
            F.lpad((1 + key % 12).cast("string"), 2, "0"),
            F.lpad((1 + key % 28).cast("string"), 2, "0"),
        ).alias("birth_date"),
    )


@query("pseudonym_key", "SELECT c_custkey, substr(sha256('patient_' || CAST(c_custkey AS VARCHAR)), 1, 32) AS common_key FROM customer")
def _(spark, sf):
    return star.read(spark, sf, "customer").select(
        "c_custkey", scalar.pseudonym("patient_", F.col("c_custkey")).alias("common_key")
    )


_ECONOMY = {"MTX": ["ECONOMY"], "LEF": ["ABSENT"]}


@query(
    "coalesce_flags",
    with_("patients", "medication")
    + """SELECT p.common_key, COALESCE(MTX, 0) AS MTX, COALESCE(LEF, 0) AS LEF FROM patients p LEFT JOIN
         (SELECT common_key, 1 AS MTX, 0 AS LEF FROM medication WHERE code = 'ECONOMY' GROUP BY common_key) f USING (common_key)""",
)
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    wide = flag_pivot(facts, _ECONOMY, listed_only=True, claims=star.receipts(spark, sf))
    persons = star.patients(spark, sf).select("common_key")
    return coalesce_flags(persons.join(wide, "common_key", "left"), list(_ECONOMY))


@query(
    "any_flag",
    with_("drug_flags")
    + """SELECT common_key, CASE WHEN TNFI = 1 OR IL6I = 1 OR ABT = 1 THEN 1 ELSE 0 END AS bDMARDs,
         CASE WHEN MTX = 1 OR LEF = 1 THEN 1 ELSE 0 END AS oral FROM drug_flags""",
)
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    wide = flag_pivot(facts, star.TYPE_GROUPS, claims=star.receipts(spark, sf))
    return add_composites(wide, {"bDMARDs": ["TNFI", "IL6I", "ABT"], "oral": ["MTX", "LEF"]}).select(
        "common_key", "bDMARDs", "oral"
    )


@query("pattern_label", with_("chronic") + "SELECT patient_id, comorbidity_pattern FROM chronic")
def _(spark, sf):
    parts = {"HT": F.col("has_hypertension"), "DL": F.col("has_dyslipidemia"), "CKD": F.col("has_ckd")}
    return star.chronic_cohort(spark, sf).select(
        "patient_id", scalar.pattern_label(parts, "+", " only", "none").alias("comorbidity_pattern")
    )


@query(
    "additive_score",
    """SELECT l_orderkey, l_linenumber, points, points >= 4 AS inspected FROM (SELECT l_orderkey, l_linenumber,
         CAST(1 + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.25 ELSE 0 END
           + CASE WHEN l_discount * 100 >= 8 THEN 0.5 ELSE 0 END + CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END
           + CASE WHEN l_extendedprice > 50000 THEN 1.5 ELSE 0 END AS DOUBLE) AS points FROM lineitem) x""",
)
def _(spark, sf):
    """Points of an order line for an inspection: each circumstance adds its own."""
    points = scalar.additive_score(
        1,
        [
            (F.col("l_returnflag") == "R", 2),
            (F.col("l_linestatus") == "O", 0.25),
            (F.col("l_discount") * 100 >= 8, 0.5),
            (F.col("l_quantity") < 3, 1),
            (F.col("l_extendedprice") > 50000, 1.5),
        ],
    )
    return star.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", points.alias("points"), (points >= 4).alias("inspected"))


@query(
    "case_by_operand",
    """SELECT o_orderkey, CAST(trunc(CASE quarter(o_orderdate) WHEN 1 THEN 10 + f * 8 WHEN 2 THEN 20 + f * 4
         WHEN 3 THEN 15 + f * 16 ELSE 5 + f * 2 END) AS INTEGER) AS planned_days
       FROM (SELECT *, o_totalprice / 100000 AS f FROM orders) x""",
)
def _(spark, sf):
    f = F.col("o_totalprice") / 100000
    arms = {1: 10 + f * 8, 2: 20 + f * 4, 3: 15 + f * 16}
    return star.read(spark, sf, "orders").select(
        "o_orderkey", scalar.case_by_operand(F.quarter("o_orderdate"), arms, 5 + f * 2).alias("planned_days")
    )


@query(
    "safe_ratio",
    """SELECT c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 8) AS per_nation,
              round(c_custkey / CAST(nullif(c_nationkey % 3, 0) AS DOUBLE) * 100, 1) AS pct FROM customer""",
)
def _(spark, sf):
    nation = F.col("c_nationkey")
    return star.read(spark, sf, "customer").select(
        "c_custkey",
        scalar.safe_ratio(F.col("c_acctbal"), nation, digits=8).alias("per_nation"),
        scalar.safe_ratio(F.col("c_custkey"), nation % 3, 100.0, 1).alias("pct"),
    )


@query(
    "bool_to_int",
    with_("chronic")
    + """SELECT patient_id, CAST(has_hypertension AS INTEGER) AS ht, CAST(has_dyslipidemia AS INTEGER) AS dl,
         CAST(has_ckd AS INTEGER) AS ckd, CAST(cv_event_occurred AS INTEGER) AS event FROM chronic""",
)
def _(spark, sf):
    names = {"has_hypertension": "ht", "has_dyslipidemia": "dl", "has_ckd": "ckd", "cv_event_occurred": "event"}
    return star.chronic_cohort(spark, sf).select(
        "patient_id", *[F.col(c).cast("int").alias(name) for c, name in names.items()]
    )


@query(
    "array_pick",
    f"SELECT o_orderkey, CASE o_orderkey % {len(codes.DIAGNOSIS_CODES)} "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes.DIAGNOSIS_CODES))
    + " END AS code FROM orders",
)
def _(spark, sf):
    return star.read(spark, sf, "orders").select(
        "o_orderkey",
        scalar.array_pick(codes.DIAGNOSIS_CODES, (F.col("o_orderkey") % len(codes.DIAGNOSIS_CODES)).cast("int")).alias("code"),
    )


@query(
    "struct_fields",
    """SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'IFX' ELSE 'ETN' END AS drug_name,
              CASE WHEN p_size <= 25 THEN '4400101' ELSE '4400102' END AS drug_code FROM part""",
)
def _(spark, sf):
    drug = F.when(F.col("p_size") <= 25, F.struct(F.lit("IFX").alias("name"), F.lit("4400101").alias("code"))).otherwise(
        F.struct(F.lit("ETN").alias("name"), F.lit("4400102").alias("code"))
    )
    return star.read(spark, sf, "part").withColumn("drug", drug).select(
        "p_partkey", F.col("drug.name").alias("drug_name"), F.col("drug.code").alias("drug_code")
    )


@query(
    "explode_n",
    """SELECT c_custkey, CAST(s.seq AS INTEGER) AS seq FROM customer, LATERAL (SELECT unnest(generate_series(1, c_nationkey % 5)) AS seq) s""",
)
def _(spark, sf):
    return explode_n(star.read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") % 5).select(
        "c_custkey", "seq"
    )


@query(
    "round_modes",
    """SELECT o_orderkey, round(CAST(o_orderkey % 1000 AS DOUBLE) / 8, 2) AS half_up,
              CAST(round_even(CAST(o_orderkey % 1000 AS DOUBLE) / 8, 2) AS DOUBLE) AS half_even FROM orders""",
)
def _(spark, sf):
    eighth = (F.col("o_orderkey") % 1000) / 8
    return star.read(spark, sf, "orders").select(
        "o_orderkey", F.round(eighth, 2).alias("half_up"), F.bround(eighth, 2).alias("half_even")
    )


@query(
    "impute_median",
    with_("chronic")
    + """SELECT patient_id, round(COALESCE(hba1c, (SELECT median(hba1c) FROM chronic)), 6) AS hba1c_imputed,
         round(COALESCE(bmi, (SELECT median(bmi) FROM chronic)), 6) AS bmi_imputed FROM chronic""",
)
def _(spark, sf):
    filled = impute_median(star.chronic_cohort(spark, sf).select("patient_id", "hba1c", "bmi"), ["hba1c", "bmi"])
    return filled.select(
        "patient_id", F.round("hba1c_imputed", 6).alias("hba1c_imputed"), F.round("bmi_imputed", 6).alias("bmi_imputed")
    )


@query("project_reorder", "SELECT o_custkey AS person, o_orderkey AS claim, o_orderstatus AS status FROM orders")
def _(spark, sf):
    return (
        star.read(spark, sf, "orders")
        .withColumnRenamed("o_custkey", "person")
        .drop("o_totalprice", "o_orderdate", "o_orderpriority")
        .select("person", F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("status"))
    )
