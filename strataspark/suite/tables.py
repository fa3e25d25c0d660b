"""Sources, sinks and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.scalar import age_at
from strataspark.session import scratch_path
from strataspark.sources import history, codes, star, tables
from strataspark.sources.schemas import BRONZE, conform
from strataspark.suite.registry import query
from strataspark.suite.sql import with_

ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _non_null(df: DataFrame) -> DataFrame:
    """Non-null values per column as rows, from one aggregation."""
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in df.columns]
    return wide.select(F.inline(F.array(*entries)))


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scan_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "scan_star_derived",
    with_("visits")
    + """SELECT *, CAST(floor((visit_date - birth_date) / 365.25) AS INTEGER) AS age FROM visits
         WHERE visit_date IS NOT NULL AND birth_date IS NOT NULL""",
)
def _(spark, sf):
    both = F.col("visit_date").isNotNull() & F.col("birth_date").isNotNull()
    return tables.scan_derived(star.checkups(spark, sf), {"age": age_at(F.col("visit_date"), F.col("birth_date"))}, both)


@query(
    "code_set",
    with_("medication")
    + """SELECT s.code_group, s.code, COUNT(m.code) AS n FROM (VALUES ('MTX', 'ECONOMY'), ('SSZ', 'LARGE'), ('TNFI', 'MEDIUM'),
           ('IL6I', 'PROMO'), ('ABT', 'SMALL'), ('CS', 'STANDARD'), ('LEF', 'ABSENT')) s(code_group, code)
         LEFT JOIN medication m ON m.code = s.code GROUP BY s.code_group, s.code""",
)
def _(spark, sf):
    # Facts are counted per code first, so the code list meets one row per code.
    counted = star.medication_lines(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return codes.code_set(spark, star.TYPE_GROUPS).join(counted, "code", "left").fillna(0, ["n"])


@query(
    "reference_values",
    with_("patients")
    + "SELECT p.age_group, p.n, r.pct AS paper_pct, r.prev AS paper_prevalence, r.female AS paper_female_pct, r.ratio AS paper_fm_ratio FROM "
    + "(SELECT age_group, COUNT(*) AS n FROM patients GROUP BY age_group) p LEFT JOIN (VALUES "
    + ", ".join(
        "('{}', {})".format(k, ", ".join("NULL" if v is None else f"CAST({v} AS DOUBLE)" for v in values))
        for k, values in codes.published_by_age().items()
    )
    + ") r(age_group, pct, prev, female, ratio) ON p.age_group = r.age_group",
)
def _(spark, sf):
    names = ["paper_pct", "paper_prevalence", "paper_female_pct", "paper_fm_ratio"]
    published = codes.reference_values(spark, codes.published_by_age(), "age_group", names)
    counted = star.patients(spark, sf).groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(published, "age_group", "left")


@query(
    "row_source",
    """SELECT s.id, COUNT(o_orderkey) AS n_orders
       FROM (SELECT unnest(generate_series(0, (SELECT max(c_custkey) FROM customer))) AS id) s
       LEFT JOIN orders ON o_custkey = s.id GROUP BY s.id""",
)
def _(spark, sf):
    # The end of the range stays inside the plan; an empty table gives no rows.
    last = star.read(spark, sf, "customer").agg(F.max("c_custkey").alias("last"))
    counted = star.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return tables.row_source_to(last, "last").join(counted, "id", "left").fillna(0, ["n_orders"])


@query(
    "write_overwrite",
    """SELECT o_orderstatus, COUNT(*) AS n, CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS rows_written,
              CAST(MIN(o_orderkey) AS BIGINT) AS first_key, CAST(MAX(o_orderkey) AS BIGINT) AS last_key
       FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf):
    path = scratch_path(spark, "overwrite")
    orders = star.read(spark, sf, "orders")
    tables.write_overwrite(orders.filter("o_orderstatus = 'F'"), path)
    written = tables.write_overwrite(orders, path)
    return tables.scan_table(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(written).cast("long").alias("rows_written"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
    )


def _database(spark: SparkSession, name: str) -> str:
    """A database of its own below the shared folder, for one run."""
    path = scratch_path(spark, name)
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{path}'")
    return database


@query(
    "create_table_as",
    with_("receipts")
    + """SELECT common_key, COUNT(*) AS n_claims, COUNT(DISTINCT service_month) AS n_months FROM receipts
         GROUP BY common_key""",
)
def _(spark, sf):
    database = _database(spark, "ctas")
    star.receipts(spark, sf).createOrReplaceTempView(f"{database}_receipts")
    text = f"""SELECT common_key, COUNT(*) AS n_claims, COUNT(DISTINCT service_month) AS n_months
               FROM {database}_receipts GROUP BY common_key"""
    return tables.create_table_as(spark, f"{database}.claims_per_person", text)


@query(
    "declare_schema",
    with_("patients")
    + """SELECT c.position, c.column_name, c.data_type, c.comment,
           CASE c.position WHEN 6 THEN 0 ELSE (SELECT COUNT(*) FROM patients) END AS n_values
         FROM (VALUES (1, 'patient_id', 'bigint', 'running number'),
           (2, 'common_key', 'string', 'pseudonymous person key'),
           (3, 'age', 'int', 'years at the reference date'), (4, 'age_group', 'string', 'age band'),
           (5, 'sex', 'string', '1 male, 2 female'), (6, 'birth_date', 'string', 'yyyy-MM-dd'),
           (7, 'is_ra_candidate', 'boolean', 'candidate mark')) c(position, column_name, data_type, comment)""",
)
def _(spark, sf):
    raw = star.patients(spark, sf).select(
        "*", F.col("common_key").alias("patient_id"), F.lit(None).alias("birth_date"), (F.col("age") > 60).alias("is_ra_candidate")
    )
    typed = conform(raw, BRONZE["patients"])
    return tables.describe_table(typed).drop("nullable").join(_non_null(typed), "column_name")


@query(
    "named_stage",
    with_("receipts", "patients")
    + """SELECT p.age_group, COUNT(*) AS n_claims FROM receipts r JOIN patients p USING (common_key) GROUP BY p.age_group""",
)
def _(spark, sf):
    # Names of their own: views of another folder in the same session stay as they are.
    own = uuid.uuid4().hex
    receipts, patients = f"stage_receipts_{own}", f"stage_patients_{own}"
    tables.named_stage(star.receipts(spark, sf), receipts)
    tables.named_stage(star.patients(spark, sf), patients)
    return spark.sql(
        f"""SELECT p.age_group, COUNT(*) AS n_claims FROM {receipts} r
            JOIN {patients} p ON r.common_key = p.common_key GROUP BY p.age_group"""
    )


@query(
    "namespaces",
    """SELECT 'bronze' AS layer, (SELECT COUNT(*) FROM orders) AS n
       UNION ALL SELECT 'silver', (SELECT COUNT(DISTINCT o_custkey) FROM orders)
       UNION ALL SELECT 'gold', (SELECT COUNT(DISTINCT o_orderstatus) FROM orders)""",
)
def _(spark, sf):
    root = scratch_path(spark, "layers")
    prefix = root.rsplit("-", 1)[1][:12] + "_"
    prefix = "l" + prefix
    tables.namespaces(spark, root, prefix=prefix)
    orders = star.read(spark, sf, "orders")
    tables.write_overwrite(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), f"{prefix}bronze.claims")
    bronze = tables.scan_table(spark, f"{prefix}bronze.claims")
    tables.write_overwrite(bronze.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), f"{prefix}silver.persons")
    tables.write_overwrite(bronze.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), f"{prefix}gold.status")
    stored = {"bronze": "claims", "silver": "persons", "gold": "status"}
    return tables.row_counts(
        {layer: tables.scan_table(spark, f"{prefix}{layer}.{name}") for layer, name in stored.items()}
    ).withColumnRenamed("table_name", "layer")


@query(
    "describe_table",
    """SELECT 1 AS position, 'o_orderkey' AS column_name, 'bigint' AS data_type, COUNT(o_orderkey) AS n_values FROM orders
       UNION ALL SELECT 2, 'o_custkey', 'bigint', COUNT(o_custkey) FROM orders
       UNION ALL SELECT 3, 'o_orderstatus', 'string', COUNT(o_orderstatus) FROM orders
       UNION ALL SELECT 4, 'o_totalprice', 'double', COUNT(o_totalprice) FROM orders
       UNION ALL SELECT 5, 'o_orderdate', 'timestamp_ntz', COUNT(o_orderdate) FROM orders
       UNION ALL SELECT 6, 'o_orderpriority', 'string', COUNT(o_orderpriority) FROM orders""",
)
def _(spark, sf):
    orders = star.read(spark, sf, "orders")
    described = tables.describe_table(orders).select("position", "column_name", "data_type")
    return described.join(_non_null(orders), "column_name")


@query(
    "localize_columns",
    with_("receipts")
    + """SELECT receipt_id AS "検索番号", common_key AS "共通キー", service_month AS "診療年月" FROM receipts""",
)
def _(spark, sf):
    return tables.localize_columns(star.receipts(spark, sf), codes.JAPANESE_COLUMNS)


@query("small_collect", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    counted = star.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    # One row per priority reaches the driver, and goes back as literals.
    small = tables.small_collect(counted)
    rows = [F.struct(F.lit(p).alias("o_orderpriority"), F.lit(int(n)).cast("long").alias("n")) for p, n in small.itertuples(index=False)]
    none = F.expr("cast(array() as array<struct<o_orderpriority:string,n:bigint>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


@query(
    "snapshot_as_of",
    """SELECT DATE '1997-12-31' AS snapshot_date, o_orderstatus, COUNT(*) AS n FROM orders
       WHERE o_orderdate <= DATE '1997-12-31' GROUP BY o_orderstatus""",
)
def _(spark, sf):
    path = scratch_path(spark, "snapshots")
    orders = star.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    for day in ("1996-12-31", "1997-12-31", "1998-12-31"):
        tables.append_snapshot(orders.filter(F.col("o_orderdate") <= F.lit(day).cast("date")), path, day)
    return (
        tables.snapshot_as_of(spark, path, "1998-06-30")
        .groupBy("snapshot_date", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in ALL_TABLES),
)
def _(spark, sf):
    return tables.row_counts({t: star.read(spark, sf, t) for t in ALL_TABLES})


# Three states of the orders: those before 1998; those of one more month, some with a raised price; the same without some of them.
_STATES = {
    "2024-03-01": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'",
    "2024-03-02": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
        FROM orders WHERE o_orderdate < TIMESTAMP '1998-02-01'""",
    "2024-03-05": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
        FROM orders WHERE o_orderdate < TIMESTAMP '1998-02-01' AND o_orderkey % 97 <> 5""",
}


def _change_store(spark, sf):
    path = scratch_path(spark, "changes")
    star.read(spark, sf, "orders").createOrReplaceTempView("orders_of_states")
    for day, text in _STATES.items():
        history.store_changes(spark.sql(text.replace("FROM orders", "FROM orders_of_states")), path, day, ["o_orderkey"])
    return path


@query("change_set_as_of", _STATES["2024-03-02"])
def _(spark, sf):
    """The state of a day between two stored ones, from change sets."""
    return history.state_as_of(spark, _change_store(spark, sf), "2024-03-04")


@query(
    "change_set_sizes",
    f"""WITH a AS ({_STATES['2024-03-01']}), b AS ({_STATES['2024-03-02']}), c AS ({_STATES['2024-03-05']})
        SELECT DATE '2024-03-01' AS change_date, 'inserted' AS kind, COUNT(*) AS n FROM a
        UNION ALL SELECT DATE '2024-03-02', 'inserted', COUNT(*) FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
        UNION ALL SELECT DATE '2024-03-02', 'changed', COUNT(*) FROM a JOIN b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice
        UNION ALL SELECT DATE '2024-03-05', 'removed', COUNT(*) FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)""",
)
def _(spark, sf):
    return history.change_counts(spark, _change_store(spark, sf))
