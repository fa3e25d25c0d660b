"""Repeatable sampling and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import hashing
from strataspark.operators import joins as jo
from strataspark.operators import sampling as sa
from strataspark.sources import star
from strataspark.suite.registry import query
from strataspark.suite.sql import masked, uniform, with_

SHELF_WEIGHTS = {"front": 5, "middle": 3, "back": 2}


@query("keyed_uniform", f"SELECT o_orderkey, {uniform('o_orderkey', 'salt1')} AS u FROM orders")
def _(spark, sf):
    return star.read(spark, sf, "orders").select(
        "o_orderkey", hashing.keyed_uniform(F.col("o_orderkey"), "salt1").alias("u")
    )


@query(
    "weighted_bucket",
    f"""SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'front' WHEN u < 0.8 THEN 'middle' ELSE 'back' END AS shelf
        FROM (SELECT o_orderkey, {uniform('o_orderkey', 'shelf')} AS u FROM orders) x""",
)
def _(spark, sf):
    draw = hashing.keyed_uniform(F.col("o_orderkey"), "shelf")
    return star.read(spark, sf, "orders").select(
        "o_orderkey", hashing.weighted_bucket(draw, SHELF_WEIGHTS).alias("shelf")
    )


@query(
    "hash_sample",
    f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        WHERE {uniform("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)", 'drug')}
          < CASE WHEN l_quantity >= 40 THEN 0.06 WHEN l_quantity >= 25 THEN 0.08 ELSE 0.1 END""",
)
def _(spark, sf):
    quantity = F.col("l_quantity")
    rate = F.when(quantity >= 40, F.lit(0.06)).when(quantity >= 25, F.lit(0.08)).otherwise(F.lit(0.1))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = star.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sa.hash_sample(lines, key, "drug", rate)


@query(
    "stratified_sample",
    f"""SELECT o_orderpriority, o_orderkey, pick FROM (SELECT o_orderpriority, o_orderkey,
          CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY {uniform('o_orderkey', 'strata')}, o_orderkey) AS INTEGER) AS pick
        FROM orders) x WHERE pick <= 25""",
)
def _(spark, sf):
    orders = star.read(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return sa.pick_n_per_key(orders, "o_orderpriority", "o_orderkey", "strata", 25)


@query(
    "entity_month_panel",
    with_("receipts")
    + """, m AS (SELECT strftime(d, '%Y%m') AS service_month FROM
           (SELECT unnest(generate_series(DATE '1996-04-01', DATE '1997-03-01', INTERVAL 1 MONTH)) AS d) t)
       SELECT c_custkey AS common_key, m.service_month, COUNT(r.receipt_id) AS n_claims FROM customer CROSS JOIN m
       LEFT JOIN receipts r ON r.common_key = c_custkey AND r.service_month = m.service_month GROUP BY 1, 2""",
)
def _(spark, sf):
    persons = star.patients(spark, sf).select("common_key")
    return jo.activity_panel(
        persons, star.receipts(spark, sf), "common_key", "199604", "199703", measure="n_claims"
    )


@query("mask_at_rate", f"SELECT c_custkey, {masked('c_acctbal', 'c_custkey', 'missing1', 0.08)} AS balance FROM customer")
def _(spark, sf):
    key = F.col("c_custkey")
    return star.read(spark, sf, "customer").select(
        "c_custkey", hashing.mask_at_rate(F.col("c_acctbal"), key, "missing1", 0.08).alias("balance")
    )


@query(
    "assign_by_rule",
    with_("patients")
    + f"""SELECT common_key, age, CASE WHEN age >= 50 THEN 'reviewed'
            WHEN {uniform('common_key', 'arm')} < 0.25 THEN 'treated' ELSE 'control' END AS arm FROM patients""",
)
def _(spark, sf):
    arm = hashing.assign_by_rule(
        F.col("age") >= 50, "reviewed", F.col("common_key"), "arm", {"treated": 0.25, "control": 0.75}
    )
    return star.patients(spark, sf).select("common_key", "age", arm.alias("arm"))
