"""The registered queries on the smallest tables, beside their SQL where there is one."""

from __future__ import annotations

import duckdb
import pytest
from check import TABLES, compare, rows_of

import __spark_entry__ as entry
from strataspark.llm import suite


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


COLUMNS = {
    "op1": ["doc_id", "size", "source_size", "target", "taken"],
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4": ["page_id", "host", "path", "rule", "verdict"],
    "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, sf, sql, name):
    df = suite.QUERIES[name](spark, sf)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    table = {"op4": "pages", "op6": "conversations"}.get(name.split("_")[0], "documents")
    if table == "conversations":
        want = sql.execute("SELECT count(DISTINCT conv_id) + 1 FROM conversations").fetchone()[0]
    else:
        want = sql.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert name == "op11_collocations" or len(got) == want
    if name in suite.ORACLE:
        cursor = sql.execute(suite.ORACLE[name])
        want_names, rows = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert names == want_names and compare(got, rows) in ("exact", "near")


def test_registered():
    assert suite.QUERIES.keys() <= entry.queries().keys() and "pipeline" in entry.queries()
    assert len(suite.QUERIES) == 13
