"""SQL fragments shared by the expected-result queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from strataspark.sources.codes import AGE_EDGES, AGE_LABELS
from strataspark.sources.star import CHRONIC_AGE_EDGES, CHRONIC_AGE_LABELS, DIAGNOSIS_BRANDS, TYPE_GROUPS


def quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


def uniform(key: str, salt: str) -> str:
    return (
        f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{salt}'), 1, 8)) AS BIGINT)"
        " / CAST(4294967296 AS DOUBLE))"
    )


def masked(value: str, key: str, salt: str, rate: float) -> str:
    return f"CASE WHEN {uniform(key, salt)} >= {rate} THEN {value} END"


def band(value: str, edges: Sequence[float], labels: Sequence[str], left_closed: bool = True) -> str:
    low, high = (">=", "<") if left_closed else (">", "<=")
    arms = " ".join(
        f"WHEN {value} {low} {a} AND {value} {high} {b} THEN '{label}'"
        for a, b, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {arms} END"


def ordinal(column: str, labels: Sequence[str]) -> str:
    arms = " ".join(f"WHEN '{label}' THEN {i}" for i, label in enumerate([*labels, "Total"], start=1))
    return f"CAST(CASE {column} {arms} ELSE {len(labels) + 2} END AS INTEGER)"


def flags(groups: Mapping[str, Sequence[str]], column: str = "code") -> str:
    return ", ".join(
        f"MAX(CASE WHEN {column} IN ({quoted(codes)}) THEN 1 ELSE 0 END) AS {name}" for name, codes in groups.items()
    )


def erfc_tail(chi2: str) -> str:
    z = f"sqrt({chi2} / 2)"
    t = f"(1.0 / (1.0 + {z} * 0.5))"
    poly = (
        f"-1.26551223 + {t} * (1.00002368 + {t} * (0.37409196 + {t} * (0.09678418 + {t} * (-0.18628806 + {t} * ("
        f"0.27886807 + {t} * (-1.13520398 + {t} * (1.48851587 + {t} * (-0.82215223 + {t} * 0.17087277))))))))"
    )
    return f"least(1.0, {t} * exp(-({chi2}) / 2 + {poly}))"


# name -> (text, names it needs)
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "patients": (
        f"""SELECT c_custkey AS common_key, CAST(16 + c_custkey % 80 AS INTEGER) AS age,
            {band("(16 + c_custkey % 80)", AGE_EDGES, AGE_LABELS)} AS age_group,
            CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END AS sex, c_nationkey AS nation FROM customer""",
        (),
    ),
    "receipts": (
        """SELECT o_orderkey AS receipt_id, o_custkey AS common_key, strftime(o_orderdate, '%Y%m') AS service_month
           FROM orders""",
        (),
    ),
    "disease": (
        """SELECT o_custkey AS common_key, l_orderkey AS receipt_id, p_brand AS code
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
        (),
    ),
    "medication": (
        """SELECT o_custkey AS common_key, l_orderkey AS receipt_id, p_type AS code,
                  strftime(o_orderdate, '%Y%m') AS service_month
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
        (),
    ),
    "procedures": (
        """SELECT o_custkey AS common_key, l_orderkey AS receipt_id, l_returnflag AS code
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        (),
    ),
    "def0": (f"SELECT DISTINCT common_key FROM disease WHERE code IN ({quoted(DIAGNOSIS_BRANDS)})", ("disease",)),
    "months": (
        """SELECT common_key, COUNT(DISTINCT service_month) AS prescription_months
           FROM medication WHERE code = 'ECONOMY' GROUP BY common_key""",
        ("medication",),
    ),
    "members": (
        "SELECT common_key, prescription_months FROM def0 JOIN months USING (common_key) WHERE prescription_months >= 2",
        ("def0", "months"),
    ),
    "drug_flags": (
        f"SELECT common_key, {flags(TYPE_GROUPS)} FROM medication GROUP BY common_key",
        ("medication",),
    ),
    "proc_flags": (
        f"""SELECT common_key, {flags({'TJR': ['A'], 'BMD': ['N'], 'VISIT': ['R']})} FROM procedures
            GROUP BY common_key""",
        ("procedures",),
    ),
    "master": (
        """SELECT p.common_key, p.age, p.age_group, p.sex, p.nation, m.prescription_months,
             COALESCE(MTX, 0) AS MTX, COALESCE(SSZ, 0) AS SSZ, COALESCE(TNFI, 0) AS TNFI, COALESCE(IL6I, 0) AS IL6I,
             COALESCE(ABT, 0) AS ABT, COALESCE(CS, 0) AS CS, COALESCE(LEF, 0) AS LEF,
             COALESCE(TJR, 0) AS TJR, COALESCE(BMD, 0) AS BMD, COALESCE(VISIT, 0) AS VISIT,
             CASE WHEN TNFI = 1 OR IL6I = 1 OR ABT = 1 THEN 1 ELSE 0 END AS bDMARDs,
             CASE WHEN MTX = 1 OR SSZ = 1 OR LEF = 1 OR TNFI = 1 OR IL6I = 1 OR ABT = 1 THEN 1 ELSE 0 END AS any_DMARD,
             CASE WHEN TJR = 1 THEN 1 ELSE 0 END AS any_RA_surgery
           FROM members m JOIN patients p USING (common_key)
           LEFT JOIN drug_flags d USING (common_key) LEFT JOIN proc_flags f USING (common_key)""",
        ("members", "patients", "drug_flags", "proc_flags"),
    ),
    "follow_up": (
        """SELECT o_custkey AS common_key, CAST(min(o_orderdate) AS DATE) AS first_date,
             CAST(COALESCE(min(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000
                               THEN year(o_orderdate) * 12 + month(o_orderdate) END),
                      max(year(o_orderdate) * 12 + month(o_orderdate)))
                  - min(year(o_orderdate) * 12 + month(o_orderdate)) AS INTEGER) AS months,
             MAX(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 1 ELSE 0 END) AS event
           FROM orders GROUP BY o_custkey""",
        (),
    ),
    "survival": (
        """SELECT common_key, months, event, CAST(common_key % 2 AS INTEGER) AS grp,
             CASE WHEN 16 + common_key % 80 < 70 THEN 'under 70' ELSE '70 and over' END AS stratum FROM follow_up""",
        ("follow_up",),
    ),
    "chronic": (
        f"""SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
             CAST(2020 - 16 - c_custkey % 80 AS INTEGER) AS birth_year, CAST(16 + c_custkey % 80 AS INTEGER) AS age,
             {band("(16 + c_custkey % 80)", CHRONIC_AGE_EDGES, CHRONIC_AGE_LABELS)} AS age_group,
             {masked("lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')", "c_custkey", "prefecture", 0.02)} AS prefecture_code,
             c_acctbal > 4500 AS has_hypertension, c_custkey % 3 = 0 AS has_dyslipidemia,
             c_mktsegment = 'MACHINERY' AS has_ckd,
             CASE WHEN c_acctbal > 4500 AND c_custkey % 3 = 0 AND c_mktsegment = 'MACHINERY' THEN 'HT+DL+CKD'
                  WHEN c_acctbal > 4500 AND c_mktsegment = 'MACHINERY' THEN 'HT+CKD'
                  WHEN c_custkey % 3 = 0 AND c_mktsegment = 'MACHINERY' THEN 'DL+CKD'
                  WHEN c_acctbal > 4500 AND c_custkey % 3 = 0 THEN 'HT+DL'
                  WHEN c_mktsegment = 'MACHINERY' THEN 'CKD only'
                  WHEN c_acctbal > 4500 THEN 'HT only'
                  WHEN c_custkey % 3 = 0 THEN 'DL only' ELSE 'none' END AS comorbidity_pattern,
             {masked("round((c_acctbal + 1000) / 3000 + 6, 1)", "c_custkey", "hba1c", 0.08)} AS hba1c,
             {masked("(CAST(16 AS DOUBLE) + (c_custkey * 7 % 200) / CAST(10 AS DOUBLE))", "c_custkey", "bmi", 0.05)} AS bmi,
             first_date AS diabetes_diagnosis_date, months AS follow_up_months, event = 1 AS cv_event_occurred
           FROM customer JOIN follow_up ON common_key = c_custkey""",
        ("follow_up",),
    ),
    "analysis": (
        """SELECT * FROM chronic WHERE age >= 40 AND diabetes_diagnosis_date <= DATE '1995-12-31' AND prefecture_code IS NOT NULL""",
        ("chronic",),
    ),
    "base": (
        """SELECT *, CASE prefecture_code WHEN '01' THEN 'Hokkaido' WHEN '11' THEN 'Saitama' WHEN '12' THEN 'Chiba'
             WHEN '13' THEN 'Tokyo' WHEN '14' THEN 'Kanagawa' WHEN '22' THEN 'Shizuoka' WHEN '23' THEN 'Aichi'
             WHEN '27' THEN 'Osaka' WHEN '28' THEN 'Hyogo' WHEN '40' THEN 'Fukuoka' ELSE 'Other' END AS prefecture_name,
             CAST(year(diabetes_diagnosis_date) AS INTEGER) AS diagnosis_year
           FROM chronic WHERE prefecture_code IS NOT NULL""",
        ("chronic",),
    ),
    "visits": (
        f"""SELECT o_orderkey AS visit_id,
             {masked("CAST(o_orderdate AS DATE)", "o_orderkey", "visit", 0.02)} AS visit_date,
             {masked("CAST(DATE '1995-01-01' - CAST((16 + o_custkey % 80) * 365 AS INTEGER) AS DATE)", "o_orderkey", "birth", 0.02)} AS birth_date,
             {masked("round(o_totalprice / 10000 + 40, 1)", "o_orderkey", "weight", 0.03)} AS weight,
             CAST(140 + o_orderkey % 50 AS DOUBLE) AS height
           FROM orders""",
        (),
    ),
    "aged_visits": (
        """SELECT *, CAST(floor((visit_date - birth_date) / 365.25) AS INTEGER) AS age FROM visits
           WHERE visit_date IS NOT NULL AND birth_date IS NOT NULL""",
        ("visits",),
    ),
}


def with_(*names: str) -> str:
    """``WITH`` clause defining the named relations and whatever they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for needed in _CTES[name][1]:
                add(needed)
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTES[n][0]})" for n in done) + " "


def long_form(table: str, sql: str, key: str, numbers: Sequence[str], texts: Sequence[str] = ()) -> str:
    """Every value of a query's rows as a row (table_name, row_key, column_name, number, text)."""
    entries = [f"{{'c': '{c}', 'n': CAST({c} AS DOUBLE), 't': CAST(NULL AS VARCHAR)}}" for c in numbers]
    entries += [f"{{'c': '{c}', 'n': CAST(NULL AS DOUBLE), 't': CAST({c} AS VARCHAR)}}" for c in texts]
    return (
        f"SELECT '{table}' AS table_name, row_key, e.c AS column_name, e.n AS number, e.t AS text FROM "
        f"(SELECT CAST({key} AS VARCHAR) AS row_key, unnest([{', '.join(entries)}]) AS e FROM ({sql}) q) x"
    )
