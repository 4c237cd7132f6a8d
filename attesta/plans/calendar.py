"""Dates as people write them, read against the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import dates
from attesta.plans import query

AS_OF = "2026-06-30"
#: A date of every order in one of many spellings, some of them no date. The same expression runs in both engines.
SPELLINGS = """CASE o_orderkey % 16
    WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) || CASE WHEN o_custkey % 2 = 0 THEN 'T00:00' ELSE '' END
    WHEN 1 THEN ' ' || CAST(o_custkey % 33 AS STRING) || '/' || CAST(o_orderkey % 14 AS STRING) || '/' || CAST(1950 + o_custkey % 90 AS STRING) || ' '
    WHEN 2 THEN '31-0' || CAST(o_custkey % 9 + 1 AS STRING) || '-2020'
    WHEN 3 THEN CAST(o_custkey % 31 + 1 AS STRING) || ' nov ' || CAST(1990 + o_custkey % 50 AS STRING)
    WHEN 4 THEN CAST(o_custkey % 31 + 1 AS STRING) || 'th of February, ' || CAST(1996 + o_custkey % 9 AS STRING)
    WHEN 5 THEN 'Sept ' || CAST(o_custkey % 33 AS STRING) || ', 2003'
    WHEN 6 THEN lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '0228'
    WHEN 7 THEN lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '0229'
    WHEN 8 THEN '14.11.' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0')
    WHEN 9 THEN CAST(1970 + o_custkey % 70 AS STRING) || '/' || CAST(o_custkey % 16 AS STRING) || '/' || CAST(o_orderkey % 15 + 1 AS STRING)
    WHEN 10 THEN CAST(1970 + o_custkey % 70 AS STRING) || lpad(CAST(o_custkey % 13 AS STRING), 2, '0') || '28'
    WHEN 11 THEN '05/' || CAST(o_custkey % 40 AS STRING) || '/2001'
    WHEN 12 THEN 'unknown ' || CAST(o_custkey AS STRING)
    WHEN 13 THEN '3-MAY-' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0')
    WHEN 14 THEN ''
    END"""


def parsed_sql(text: str, as_of: str, expiry: bool) -> str:
    """``parse_date`` in DuckDB SQL over a column name."""
    c = f"upper(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'))"
    now = as_of[:4]
    names = ", ".join(f"'{m}'" for m in dates.MONTHS)

    def year(p: str, i: int, last: int) -> str:
        part = f"regexp_extract({c}, '{p}', {i})"
        return f"CASE WHEN length({part}) = 2 THEN CAST(floor(({last} - TRY_CAST({part} AS INT)) / 100) * 100 + TRY_CAST({part} AS INT) AS INT)::VARCHAR ELSE {part} END"

    def day(form) -> str:
        p, y, m, d = form
        month = f"coalesce(CAST(list_position([{names}], substr(regexp_extract({c}, '{p}', {m}), 1, 3)) AS VARCHAR), regexp_extract({c}, '{p}', {m}))"
        return f"CASE WHEN regexp_matches({c}, '{p}') THEN TRY_CAST(({year(p, y, int(now) + 49)}) || '-' || lpad({month}, 2, '0') || '-' || lpad(regexp_extract({c}, '{p}', {d}), 2, '0') AS DATE) END"

    six = r"^(\d{2})(\d{2})(\d{2})$"
    coded = f"TRY_CAST(({year(six, 1, int(now) + (30 if expiry else 0))}) || '-' || regexp_extract({c}, '{six}', 2) || '-' || regexp_extract({c}, '{six}', 3) AS DATE)"
    return f"CASE WHEN regexp_matches({c}, '{six}') THEN {coded} ELSE coalesce({', '.join(day(f) for f in dates.FORMS)}) END"


@query("f9_parsed_dates", f"WITH t AS (SELECT o_orderkey AS k, {SPELLINGS} AS text FROM orders) SELECT k, text, CAST({parsed_sql('text', AS_OF, False)} AS VARCHAR) AS birth, CAST({parsed_sql('text', AS_OF, True)} AS VARCHAR) AS expiry FROM t")
def parsed_dates(t):
    """What a spelling means as a birth and as an expiry; null where it is no day in the calendar."""
    now = F.lit(AS_OF).cast("date")
    rows = t("orders").select(F.col("o_orderkey").alias("k"), F.expr(SPELLINGS).alias("text"))
    return rows.select("k", "text", dates.parse_date(F.col("text"), now).cast("string").alias("birth"), dates.parse_date(F.col("text"), now, expiry=True).cast("string").alias("expiry"))
