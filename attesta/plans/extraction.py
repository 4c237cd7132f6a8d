"""Fields extracted from the texts and text regions of documents; the SQL reads them from the text too."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import zones
from attesta.plans import query

#: Texts of documents of several layouts. The same expression runs in both engines; what is in them is found by the queries alone.
_DAY = "lpad(CAST({0} % 28 + 1 AS STRING), 2, '0')"
_K8 = "lpad(CAST(c_custkey AS STRING), 8, '0')"
TEXTS = {
    "VISA": f"""CASE c_custkey % 5
        WHEN 0 THEN concat_ws(chr(10), 'EMBASSY OF SOMEWHERE', '  Visa No: v' || {_K8}, 'Type of Visa: tourist ', 'Number of Entries: mult', 'Stay: ' || CAST(c_custkey % 90 + 1 AS STRING) || ' days', 'Valid From: ' || {_DAY.format('c_custkey')} || '/02/2024', 'Valid Until ' || {_DAY.format('c_nationkey')} || ' AUG 2024', 'Name of Bearer: Jane Doe-Smith', 'Nationality: Indian', 'Sex: female', 'Passport No: e1234567', 'DOB: 850214')
        WHEN 1 THEN concat_ws(chr(10), 'VISA', 'Holder: Visa Department', 'Name: ' || CASE WHEN c_custkey % 2 = 0 THEN 'John Roe' ELSE 'passport office' END, 'SCHENGEN', 'V' || {_K8}, '02', CAST(c_custkey % 180 AS STRING) || ' DAYS', 'Issue Date: 1' || chr(9) || 'JAN 2024', 'until: 2024-12-' || {_DAY.format('c_custkey')}, 'Citizenship: type unknown', 'Citizenship: Brazil', 'gender: X')
        WHEN 2 THEN concat_ws(chr(10), 'Control Number: ' || {_K8} || '-B', 'category: B1/B2' || chr(13), 'Entries: 01 of 2', 'Duration of Stay: 6 months', '', '   ', 'from: 5.6.2024', 'Expiration: 05-06-2025 at noon', 'bearer: A. B. Clark', 'sexe: M', 'PP No: X12345678')
        WHEN 3 THEN 'no fields here' || chr(10) || 'class: ?'
        END""",
    "NATIONAL_ID": f"""CASE c_custkey % 6
        WHEN 0 THEN concat_ws(chr(10), 'UNION OF INDIA DRIVING LICENCE', 'GJ06 2023' || lpad(CAST(c_custkey AS STRING), 7, '0'), 'Name : PARTH PATHAK', 'Date Of Birth: ' || {_DAY.format('c_custkey')} || '-08-1996', 'Issue Date 04-02-2023', 'Validity ( NT ) 25-08-2046', 'LMV MCWG')
        WHEN 1 THEN concat_ws(chr(10), 'Name: HOLDER''S SIGNATURE', 'Name: Jo', 'Name - Asha Rao', CAST(c_custkey % 9000 + 1000 AS STRING) || ' 5678 9012', {_DAY.format('c_custkey')} || '/05/1990', 'then ' || {_DAY.format('c_nationkey')} || '/05/2030 and 01/01/2020')
        WHEN 2 THEN concat_ws(chr(10), 'DL No: MH-01-' || lpad(CAST(c_custkey AS STRING), 6, '0'), 'Naam: Ravi K.', '12.03.1988', '12-03-1988', 'valid upto 11/03/' || CAST(2030 + c_custkey % 9 AS STRING), 'COV: tr')
        WHEN 3 THEN concat_ws(chr(10), 'id number: ' || CAST(c_custkey AS STRING) || 'AB-' || CAST(c_nationkey AS STRING) || '77', 'Full Name: Mary Ann', 'one date only 01/02/1980')
        WHEN 4 THEN concat_ws(chr(10), 'MH' || lpad(CAST(c_custkey AS STRING), 13, '1'), 'DOB 1 JAN 1970', 'EXP: 31/12/2031', '07/07/2007', '08/08/2008', '09/09/2009')
        END""",
    "PERMIT": f"""CASE c_custkey % 5
        WHEN 0 THEN concat_ws(chr(10), 'GOVERNMENT OF ARUNACHAL PRADESH', 'eILP No 02' || {_K8} || '1611566', 'Temporary Single Inner Line Permit', 'Name: Anil Kumar', 'Check Gate: Banderdewa, East', 'Place of Visit: Ziro', 'Date of Visit: ' || {_DAY.format('c_custkey')} || '/03/2025', 'Date of Return: 20 MAR 2025', 'Issued By: DC Lower Subansiri.')
        WHEN 1 THEN concat_ws(chr(10), 'Work Permit No: wp_' || {_K8}, 'Permit Type: work authorization/A', 'Holder: Ministry of Interior', 'Full Name: Li Wei', 'Authority: Ministry of Interior', 'zone: 7-B', 'destination: New Town', 'issued: 2024-01-0' || CAST(c_custkey % 9 + 1 AS STRING), 'expires: 31.12.2024 (final)')
        WHEN 2 THEN concat_ws(chr(10), 'PERMIT-' || lpad(CAST(c_custkey AS STRING), 6, '0'), 'border  transit', 'the Name: Eve Stone, again', 'Birth Date: 3 MAR 1991', 'Valid From 010124', 'until 311224xx')
        WHEN 3 THEN concat_ws(chr(10), 'ref ' || lpad(CAST(c_custkey AS STRING), 14, '9'), 'class: 2', 'class: Goods carriage', 'Border Security Agency', 'port: ' || CASE WHEN c_custkey % 2 = 0 THEN 'ab' ELSE 'Kochi' END)
        END""",
}
PIVOT = 56

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def standard_date_sql(v: str) -> str:
    """``standard_date`` in DuckDB SQL."""
    c = f"upper({_TRIM.format(v)})"
    part = lambda pattern, i: f"regexp_extract({c}, '{pattern}', {i})"
    day, month = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", r"^(\d{1,2})[\s\-]([A-Z]{3})[\s\-](\d{4})$"
    at = f"list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], {part(month, 2)})"
    return rf"""CASE WHEN regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN {c} WHEN regexp_matches({c}, '{day}') THEN {part(day, 3)} || '-' || lpad({part(day, 2)}, 2, '0') || '-' || lpad({part(day, 1)}, 2, '0')
        WHEN {at} > 0 THEN {part(month, 3)} || '-' || lpad(CAST({at} AS VARCHAR), 2, '0') || '-' || lpad({part(month, 1)}, 2, '0')
        WHEN regexp_matches({c}, '^\d{{6}}$') THEN CASE WHEN CAST({c}[1:2] AS INT) > {PIVOT} THEN '19' ELSE '20' END || {c}[1:2] || '-' || {c}[3:4] || '-' || {c}[5:6] ELSE {v} END"""


def _cleaned_sql(field: zones.Shown, v: str) -> str:
    m = f"upper({v})"
    return {
        "_upper": m, "_trimmed": _TRIM.format(v), "_name": f"upper({_TRIM.format(v)})", "_number": rf"upper(regexp_replace({v}, '[\s\-]', '', 'g'))", "standard_date": standard_date_sql(v),
        "_entries": f"CASE WHEN contains({m}, 'MULT') OR {m} = 'M' THEN 'MULTIPLE' WHEN contains({m}, 'SING') OR {m} IN ('01', '1') THEN 'SINGLE' WHEN contains({m}, 'DOUB') OR {m} IN ('02', '2') THEN 'DOUBLE' ELSE {m} END",
        "_sex": f"CASE WHEN starts_with({m}, 'M') THEN 'M' WHEN starts_with({m}, 'F') THEN 'F' ELSE {m} END",
    }[field.clean.__name__]


def _zone_sql(kind: str) -> str:
    """Lines in rows, the least line number for each field."""
    fields = zones.ZONES[kind]
    values = ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(line, {_quoted(p)}, 1), '')" for p in f.patterns) + f") AS {n}" for n, f in fields.items())
    drop = lambda n, f: f" AND NOT regexp_matches({n}, {_quoted(f.drop)})" if f.drop else ""
    first = ", ".join(f"arg_min({n}, i) FILTER ({n} IS NOT NULL{drop(n, f)}) AS {n}" for n, f in fields.items())
    cleaned = ", ".join(f"{_cleaned_sql(f, n)} AS {n}, CASE WHEN {n} IS NULL THEN 0.0 ELSE {f.confidence} END::DOUBLE AS {n}_c" for n, f in fields.items())
    base = f"""t AS (SELECT c_custkey AS k, {TEXTS[kind]} AS text FROM customer), p AS (SELECT k, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v: {_TRIM.format('v')}), lambda v: v <> '') AS l FROM t),
        m AS (SELECT k, i, {values} FROM (SELECT k, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p)), f AS (SELECT k, {first} FROM m GROUP BY k), c AS (SELECT k, {cleaned} FROM p LEFT JOIN f USING (k))"""
    if kind == "NATIONAL_ID":
        base += rf""", d AS (SELECT k, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\b(\d{{2}}[/\-.]\d{{2}}[/\-.]\d{{4}})\b', 1), lambda v: {standard_date_sql('v')}))) AS d FROM t),
            g AS (SELECT * EXCLUDE d REPLACE (CASE WHEN date_of_birth IS NULL AND len(d) >= 2 THEN d[1] ELSE date_of_birth END AS date_of_birth, CASE WHEN date_of_issue IS NULL AND len(d) >= 3 THEN d[2] ELSE date_of_issue END AS date_of_issue,
                CASE WHEN date_of_expiry IS NULL AND len(d) >= 2 THEN d[least(3, len(d))] ELSE date_of_expiry END AS date_of_expiry, CASE WHEN date_of_birth IS NULL AND len(d) >= 2 THEN 0.90 ELSE date_of_birth_c END AS date_of_birth_c,
                CASE WHEN date_of_issue IS NULL AND len(d) >= 3 THEN 0.90 ELSE date_of_issue_c END AS date_of_issue_c, CASE WHEN date_of_expiry IS NULL AND len(d) >= 2 THEN 0.90 ELSE date_of_expiry_c END AS date_of_expiry_c) FROM c JOIN d USING (k))"""
    twins = "".join(f", {n} AS {t}, {n}_c AS {t}_c" for t, n in zones.TWINS[kind].items()) + "".join(f", NULL::VARCHAR AS {n}, 0.0::DOUBLE AS {n}_c" for n in zones.UNSHOWN[kind])
    return f"WITH {base} SELECT *{twins} FROM {'g' if kind == 'NATIONAL_ID' else 'c'}"


def _zone(name: str, kind: str):
    @query(name, _zone_sql(kind))
    def extracted(t):
        """The zone's fields and their confidences, found in texts of several layouts."""
        found = zones.zone(t("customer").select(F.col("c_custkey").alias("k"), F.expr(TEXTS[kind]).alias("text")), "text", kind, PIVOT).drop("text")
        return found.select("k", *[x for n in found.columns[1:] for x in (F.col(n)["value"].alias(n), F.col(n)["confidence"].alias(f"{n}_c"))])


for _name, _kind in (("f24_visa_zone", "VISA"), ("f25_national_id_zone", "NATIONAL_ID"), ("f26_permit_zone", "PERMIT")):
    _zone(_name, _kind)
