"""Screening of extracted fields by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.heuristics import screened
from attesta.plans import query

_FIELDS = ["o_orderkey AS doc", "CASE o_orderkey % 4 WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'VISA' WHEN 2 THEN 'PERMIT' END AS kind", "CASE o_custkey % 5 WHEN 0 THEN 'My_Passport.png' WHEN 1 THEN 'visa.pdf' ELSE 'scan.png' END AS filename", "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS expiry", "CASE WHEN o_custkey % 9 = 0 THEN '2099-01-01' WHEN o_custkey % 9 = 1 THEN 'unknown' ELSE '1980-05-06' END AS birth", "CASE WHEN o_custkey % 3 <> 0 THEN o_clerk END AS number"]


@query("f45_screening", f"""WITH f AS (SELECT {', '.join(_FIELDS).replace('o_clerk', "'N' || o_custkey")}, FROM orders),
    k AS (SELECT *, coalesce(kind, '') = 'PASSPORT' OR contains(lower(filename), 'passport') AS p, coalesce(kind, '') = 'VISA' OR contains(lower(filename), 'visa') AS v, coalesce(CAST(expiry AS DATE) < DATE '1997-01-01', false) AS old, birth = '2099-01-01' AS unborn FROM f)
    SELECT doc, array_to_string(list_filter([CASE WHEN old THEN 'The document expired on ' || expiry || ', rendering it invalid for active border authorization.' END, CASE WHEN expiry IS NOT NULL AND NOT old THEN 'Document is active and valid until ' || expiry || '.' END,
        CASE WHEN unborn THEN 'Date of birth is registered in the future, indicating fraudulent data fabrication or severe OCR corruption.' END,
        CASE WHEN p AND number IS NULL THEN 'The document does not contain a discernible alphanumeric passport number.' WHEN p THEN 'Extracted passport identifier ' || number || ' formatted correctly.'
            WHEN v AND number IS NULL THEN 'No unique visa control or registration number was detected.' WHEN v THEN 'Visa credential control number ' || number || ' captured.' ELSE 'Document content parsed, normalized, and vaulted for screening telemetry.' END], lambda x: x IS NOT NULL), ' ') AS findings,
    CASE WHEN old OR unborn OR (p AND number IS NULL) THEN array_to_string(list_filter([CASE WHEN old THEN 'EXPIRED_DOCUMENT' END, CASE WHEN unborn THEN 'FUTURE_DOB_FRAUD_RISK' END, CASE WHEN p AND number IS NULL THEN 'MISSING_PASSPORT_NUMBER' END], lambda x: x IS NOT NULL), ',') ELSE 'VERIFIED_CREDENTIAL_STRUCTURE' END AS indicators,
    CAST(CASE WHEN old OR unborn THEN 0.98 WHEN (p OR v) AND number IS NULL THEN 0.94 ELSE 0.96 END AS DOUBLE) AS confidence, coalesce(kind, 'OTHER') AS document_type FROM k""".replace(", FROM orders", " FROM orders"))
def screening(t):
    """Every document's fields against the rules, on the first day of 1997."""
    rows = t("orders").selectExpr(*[f.replace("o_clerk", "'N' || o_custkey") for f in _FIELDS])
    fields = F.create_map(F.lit("dateOfExpiry"), F.col("expiry"), F.lit("dateOfBirth"), F.col("birth"), F.lit("passportNumber"), F.col("number"), F.lit("visaNumber"), F.col("number"))
    found = rows.select("doc", screened(F.col("kind"), F.col("filename"), fields, F.lit(None).cast("array<string>"), F.lit("1997-01-01").cast("date")).alias("s"))
    text = lambda name, part, sep: F.array_join(F.transform(f"s.{name}", lambda f: f[part]), sep)
    return found.select("doc", text("findings", "description", " ").alias("findings"), text("indicators", "indicator", ",").alias("indicators"), "s.confidence", "s.document_type")
