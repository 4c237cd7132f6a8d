"""All checks of a submitted document; the SQL derives every finding from the document's fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.checks import NATIONALITIES, STATES
from attesta.operators import screening as S
from attesta.plans import query
from attesta.plans.extraction import standard_date_sql
from attesta.plans.fields import _PASSPORT_LINES, _VISA_LINES
from attesta.plans.records import _verhoeff_sql

AS_OF, PIVOT = "2026-06-30", 56
_K = "c_custkey"
_TYPE = f"CASE {_K} % 7 WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'NATIONAL_ID' WHEN 2 THEN 'driving_license' WHEN 3 THEN 'VISA' WHEN 4 THEN 'PERMIT' WHEN 5 THEN 'AADHAAR' END"
_DAY = lambda shift: f"CASE ({_K} + {shift}) % 6 WHEN 0 THEN CAST({_K} % 28 + 1 AS STRING) || '/0' || CAST({_K} % 9 + 1 AS STRING) || '/' || CAST(1960 + ({_K} * 7 + {shift}) % 90 AS STRING) WHEN 1 THEN '31/02/2020' WHEN 2 THEN lpad(CAST({_K} % 100 AS STRING), 2, '0') || '0815' WHEN 3 THEN '2026-1' || CAST({_K} % 3 AS STRING) || '-09' WHEN 4 THEN 'soon' END"
#: Fields of every document under one of their spellings, as an expression over a customer that runs in both engines; null where a field isn't there.
FIELDS = {
    "classifiedType": f"CASE {_K} % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'unknown' WHEN 2 THEN 'DRIVING_LICENSE' END",
    "name": f"CASE {_K} % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Anna Eriksson' WHEN 2 THEN 'null' END", "fullName": f"CASE {_K} % 3 WHEN 0 THEN 'Roe, Jane' END", "visual_name": f"CASE {_K} % 5 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'Smith' WHEN 2 THEN '***' END",
    "passport_number": f"CASE {_K} % 3 WHEN 0 THEN ' l 898902<c' WHEN 1 THEN 'X' || CAST({_K} AS STRING) END", "visualPassportNumber": f"CASE {_K} % 4 WHEN 0 THEN 'L898902C' WHEN 1 THEN 'Y1' END", "visa_number": f"CASE {_K} % 4 WHEN 0 THEN 'V1' END",
    "nationality": f"CASE {_K} % 4 WHEN 0 THEN 'IND' WHEN 1 THEN 'united states' WHEN 2 THEN 'Utopia' END", "visual_nationality": f"CASE {_K} % 6 WHEN 0 THEN 'Indian' WHEN 1 THEN 'Given names' WHEN 2 THEN 'U' WHEN 3 THEN 'USA' WHEN 4 THEN 'u t o p i a' END",
    "gender": f"CASE {_K} % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'Male' END", "visualGender": f"CASE {_K} % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'x' END",
    "date_of_birth": _DAY(0), "visualDateOfBirth": _DAY(2), "dateOfExpiry": _DAY(3), "visual_date_of_expiry": _DAY(1), "valid_until": f"CASE {_K} % 2 WHEN 0 THEN '2026-10-01' END",
    "idNumber": f"CASE {_K} % 6 WHEN 0 THEN '2341 2341 2346' WHEN 1 THEN '1234 5678 9012' WHEN 2 THEN CAST(300000000000 + {_K} AS STRING) WHEN 3 THEN 'XXXX xxxx 1234' WHEN 4 THEN 'ID' || CAST({_K} AS STRING) END",
    "license_number": f"CASE {_K} % 5 WHEN 0 THEN 'mh-01 20030034761' WHEN 1 THEN 'ZZ0120030034761' WHEN 2 THEN 'MH01' WHEN 3 THEN 'OR0120030034761' END", "eILPNo": f"CASE {_K} % 3 WHEN 0 THEN '123' END",
    "mrz_lines": f"CASE {_K} % 8 WHEN 0 THEN '{_PASSPORT_LINES[0]}' || chr(10) || '{_PASSPORT_LINES[1]}' WHEN 1 THEN '{_VISA_LINES[1]}' || chr(10) || ' {_VISA_LINES[0]}' WHEN 2 THEN '{_PASSPORT_LINES[0]}' || chr(10) || replace('{_PASSPORT_LINES[1]}', '7', '6') WHEN 3 THEN 'P<UTO' || chr(10) || chr(10) || 'L898902C3' WHEN 4 THEN '{_PASSPORT_LINES[0]}' WHEN 5 THEN '{_VISA_LINES[0]}' || chr(10) || lower('{_VISA_LINES[1]}') WHEN 6 THEN 'V<' || chr(10) || '000000000<XXX4009078F9612109' END",
}
_ZONE_VALID = f"CASE {_K} % 16 WHEN 0 THEN false WHEN 1 THEN true END"
_HIT = {"risk_level": f"CASE {_K} % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END", "reason": "'STOLEN_PASSPORT'", "document_number": f"CAST({_K} AS STRING)", "full_name": f"CASE {_K} % 2 WHEN 0 THEN 'Jane Roe' END"}
_LISTED = f"{_K} % 11 = 0"
_OUTSIDE_VALID, _CHECK_FIELD, _CHECK_STATUS = f"{_K} % 3 <> 0", f"CASE {_K} % 4 WHEN 0 THEN 'passport_number' WHEN 1 THEN 'gender' WHEN 2 THEN 'name' ELSE 'pin_code' END", f"CASE {_K} % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'missing' WHEN 2 THEN 'inconsistent' ELSE 'valid' END"
_READ, _ERRORS = f"{_K} % 2 = 0", f"CASE WHEN {_K} % 6 = 0 THEN {{0}} END"


def _documents(t):
    fields = F.map_filter(F.expr("map(" + ", ".join(f"'{n}', {e}" for n, e in FIELDS.items()) + ")"), lambda _, v: v.isNotNull())
    hit = F.expr(f"CASE WHEN {_LISTED} THEN named_struct({', '.join(f'''{chr(39)}{n}{chr(39)}, {e}''' for n, e in _HIT.items())}) END")
    outside = F.expr(f"CASE WHEN {_READ} THEN named_struct('valid', {_OUTSIDE_VALID}, 'checks', array(named_struct('field', {_CHECK_FIELD}, 'status', {_CHECK_STATUS}, 'message', CAST(NULL AS STRING), 'confidence', 0.5D)), 'errors', {_ERRORS.format('''array('bad layout', 'no seal')''')}) END")
    return t("customer").select(F.col(_K).alias("k"), F.expr(_TYPE).alias("document_type"), fields.alias("fields"), F.expr(_ZONE_VALID).alias("zone_valid"), hit.alias("hit"), outside.alias("outside"))


def _sql() -> str:
    q = lambda text: "'" + text.replace("'", "''") + "'"
    trim = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    first = lambda names: "coalesce(" + ", ".join(f"nullif(nullif({trim(n)}, ''), 'null')" for n in names if n in FIELDS) + ")"
    looked = ", ".join(f"{first(names) if any(n in FIELDS for n in names) else 'NULL::VARCHAR'} AS f_{n}" for n, names in S.NAMES.items())
    dates = ", ".join(f"{standard_date_sql(f'f_{n}')} AS d_{n}" for n in ("expiry", "birth", "zone_birth", "shown_birth", "zone_expiry", "shown_expiry"))
    worth = "CASE WHEN substr(uz, j, 1) BETWEEN '0' AND '9' THEN ascii(substr(uz, j, 1)) - 48 WHEN substr(uz, j, 1) BETWEEN 'A' AND 'Z' THEN ascii(substr(uz, j, 1)) - 55 ELSE 0 END"
    total = lambda start, size: f"list_sum(list_transform(range({start}, {start + size}), lambda j: ({worth}) * [7, 3, 1][(j - {start}) % 3 + 1])) % 10"
    same = lambda at, start, size: f"substr(z, {at}, 1) = CAST({total(start, size)} AS VARCHAR)"
    number = lambda v: f"upper(regexp_replace({v}, '[\\s<]', '', 'g'))"
    nation = lambda v: f"(SELECT CASE {' '.join(f'WHEN y IN ({chr(44).join(q(x) for x in names)}) THEN {q(code)}' for code, names in NATIONALITIES.items())} ELSE y END FROM (SELECT {number(v)} AS y))"
    noise = lambda v: f"(length(trim(lower({v}))) < 2 OR regexp_matches(lower({v}), '/|surname|given|name|nom'))"
    words = lambda v: f"regexp_extract_all(upper({v}), '[A-Z]+')"
    made = []
    row = lambda test, rule, severity, title, evidence, impact: made.append(f"CASE WHEN {test} THEN {{'rule': {rule}, 'severity': {severity}, 'title': {title}, 'evidence': {evidence}, 'impact': {impact}}} END")
    fixed = lambda test, rule, evidence: row(test, q(rule), q(S.FINDINGS[rule][0]), q(S.FINDINGS[rule][1]), evidence, S.FINDINGS[rule][2])
    both = lambda shown, zone: f"'Visual: ' || f_{shown} || ' | MRZ: ' || f_{zone}"
    fixed("mistyped", "DOCUMENT_TYPE_MISMATCH", "'Expected: ' || ty || ' | Detected: ' || upper(f_detected)")
    for n, shown in S.REQUIRED.items():
        row(f"ty = 'PASSPORT' AND f_{n} IS NULL", q(f"REQUIRED_FIELD_MISSING_{n.upper()}"), "'CRITICAL'", q(f"Required Field {shown} Missing"), q(f"{shown} is null or empty"), 25)
    for rule, evidence in (("AADHAAR_INVALID_PREFIX", "'Identifier: ' || f_national_id"), ("VERHOEFF_CHECKSUM_FAILURE", "'Aadhaar: ' || f_national_id"), ("NATIONAL_ID_FORMAT_MISMATCH", "'Raw value: ' || f_national_id"), ("MISSING_AADHAAR_IDENTIFIER", "'Aadhaar Number: Not Found'")):
        fixed(f"ty IN ('NATIONAL_ID', 'AADHAAR') AND idr = '{rule}'", rule, evidence)
    for rule, evidence in (("DRIVING_LICENSE_FORMAT_MISMATCH", "'DL Number: ' || f_licence"), ("MISSING_LICENSE_IDENTIFIER", "'License Number: Not Found'")):
        fixed(f"ty = 'DRIVING_LICENSE' AND dlr = '{rule}'", rule, evidence)
    fixed("ty = 'VISA' AND f_visa IS NULL", "MISSING_VISA_IDENTIFIER", "'Visa: Not Found'")
    fixed("ty = 'PERMIT' AND f_permit IS NULL", "MISSING_PERMIT_IDENTIFIER", "'Permit Number: Not Found'")
    said = "'MRZ Check Digit Mismatch: Doc# valid=' || o1 || ', DOB valid=' || o2 || ', Expiry valid=' || o3"
    row("bad IS NOT NULL", "'ICAO_9303_CHECKSUM_FAILURE'", "'CRITICAL'", f"CASE bad WHEN 'LENGTH' THEN {q(S.ZONE_TITLES['LENGTH'])} ELSE {q(S.ZONE_TITLES['CHECKSUM'])} END", f"CASE bad WHEN 'LENGTH' THEN 'MRZ Line 2 length: ' || length(z) ELSE {said} END", 40)
    fixed("ty = 'PASSPORT' AND z IS NULL", "MISSING_MRZ_LINES", "'MRZ Lines: Not Found / Obscured'")
    fixed(f"de < DATE '{AS_OF}'", "EXPIRED_DOCUMENT", "'Expiry Date: ' || f_expiry")
    fixed(f"de >= DATE '{AS_OF}' AND de < DATE '{AS_OF}' + 180", "SIX_MONTH_EXPIRY_WARNING", "'Expiry Date: ' || f_expiry")
    fixed(f"db > DATE '{AS_OF}'", "FUTURE_DOB_ANOMALY", "'DOB: ' || f_birth")
    fixed(noise("f_noted_nationality"), "INVALID_NATIONALITY_EXTRACTION", "'Nationality: ' || f_noted_nationality")
    row(f"{number('f_zone_number')} <> {number('f_shown_number')}", "'VISUAL_MRZ_NUMBER_MISMATCH'", "'CRITICAL'", "'Visual vs MRZ ' || CASE WHEN ty = 'VISA' THEN 'Visa' ELSE 'Passport' END || ' Number Mismatch'", both("shown_number", "zone_number"), 30)
    fixed(f"len({words('f_zone_name')}) > 0 AND len({words('f_shown_name')}) > 0 AND NOT list_has_any({words('f_zone_name')}, {words('f_shown_name')})", "VISUAL_MRZ_NAME_MISMATCH", both("shown_name", "zone_name"))
    fixed(f"NOT {noise('f_shown_nationality')} AND {nation('f_zone_nationality')} <> {nation('f_shown_nationality')}", "VISUAL_MRZ_NATIONALITY_MISMATCH", both("shown_nationality", "zone_nationality"))
    fixed("d_zone_birth <> d_shown_birth", "VISUAL_MRZ_DOB_MISMATCH", both("shown_birth", "zone_birth"))
    fixed("d_zone_expiry <> d_shown_expiry", "VISUAL_MRZ_EXPIRY_MISMATCH", both("shown_expiry", "zone_expiry"))
    fixed("upper(f_zone_gender[1]) <> upper(f_shown_gender[1])", "VISUAL_MRZ_GENDER_MISMATCH", both("shown_gender", "zone_gender"))
    hit = {n: e.replace(_K, "k") for n, e in _HIT.items()}
    row(_LISTED.replace(_K, "k"), "'WATCHLIST_HIT_ALERT'", f"coalesce({hit['risk_level']}, 'CRITICAL')", f"'Border Watchlist Hit: ' || replace({hit['reason']}, '_', ' ')", f"'Watchlist Entry: Doc #' || {hit['document_number']} || ' (' || coalesce({hit['full_name']}, 'Named Subject') || ') - Reason: ' || {hit['reason']}", 45)
    own, made[:] = list(made), []
    primary = "cf IN ('passport_number', 'name')"
    lost = "fmt <> 'VALID'"
    row(f"rd AND NOT ov AND {lost}", "'AI_REGULATORY_VALIDATION_FAILURE'", "'CRITICAL'", "'Document Standards Regulatory Rejection'", "coalesce(array_to_string(er, '; '), 'Mandatory security credentials unverified or absent.')", 35)
    row("rd AND cs IN ('invalid', 'inconsistent')", "'AI_VALIDATION_' || upper(cf)", f"CASE WHEN {primary} THEN 'CRITICAL' ELSE 'MEDIUM' END", "'AI Standard Check: ' || replace(upper(cf), '_', ' ')", "'Field: ' || cf || ' | Confidence: 0.5'", f"CASE WHEN {primary} THEN 25 ELSE 0 END")
    row(f"rd AND cs = 'missing' AND {primary}", "'AI_MISSING_' || upper(cf)", "'CRITICAL'", "'Required Field Missing: ' || replace(upper(cf), '_', ' ')", "'Field: ' || cf", 30)
    for e in (1, 2):
        row(f"rd AND {lost} AND er IS NOT NULL", "'AI_VALIDATION_ERROR'", "'HIGH'", "'Official Document Standard Alert'", "'AI Validation Ruleset'", 20)
    states = ", ".join(q(s) for s in STATES)
    clean_id, clean_dl = "regexp_replace(f_national_id, '\\s+', '', 'g')", "upper(regexp_replace(f_licence, '[\\s-]', '', 'g'))"
    told = "list_transform({0}, lambda x: x.rule || '/' || x.severity || '/' || x.title || '/' || x.evidence || '/' || x.impact)"
    return f"""WITH t AS (SELECT c_custkey AS k, upper(coalesce({_TYPE}, 'PASSPORT')) AS ty, {_ZONE_VALID} AS zv, {_READ} AS rd, {_OUTSIDE_VALID} AS ov, {_CHECK_FIELD} AS cf, {_CHECK_STATUS} AS cs, {_ERRORS.format("['bad layout', 'no seal']")} AS er, {', '.join(f'{e} AS "{n}"' for n, e in FIELDS.items())} FROM customer),
        a AS (SELECT k, ty, zv, rd, ov, cf, cs, er, {looked} FROM t), b AS (SELECT *, {dates}, list_filter(list_transform(string_split(f_lines, chr(10)), lambda v: {trim('v')}), lambda v: v <> '') AS ls FROM a),
        c AS (SELECT *, TRY_CAST(d_expiry AS DATE) AS de, TRY_CAST(d_birth AS DATE) AS db, CASE WHEN len(ls) >= 2 THEN CASE WHEN regexp_matches(ls[2], '^[PV]') AND NOT regexp_matches(ls[1], '^[PV]') THEN ls[1] ELSE ls[2] END END AS z FROM b), u AS (SELECT *, upper(z) AS uz FROM c),
        d AS (SELECT *, {same(10, 1, 9)} OR (substr(z, 10, 1) = '<' AND {total(1, 9)} = 0) AS o1, {same(20, 14, 6)} AS o2, {same(28, 22, 6)} AS o3,
            CASE WHEN f_national_id IS NULL THEN 'MISSING_AADHAAR_IDENTIFIER' WHEN regexp_full_match({clean_id}, '[01][0-9]{{11}}') THEN 'AADHAAR_INVALID_PREFIX' WHEN regexp_full_match({clean_id}, '[0-9]{{12}}') THEN CASE WHEN NOT {_verhoeff_sql(clean_id)} THEN 'VERHOEFF_CHECKSUM_FAILURE' END WHEN NOT regexp_full_match({clean_id}, '[xX*]{{8}}[0-9]{{4}}') THEN 'NATIONAL_ID_FORMAT_MISMATCH' END AS idr,
            CASE WHEN f_licence IS NULL THEN 'MISSING_LICENSE_IDENTIFIER' WHEN NOT (regexp_full_match({clean_dl}, '[A-Z]{{2}}[0-9]{{13,15}}') AND substr({clean_dl}, 1, 2) IN ({states})) THEN 'DRIVING_LICENSE_FORMAT_MISMATCH' END AS dlr, coalesce(upper(f_detected) <> 'UNKNOWN' AND upper(f_detected) <> ty, false) AS mistyped FROM u),
        e AS (SELECT *, CASE WHEN ty IN ('PASSPORT', 'VISA') AND length(z) < 28 THEN 'LENGTH' WHEN ty IN ('PASSPORT', 'VISA') AND z IS NOT NULL AND (NOT (o1 AND o2 AND o3) OR coalesce(NOT zv, false)) THEN 'CHECKSUM' END AS bad FROM d),
        g AS (SELECT *, list_filter([{', '.join(own)}], lambda x: x IS NOT NULL) AS own, CASE WHEN ty IN ('NATIONAL_ID', 'AADHAAR') THEN CASE WHEN idr = 'VERHOEFF_CHECKSUM_FAILURE' THEN 'INVALID_CHECKSUM' WHEN idr IS NOT NULL THEN 'INVALID_FORMAT' ELSE 'VALID' END
            WHEN ty = 'DRIVING_LICENSE' THEN CASE WHEN dlr IS NULL THEN 'VALID' ELSE 'INVALID_FORMAT' END WHEN ty = 'VISA' THEN CASE WHEN f_visa IS NULL THEN 'INVALID_FORMAT' ELSE 'VALID' END WHEN ty = 'PERMIT' THEN CASE WHEN f_permit IS NULL THEN 'INVALID_FORMAT' ELSE 'VALID' END WHEN mistyped THEN 'INVALID_FORMAT' ELSE 'VALID' END AS fmt FROM e),
        h AS (SELECT *, list_concat(own, list_filter([{', '.join(made)}], lambda x: x IS NOT NULL)) AS fs FROM g)
        SELECT k, array_to_string({told.format('fs')}, chr(10)) AS findings, len(list_filter(fs, lambda x: x.severity IN ('CRITICAL', 'HIGH'))) = 0 AS is_valid, CAST(least(40, coalesce(list_sum(list_transform(fs, lambda x: x.impact)), 0)) AS INT) AS total_impact, fmt AS format,
        CASE WHEN bad IS NOT NULL OR (ty = 'PASSPORT' AND z IS NULL) THEN 'FAILED' WHEN ty IN ('PASSPORT', 'VISA') AND z IS NOT NULL THEN 'PASSED' ELSE 'SKIPPED' END AS mrz, CASE WHEN de < DATE '{AS_OF}' THEN 'EXPIRED' WHEN de < DATE '{AS_OF}' + 180 THEN 'NEAR_EXPIRY' WHEN de IS NOT NULL THEN 'VALID' ELSE 'NOT_CHECKED' END AS expiration,
        CASE WHEN db > DATE '{AS_OF}' THEN 'INVALID_FUTURE_DOB' WHEN db IS NOT NULL THEN 'VALID' ELSE 'NOT_CHECKED' END AS temporal, CASE WHEN len(list_filter(own, lambda x: starts_with(x.rule, 'VISUAL_MRZ_'))) > 0 THEN 'MISMATCH' ELSE 'CONSISTENT' END AS cross_field, CASE WHEN ty = 'VISA' OR f_visa IS NOT NULL THEN 'VALID' ELSE 'SKIPPED' END AS visa_entry, CASE WHEN {_LISTED.replace(_K, 'k')} THEN 'HIT_DETECTED' ELSE 'CLEAR' END AS watchlist FROM h"""


@query("g1_validation", _sql())
def validation(t):
    """Every check of a document, its findings in order, whether it stands and the capped impact."""
    found = S.screened(_documents(t), F.lit(AS_OF).cast("date"), PIVOT)
    told = F.transform("findings", lambda f: F.concat_ws("/", f["rule"], f["severity"], f["title"], f["evidence"], f["impact"].cast("string")))
    return found.select("k", F.array_join(told, "\n").alias("findings"), "is_valid", "total_impact", "checks.*")
