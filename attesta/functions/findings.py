"""Findings and routing: what a document is taken for, and what its checks and fields say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields whose failure weighs most, and those without which a document has no identity.
PRIMARY = ("id_number", "passport_number", "license_number", "visa_number", "permit_number", "name", "full_name")
IDENTIFIERS = PRIMARY[:5]
#: Impact of a rejected standard, a failed and a missing primary field, an error; and the most there is.
REJECTED, FAILED, MISSING, ERROR, MOST = 35, 25, 30, 20, 40
#: Number shapes and label orders of the older and newer passport layout.
OLD_NUMBER, NEW_NUMBER, NUMBER = "^[A-Z][0-9]{7}$", "^[A-Z]{2}[0-9]{6,7}$", r"\b([A-Z]{1,2}[0-9]{6,7})\b"
OLD_LABELS = (r"\bCOUNTRY\s*CODE\b", r"CODE\s*DU\s*PAYS", r"NATIONALITY\s*[:/]*\s*INDIAN\s*(SEX|DATE)", r"DATE\s*OF\s*ISSUE.*DATE\s*OF\s*EXPIRY")
NEW_LABELS = (r"\bCODE\s*:\s*IND\b", r"TYPE\s*:\s*P\s*CODE")
#: Document types and file name hints of each parser.
ROUTES = (("PASSPORT", ("PASSPORT",), "passport"), ("VISA", ("VISA",), "visa"), ("PERMIT", ("PERMIT",), "permit|transit|clearance"), ("ID", ("NATIONAL_ID", "DRIVING_LICENSE"), "license|id_card|national"))


def _is(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def folded_checks(checks: Column, valid: Column, errors: Column, format_valid: Column, document_type: Column) -> Column:
    """Findings of an array of outside checks (struct of field, status, message, confidence), as array of struct (rule, severity, title, description, evidence, impact).

    In order: a rejected standard where ``valid`` is false and the format isn't valid; for each check that is
    invalid, inconsistent, or missing in a primary field one finding; for each of ``errors`` one, where the format isn't valid. Null arrays have no elements.
    """
    finding = lambda rule, severity, title, description, evidence, impact: F.struct(rule.alias("rule"), severity.alias("severity"), title.alias("title"), description.alias("description"), evidence.alias("evidence"), impact.cast("int").alias("impact"))
    failing = ~F.coalesce(format_valid, F.lit(False))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    joined = F.array_join(errors, "; ")
    rejected = finding(F.lit("AI_REGULATORY_VALIDATION_FAILURE"), F.lit("CRITICAL"), F.lit("Document Standards Regulatory Rejection"), text("Document failed official regulatory standards and format rules for ", F.coalesce(document_type, F.lit("")), "."), F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise("Mandatory security credentials unverified or absent."), F.lit(REJECTED))
    none = F.filter(F.array(rejected), lambda x: F.lit(False))

    def of(c: Column) -> Column:
        field, status = c["field"], c["status"]
        primary, upper = _is(field, PRIMARY), F.upper(field)
        label = F.replace(upper, F.lit("_"), F.lit(" "))
        failed = finding(text("AI_VALIDATION_", F.coalesce(upper, F.lit("RULE"))), F.when(primary, "CRITICAL").otherwise("MEDIUM"), text("AI Standard Check: ", F.coalesce(label, F.lit("undefined"))), F.coalesce(c["message"], text("Validation check failed for ", F.coalesce(field, F.lit("undefined")), ".")), text("Field: ", F.coalesce(field, F.lit("undefined")), " | Confidence: ", F.coalesce(c["confidence"].cast("string"), F.lit("N/A"))), F.when(primary, FAILED).otherwise(0))
        missing = finding(text("AI_MISSING_", upper), F.lit("CRITICAL"), text("Required Field Missing: ", label), F.coalesce(c["message"], text("Required field ", field, " is missing or unreadable.")), text("Field: ", field), F.lit(MISSING))
        return F.when(_is(status, ("invalid", "inconsistent")), failed).when(_is(status, ("missing",)) & primary, missing)

    first = F.when((valid == F.lit(False)) & failing, F.array(rejected)).otherwise(none)
    middle = F.filter(F.transform(checks, of), lambda x: x.isNotNull())
    error = lambda e: finding(F.lit("AI_VALIDATION_ERROR"), F.lit("HIGH"), F.lit("Official Document Standard Alert"), e, F.lit("AI Validation Ruleset"), F.lit(ERROR))
    last = F.when(failing, F.transform(errors, error))
    return F.concat(first, F.coalesce(middle, none), F.coalesce(last, none))


def total_impact(findings: Column) -> Column:
    return F.least(F.lit(MOST), F.aggregate(findings, F.lit(0), lambda a, f: a + f["impact"]))


def passes(findings: Column) -> Column:
    """No finding is critical or high."""
    return ~F.exists(findings, lambda f: f["severity"].isin("CRITICAL", "HIGH"))


def plain_fields(fields: Column) -> Column:
    """A map of extracted fields (struct with value) as a map of the values there are."""
    return F.transform_values(F.map_filter(fields, lambda _, f: f["value"].isNotNull()), lambda _, f: f["value"])


def parser(document_type: Column, filename: Column, passport: Column, visa: Column, permit: Column) -> Column:
    """Which parser a document goes to: by type or file name, in the order of ROUTES; else the first whose attempt (the flags) found something, else the passport's."""
    route = F.lit(None).cast("string")
    for name, types, hint in reversed(ROUTES):
        route = F.when(_is(document_type, types) | F.coalesce(F.lower(filename).rlike(hint), F.lit(False)), name).otherwise(route)
    attempt = F.when(passport, "PASSPORT").when(visa, "VISA").when(permit, "PERMIT").otherwise("PASSPORT")
    return F.coalesce(route, attempt)


def detected_type(classified: Column, result_type: Column, missing_fields: Column) -> Column:
    """The classified type; where that is UNKNOWN the result's, unless one of the identifiers is among the missing fields."""
    lost = F.coalesce(F.arrays_overlap(missing_fields, F.array(*map(F.lit, IDENTIFIERS))), F.lit(False))
    return F.when(classified != "UNKNOWN", classified).when(~lost & (F.coalesce(result_type, F.lit("")) != ""), F.upper(result_type)).otherwise("UNKNOWN")


def supported(detected: Column, declared: Column) -> Column:
    return (F.lower(detected) != "unknown") & (F.lower(detected) == F.lower(declared))


def passport_layout(text: Column, line1: Column, line2: Column) -> Column:
    """OLD_FORMAT or NEW_FORMAT, by the first passport number in the text, else labels, else the optional data of the zone's second line."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(upper, NUMBER, 1)
    swapped = F.coalesce(line2.startswith("P") & ~line1.startswith("P"), F.lit(False))
    second = F.when(swapped, line1).otherwise(line2)
    tail = F.replace(F.substring(second, 29, 14), F.lit("<"), F.lit(""))
    any_of = lambda patterns: F.greatest(*[upper.rlike(p) for p in patterns])
    return (
        F.when(number.rlike(OLD_NUMBER), "OLD_FORMAT").when(number.rlike(NEW_NUMBER), "NEW_FORMAT")
        .when(any_of(OLD_LABELS), "OLD_FORMAT").when(any_of(NEW_LABELS), "NEW_FORMAT")
        .when((F.length(second) >= 28) & tail.rlike("^[0-9]{10,14}$"), "NEW_FORMAT").otherwise("OLD_FORMAT")
    )


def shown_date(digits: Column, year: int) -> Column:
    """Six digits yymmdd as dd/mm/yyyy; years up to 25 after ``year`` are of this century's hundred. Anything else stays as it is, null is empty."""
    yy = F.substring(digits, 1, 2)
    n = F.try_to_number(yy, F.lit("99")).cast("int")
    full = F.when(n <= year % 100 + 25, 2000 + n).otherwise(1900 + n)
    good = F.coalesce(digits, F.lit("")).rlike("^[0-9]{6}$")
    return F.when(good, F.concat(F.substring(digits, 5, 2), F.lit("/"), F.substring(digits, 3, 2), F.lit("/"), full.cast("string"))).otherwise(F.coalesce(digits, F.lit("")))
