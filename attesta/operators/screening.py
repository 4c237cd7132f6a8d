"""All checks of a submitted document over its extracted fields: type, required fields, identifiers, zone, dates, what is shown against the zone, watchlist and outside checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import checks as C
from attesta.functions.dates import birth_status, expiry_status, standard_date
from attesta.functions.findings import folded_checks

#: Spellings of each field's name, in the order they are looked up.
NAMES = {
    "detected": ("detectedDocumentType", "detected_type", "classifiedType"),
    "name": ("name", "fullName"),
    "passport_number": ("passport_number", "passportNumber"),
    "nationality": ("nationality",),
    "date_of_birth": ("date_of_birth", "dateOfBirth"),
    "date_of_expiry": ("date_of_expiry", "dateOfExpiry"),
    "gender": ("gender",),
    "national_id": ("idNumber", "id_number", "aadhaarNumber"),
    "licence": ("licenseNumber", "license_number", "dlNumber"),
    "visa": ("visaNumber", "visa_number"),
    "permit": ("permitNumber", "permit_number", "eILPNo", "ilpNumber", "id_number"),
    "expiry": ("dateOfExpiry", "date_of_expiry", "visualDateOfExpiry", "visual_date_of_expiry", "validUntil", "valid_until"),
    "birth": ("dateOfBirth", "date_of_birth", "visualDateOfBirth", "visual_date_of_birth"),
    "zone_number": ("passportNumber", "passport_number", "mrz_passport_number", "visaNumber", "visa_number", "mrz_visa_number"),
    "shown_number": ("visualPassportNumber", "visual_passport_number", "visPassportNumber", "visualVisaNumber", "visual_visa_number", "visVisaNumber"),
    "zone_name": ("name", "fullName", "mrz_name"),
    "shown_name": ("visualName", "visual_name", "visName"),
    "noted_nationality": ("visualNationality", "visual_nationality"),
    "zone_nationality": ("nationality", "mrz_nationality"),
    "shown_nationality": ("visualNationality", "visual_nationality", "visNationality"),
    "zone_birth": ("dateOfBirth", "date_of_birth", "mrz_date_of_birth"),
    "shown_birth": ("visualDateOfBirth", "visual_date_of_birth", "visDateOfBirth"),
    "zone_expiry": ("dateOfExpiry", "date_of_expiry", "mrz_date_of_expiry"),
    "shown_expiry": ("visualDateOfExpiry", "visual_date_of_expiry", "visDateOfExpiry"),
    "zone_gender": ("gender", "mrz_gender"),
    "shown_gender": ("visualGender", "visual_gender", "visGender"),
    "lines": ("mrzLines", "mrz_lines"),
}
#: Fields a passport has to show, as they are named in findings.
REQUIRED = {"name": "Name", "passport_number": "Passport Number", "nationality": "Nationality", "date_of_birth": "Date of Birth", "date_of_expiry": "Date of Expiry", "gender": "Gender"}
#: Rule, severity, title and impact of every finding.
FINDINGS = {
    "DOCUMENT_TYPE_MISMATCH": ("CRITICAL", "Document Type Mismatch Detected", 50),
    "AADHAAR_INVALID_PREFIX": ("CRITICAL", "Invalid Aadhaar Prefix Structure", 35),
    "VERHOEFF_CHECKSUM_FAILURE": ("CRITICAL", "Aadhaar Mathematical Checksum Mismatch", 40),
    "NATIONAL_ID_FORMAT_MISMATCH": ("CRITICAL", "Invalid National ID Syntax", 35),
    "MISSING_AADHAAR_IDENTIFIER": ("CRITICAL", "Missing National Identity Credentials", 45),
    "DRIVING_LICENSE_FORMAT_MISMATCH": ("CRITICAL", "Invalid Driving License Format", 35),
    "MISSING_LICENSE_IDENTIFIER": ("CRITICAL", "Missing Driving License Identifier", 45),
    "MISSING_VISA_IDENTIFIER": ("CRITICAL", "Missing Visa Identifier", 45),
    "MISSING_PERMIT_IDENTIFIER": ("CRITICAL", "Missing Permit Authorization Number", 45),
    "MISSING_MRZ_LINES": ("CRITICAL", "Missing or Obscured Machine Readable Zone (MRZ)", 45),
    "EXPIRED_DOCUMENT": ("CRITICAL", "Document Credential Expired", 35),
    "SIX_MONTH_EXPIRY_WARNING": ("MEDIUM", "Document Expires Within 6 Months", 10),
    "FUTURE_DOB_ANOMALY": ("CRITICAL", "Fraudulent Future Date of Birth", 35),
    "INVALID_NATIONALITY_EXTRACTION": ("CRITICAL", "Invalid Nationality Extraction", 20),
    "VISUAL_MRZ_NAME_MISMATCH": ("CRITICAL", "Visual Name vs MRZ Name Mismatch", 30),
    "VISUAL_MRZ_NATIONALITY_MISMATCH": ("HIGH", "Visual vs MRZ Nationality Mismatch", 20),
    "VISUAL_MRZ_DOB_MISMATCH": ("CRITICAL", "Visual vs MRZ Date of Birth Mismatch", 30),
    "VISUAL_MRZ_EXPIRY_MISMATCH": ("CRITICAL", "Visual vs MRZ Date of Expiry Mismatch", 30),
    "VISUAL_MRZ_GENDER_MISMATCH": ("HIGH", "Visual vs MRZ Gender Mismatch", 20),
}
#: Impacts of a missing required field, a bad zone, numbers that differ and a watchlist hit; titles of a bad zone; the most impact there is; characters of a zone's second line at least.
MISSING, BAD_ZONE, NUMBERS, LISTED, ZONE_TITLES, MOST, ZONE_LENGTH = 25, 40, 30, 45, {"CHECKSUM": "MRZ Check Digit Calculation Mismatch", "LENGTH": "Corrupted or Incomplete MRZ Block"}, 40, 28
_FINDING = "struct<rule:string,severity:string,title:string,evidence:string,impact:int>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lookup(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of the names with a value: trimmed, not empty and not the word null."""
    tried = F.transform(F.array(*map(F.lit, names)), lambda n: _trim(F.element_at(fields, n)))
    return F.get(F.filter(tried, lambda v: v.isNotNull() & (v != "") & (v != "null")), F.lit(0))


def screened(documents: DataFrame, as_of: Column, pivot: int) -> DataFrame:
    """``documents`` with findings, checks, is_valid and total_impact.

    ``documents`` holds document_type (null: PASSPORT), fields (map of name to text, under any of the NAMES) and, where known, zone_valid (boolean: an earlier reader's verdict on the zone), hit (struct of
    risk_level, reason, document_number and full_name: the first watchlist entry that matches) and outside (struct of valid, checks and errors, as ``folded_checks`` takes them). Further columns stay; they may not begin with two underscores.
    ``pivot`` is the last two-digit year of this century.

    ``findings`` is an array of struct (rule, severity, title, evidence, impact), in the order of the checks; ``checks`` a struct with the outcome of each: format, mrz, expiration, temporal, cross_field, visa_entry and watchlist.
    A document is valid without critical or high findings; ``total_impact`` is the sum of impacts, MOST at most. Dates that are none are not checked.
    """
    columns = documents.columns
    known = documents.withColumn("__type", F.upper(F.when(F.coalesce("document_type", F.lit("")) != "", F.col("document_type")).otherwise("PASSPORT"))).withColumn("__fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    for name, kind in (("zone_valid", "boolean"), ("hit", "struct<risk_level:string,reason:string,document_number:string,full_name:string>"), ("outside", "struct<valid:boolean,checks:array<struct<field:string,status:string,message:string,confidence:double>>,errors:array<string>>")):
        known = known.withColumn(f"__{name}", (F.col(name) if name in columns else F.lit(None)).cast(kind))
    c = lambda n: F.col(f"__{n}")
    kind = c("type")
    one = known.withColumns({f"__{n}": _lookup(c("fields"), names) for n, names in NAMES.items()})
    day = lambda n: standard_date(c(n), pivot)
    kept = F.filter(F.transform(F.split(c("lines"), "\n"), _trim), lambda v: v != "")
    two = one.withColumns({"__kept": F.coalesce(kept, F.array().cast("array<string>")), **{f"__d_{n}": day(n) for n in ("expiry", "birth", "zone_birth", "shown_birth", "zone_expiry", "shown_expiry")}})
    first, second = F.get("__kept", F.lit(0)), F.get("__kept", F.lit(1))
    leads = lambda line: line.rlike("^[PV]")
    three = two.withColumns({"__z": F.when(F.size("__kept") >= 2, F.when(leads(second) & ~leads(first), first).otherwise(second)), "__day_expiry": c("d_expiry").try_cast("date"), "__day_birth": c("d_birth").try_cast("date")})

    def holds(at: int, start: int, size: int) -> Column:
        said, expected = F.substring("__z", at, 1), C.icao_digit_plain(F.upper(F.substring("__z", start, size)))
        return F.transform(F.array(expected), lambda e: (said == e.cast("string")) | (F.lit(at == 10) & (said == "<") & (e == 0)))[0]

    four = three.withColumns({
        "__ok": F.struct(*[holds(*place).alias(n) for n, place in {"number": (10, 1, 9), "birth": (20, 14, 6), "expiry": (28, 22, 6)}.items()]), "__id_rule": C.aadhaar_rule(c("national_id")), "__dl_rule": C.licence_rule(c("licence")),
        "__lasts": expiry_status(c("day_expiry"), as_of), "__born": birth_status(c("day_birth"), as_of),
    })
    zoned, national = kind.isin("PASSPORT", "VISA"), kind.isin("NATIONAL_ID", "AADHAAR")
    length = F.length("__z")
    broken = F.when(zoned & (length < ZONE_LENGTH), "LENGTH").when(zoned & c("z").isNotNull() & (~(c("ok")["number"] & c("ok")["birth"] & c("ok")["expiry"]) | (c("zone_valid") == F.lit(False))), "CHECKSUM")
    five = four.withColumns({
        "__bad_zone": broken, "__mistyped": (F.coalesce("__detected", F.lit("UNKNOWN")) != "UNKNOWN") & (F.upper(c("detected")) != "UNKNOWN") & (F.upper(c("detected")) != kind), "__noisy": C.noisy_nationality(c("noted_nationality")), "__numbers": C.numbers_differ(c("zone_number"), c("shown_number")),
        "__names": C.names_differ(c("zone_name"), c("shown_name")), "__nations": F.coalesce(~C.noisy_nationality(c("shown_nationality")) & (C.canonical_nationality(c("zone_nationality")) != C.canonical_nationality(c("shown_nationality"))), F.lit(False)),
        "__genders": F.coalesce(F.upper(F.substring(c("zone_gender"), 1, 1)) != F.upper(F.substring(c("shown_gender"), 1, 1)), F.lit(False)),
    })
    finding = lambda rule, severity, title, evidence, impact: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(t).alias(n) for n, x, t in (("rule", rule, "string"), ("severity", severity, "string"), ("title", title, "string"), ("evidence", evidence, "string"), ("impact", impact, "int"))])
    when = lambda test, made: F.when(F.coalesce(test, F.lit(False)), made)
    fixed = lambda test, rule, evidence: when(test, finding(rule, *FINDINGS[rule][:2], evidence, FINDINGS[rule][2]))
    told = lambda label, n: F.concat(F.lit(f"{label}: "), c(n))
    both = lambda shown, zone: F.concat(F.lit("Visual: "), c(shown), F.lit(" | MRZ: "), c(zone))
    differ = lambda a, b: c(a) != c(b)
    number_rules = [(national, "id_rule", "AADHAAR_INVALID_PREFIX", told("Identifier", "national_id")), (national, "id_rule", "VERHOEFF_CHECKSUM_FAILURE", told("Aadhaar", "national_id")), (national, "id_rule", "NATIONAL_ID_FORMAT_MISMATCH", told("Raw value", "national_id")), (national, "id_rule", "MISSING_AADHAAR_IDENTIFIER", "Aadhaar Number: Not Found"), (kind == "DRIVING_LICENSE", "dl_rule", "DRIVING_LICENSE_FORMAT_MISMATCH", told("DL Number", "licence")), (kind == "DRIVING_LICENSE", "dl_rule", "MISSING_LICENSE_IDENTIFIER", "License Number: Not Found")]
    digits = F.concat(*[x for n, label in (("number", "Doc# valid="), ("birth", ", DOB valid="), ("expiry", ", Expiry valid=")) for x in (F.lit(label), c("ok")[n].cast("string"))])
    zone_said = F.when(c("bad_zone") == "LENGTH", F.concat(F.lit("MRZ Line 2 length: "), length.cast("string"))).otherwise(F.concat(F.lit("MRZ Check Digit Mismatch: "), digits))
    label = F.when(kind == "VISA", "Visa").otherwise("Passport")
    own = [
        fixed(c("mistyped"), "DOCUMENT_TYPE_MISMATCH", F.concat(F.lit("Expected: "), kind, F.lit(" | Detected: "), F.upper(c("detected")))),
        *[when((kind == "PASSPORT") & c(n).isNull(), finding(f"REQUIRED_FIELD_MISSING_{n.upper()}", "CRITICAL", f"Required Field {shown} Missing", f"{shown} is null or empty", MISSING)) for n, shown in REQUIRED.items()],
        *[fixed(on & (c(n) == rule), rule, evidence) for on, n, rule, evidence in number_rules],
        fixed((kind == "VISA") & c("visa").isNull(), "MISSING_VISA_IDENTIFIER", "Visa: Not Found"), fixed((kind == "PERMIT") & c("permit").isNull(), "MISSING_PERMIT_IDENTIFIER", "Permit Number: Not Found"),
        when(c("bad_zone").isNotNull(), finding("ICAO_9303_CHECKSUM_FAILURE", "CRITICAL", F.when(c("bad_zone") == "LENGTH", ZONE_TITLES["LENGTH"]).otherwise(ZONE_TITLES["CHECKSUM"]), zone_said, BAD_ZONE)),
        fixed((kind == "PASSPORT") & c("z").isNull(), "MISSING_MRZ_LINES", "MRZ Lines: Not Found / Obscured"),
        fixed(c("lasts") == "EXPIRED", "EXPIRED_DOCUMENT", told("Expiry Date", "expiry")), fixed(c("lasts") == "NEAR_EXPIRY", "SIX_MONTH_EXPIRY_WARNING", told("Expiry Date", "expiry")), fixed(c("born") == "INVALID_FUTURE_DOB", "FUTURE_DOB_ANOMALY", told("DOB", "birth")),
        fixed(c("noisy"), "INVALID_NATIONALITY_EXTRACTION", told("Nationality", "noted_nationality")),
        when(c("numbers"), finding("VISUAL_MRZ_NUMBER_MISMATCH", "CRITICAL", F.concat(F.lit("Visual vs MRZ "), label, F.lit(" Number Mismatch")), both("shown_number", "zone_number"), NUMBERS)),
        fixed(c("names"), "VISUAL_MRZ_NAME_MISMATCH", both("shown_name", "zone_name")), fixed(c("nations"), "VISUAL_MRZ_NATIONALITY_MISMATCH", both("shown_nationality", "zone_nationality")),
        fixed(differ("d_zone_birth", "d_shown_birth"), "VISUAL_MRZ_DOB_MISMATCH", both("shown_birth", "zone_birth")), fixed(differ("d_zone_expiry", "d_shown_expiry"), "VISUAL_MRZ_EXPIRY_MISMATCH", both("shown_expiry", "zone_expiry")), fixed(c("genders"), "VISUAL_MRZ_GENDER_MISMATCH", both("shown_gender", "zone_gender")),
        when(c("hit").isNotNull(), finding("WATCHLIST_HIT_ALERT", F.coalesce(c("hit")["risk_level"], F.lit("CRITICAL")), F.concat(F.lit("Border Watchlist Hit: "), F.replace(c("hit")["reason"], F.lit("_"), F.lit(" "))), F.concat(F.lit("Watchlist Entry: Doc #"), F.coalesce(c("hit")["document_number"], F.lit("")), F.lit(" ("), F.coalesce(c("hit")["full_name"], F.lit("Named Subject")), F.lit(") - Reason: "), c("hit")["reason"]), LISTED)),
    ]
    id_bad = F.when(c("id_rule") == "VERHOEFF_CHECKSUM_FAILURE", "INVALID_CHECKSUM").when(c("id_rule").isNotNull(), "INVALID_FORMAT").otherwise("VALID")
    by_type = F.when(national, id_bad).when(kind == "DRIVING_LICENSE", F.when(c("dl_rule").isNull(), "VALID").otherwise("INVALID_FORMAT")).when(kind == "VISA", F.when(c("visa").isNull(), "INVALID_FORMAT").otherwise("VALID")).when(kind == "PERMIT", F.when(c("permit").isNull(), "INVALID_FORMAT").otherwise("VALID"))
    six = five.withColumn("__own", F.array_compact(F.array(*own))).withColumn("__format", F.coalesce(by_type, F.when(c("mistyped"), "INVALID_FORMAT").otherwise("VALID")))
    outside = folded_checks(c("outside")["checks"], c("outside")["valid"], c("outside")["errors"], c("format") == "VALID", kind)
    brief = F.transform(F.when(c("outside").isNotNull() & c("outside")["checks"].isNotNull(), outside), lambda f: F.struct(f["rule"], f["severity"], f["title"], f["evidence"], f["impact"]).cast(_FINDING))
    seven = six.withColumn("__all", F.concat("__own", F.coalesce(brief, F.array().cast(f"array<{_FINDING}>"))))
    mismatch = F.exists("__own", lambda f: f["rule"].startswith("VISUAL_MRZ_") & f["rule"].endswith("_MISMATCH"))
    checks = {
        "format": c("format"), "mrz": F.when(c("bad_zone").isNotNull() | ((kind == "PASSPORT") & c("z").isNull()), "FAILED").when(zoned & c("z").isNotNull(), "PASSED").otherwise("SKIPPED"), "expiration": F.coalesce("__lasts", F.lit("NOT_CHECKED")), "temporal": F.coalesce("__born", F.lit("NOT_CHECKED")),
        "cross_field": F.when(mismatch, "MISMATCH").otherwise("CONSISTENT"), "visa_entry": F.when((kind == "VISA") | c("visa").isNotNull(), "VALID").otherwise("SKIPPED"), "watchlist": F.when(c("hit").isNotNull(), "HIT_DETECTED").otherwise("CLEAR"),
    }
    impact = F.aggregate("__all", F.lit(0), lambda a, f: a + f["impact"])
    return seven.select(*[F.col(f"`{x}`") for x in columns], F.col("__all").alias("findings"), F.struct(*[v.alias(k) for k, v in checks.items()]).alias("checks"), (~F.exists("__all", lambda f: f["severity"].isin("CRITICAL", "HIGH"))).alias("is_valid"), F.least(F.lit(MOST), impact).alias("total_impact"))
