"""Findings, risk indicators, advice and summary of a document's extracted fields by fixed rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category, severity, title, confidence and location of each finding.
FINDINGS = {
    "expired": ("VALIDATION", "CRITICAL", "Document Credential Expired", 0.99, "Visual Inspection Zone / Expiry Field"),
    "valid": ("VALIDATION", "INFO", "Credential Validity Confirmed", 0.95, "Date of Expiry"),
    "unborn": ("IDENTITY", "CRITICAL", "Future Date of Birth Anomaly", 0.99, "Personal Data Zone"),
    "no_passport": ("DOCUMENT", "HIGH", "Missing Mandatory Passport Identifier", 0.90, "Header / Passport Number Field"),
    "passport": ("IDENTITY", "INFO", "Passport Identifier Verified", 0.96, "Document Number Field"),
    "name": ("IDENTITY", "INFO", "Subject Identity Record Formed", 0.94, "Bearer Full Name"),
    "zone": ("SECURITY", "INFO", "ICAO Doc 9303 MRZ Optical Zone Validated", 0.98, "Bottom MRZ Band"),
    "no_visa": ("DOCUMENT", "HIGH", "Missing Visa Foil Identifier", 0.88, "Visa Control Field"),
    "visa": ("DOCUMENT", "INFO", "Visa Control Number Identified", 0.95, "Visa Control Zone"),
    "visa_type": ("VALIDATION", "INFO", "Visa Classification: ", 0.92, "Visa Category Field"),
    "other": ("DOCUMENT", "INFO", "Cryptographic Document Enclave Ingestion", 0.90, "Document Header"),
}
#: Indicator, category, severity and confidence.
INDICATORS = {
    "expired": ("EXPIRED_DOCUMENT", "COMPLIANCE", "CRITICAL", 0.99),
    "unborn": ("FUTURE_DOB_FRAUD_RISK", "FRAUD", "CRITICAL", 0.99),
    "no_passport": ("MISSING_PASSPORT_NUMBER", "DOCUMENT", "HIGH", 0.90),
    "clean": ("VERIFIED_CREDENTIAL_STRUCTURE", "COMPLIANCE", "INFO", 0.95),
}
#: Advice for an expired document and for any other; summaries by the worst severity; their confidences.
ADVICE = ("Reject or flag expired document and request valid unexpired renewal.", "Verify document against operational watchlist and ensure primary identification matches biometric profile.")
SUMMARIES = {
    "CRITICAL": ("CRITICAL ALERT: Document screening detected high-severity compliance or fraud anomalies requiring immediate intervention.", 0.98),
    "HIGH": ("WARNING: Document screening detected potential discrepancies or missing mandatory security markers.", 0.94),
    "INFO": ("Document intelligence screening passed: Cryptographic structural checks and temporal fields verified.", 0.96),
}


def screened(document_type: Column, filename: Column, fields: Column, zone: Column, now: Column) -> Column:
    """A struct of findings, indicators, recommendations, summary, confidence and document_type.

    ``fields`` is a map of names to texts, where an empty text counts as none; ``zone`` an array of lines, ``now`` a
    date. Dates are read as yyyy-MM-dd; one that isn't says nothing. Null type, name, fields or zone are none.
    """
    field = lambda name: F.nullif(F.element_at(fields, name), F.lit(""))
    kind, file = F.coalesce(document_type, F.lit("")), F.lower(F.coalesce(filename, F.lit("")))
    passport = (kind == "PASSPORT") | file.contains("passport")
    visa = ~passport & ((kind == "VISA") | file.contains("visa"))
    shown = F.coalesce(field("dateOfExpiry"), field("validUntil"))
    expiry, birth = (F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date") for d in (shown, field("dateOfBirth")))
    number, name, visa_number, visa_type = field("passportNumber"), field("fullName"), field("visaNumber"), field("visaType")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    on = {
        "expired": (expiry < now, say("The document expired on ", expiry.cast("string"), ", rendering it invalid for active border authorization."), say("Expiry Date: ", shown)),
        "valid": (expiry >= now, say("Document is active and valid until ", expiry.cast("string"), "."), say("Expiry Date: ", shown)),
        "unborn": (birth > now, F.lit("Date of birth is registered in the future, indicating fraudulent data fabrication or severe OCR corruption."), say("Date of Birth: ", field("dateOfBirth"))),
        "no_passport": (passport & number.isNull(), F.lit("The document does not contain a discernible alphanumeric passport number."), F.lit(None).cast("string")),
        "passport": (passport & number.isNotNull(), say("Extracted passport identifier ", number, " formatted correctly."), say("Passport No: ", number)),
        "name": (passport & name.isNotNull(), say('Identity resolved to subject name "', name, '".'), say("Name: ", name)),
        "zone": (passport & (F.size(F.coalesce(zone, F.array().cast("array<string>"))) >= 2), F.lit("Two-line Machine Readable Zone (MRZ) formatted to ICAO standard specifications."), F.array_join(zone, " | ")),
        "no_visa": (visa & visa_number.isNull(), F.lit("No unique visa control or registration number was detected."), F.lit(None).cast("string")),
        "visa": (visa & visa_number.isNotNull(), say("Visa credential control number ", visa_number, " captured."), say("Visa No: ", visa_number)),
        "visa_type": (visa & visa_type.isNotNull(), say("Travel authorization category recognized as ", visa_type, " with ", F.coalesce(field("entryValidation"), F.lit("standard")), " entry clearance."), say("Type: ", visa_type)),
        "other": (~passport & ~visa, F.lit("Document content parsed, normalized, and vaulted for screening telemetry."), say("Filename: ", F.coalesce(filename, F.lit("")))),
    }

    def finding(key: str) -> Column:
        category, severity, title, confidence, location = FINDINGS[key]
        holds, description, evidence = on[key]
        full = say(title, visa_type) if key == "visa_type" else F.lit(title)
        return F.when(holds, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), full.alias("title"), description.alias("description"), evidence.alias("evidence"), F.lit(confidence).alias("confidence"), F.lit(location).alias("location")))

    def indicator(key: str, holds: Column, evidence: Column) -> Column:
        code, category, severity, confidence = INDICATORS[key]
        return F.when(holds, F.struct(F.lit(code).alias("indicator"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")))

    expired, unborn = (F.coalesce(on[k][0], F.lit(False)) for k in ("expired", "unborn"))
    unnumbered = on["no_passport"][0]
    indicators = F.array(
        indicator("expired", expired, say("Expired on ", shown)),
        indicator("unborn", unborn, say("DOB in future: ", field("dateOfBirth"))),
        indicator("no_passport", unnumbered, F.lit("No passport number found in extraction")),
        indicator("clean", ~(expired | unborn | unnumbered), F.lit("No structural or temporal anomalies identified during automated intelligence screening.")),
    )
    worst = lambda i: F.when(expired | unborn, F.lit(SUMMARIES["CRITICAL"][i])).when(unnumbered | on["no_visa"][0], F.lit(SUMMARIES["HIGH"][i])).otherwise(F.lit(SUMMARIES["INFO"][i]))
    return F.struct(
        F.filter(F.array(*map(finding, on)), lambda f: f.isNotNull()).alias("findings"),
        F.filter(indicators, lambda f: f.isNotNull()).alias("indicators"),
        F.array(F.when(expired, ADVICE[0]).otherwise(ADVICE[1])).alias("recommendations"),
        worst(0).alias("summary"),
        worst(1).alias("confidence"),
        F.coalesce(F.nullif(document_type, F.lit("")), F.lit("OTHER")).alias("document_type"),
    )
