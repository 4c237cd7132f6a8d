"""Screening of single documents."""

from pyspark.sql import functions as F

from attesta.functions.heuristics import ADVICE, screened


def test_screened(spark):
    rows = [
        ("PASSPORT", None, {"dateOfExpiry": "2030-01-02", "passportNumber": "X1", "fullName": "A B"}, ["L1", "L2"]),
        (None, "Old-VISA.pdf", {"validUntil": "2020-01-02", "visaType": "T", "visaNumber": ""}, None),
        ("", None, None, []),
        ("PASSPORT", "visa.png", {"dateOfBirth": "2031-01-01", "dateOfExpiry": "31/02/2030"}, ["L1"]),
    ]
    frame = spark.createDataFrame(rows, "kind string, file string, fields map<string, string>, zone array<string>")
    out = [r.s for r in frame.select(screened(F.col("kind"), F.col("file"), F.col("fields"), F.col("zone"), F.lit("2026-01-01").cast("date")).alias("s")).collect()]
    assert [[f.title for f in s.findings] for s in out] == [
        ["Credential Validity Confirmed", "Passport Identifier Verified", "Subject Identity Record Formed", "ICAO Doc 9303 MRZ Optical Zone Validated"],
        ["Document Credential Expired", "Missing Visa Foil Identifier", "Visa Classification: T"],
        ["Cryptographic Document Enclave Ingestion"],
        ["Future Date of Birth Anomaly", "Missing Mandatory Passport Identifier"],
    ]
    assert [s.confidence for s in out] == [0.96, 0.98, 0.96, 0.98] and [s.document_type for s in out] == ["PASSPORT", "OTHER", "OTHER", "PASSPORT"]
    assert [s.recommendations for s in out] == [[ADVICE[1]], [ADVICE[0]], [ADVICE[1]], [ADVICE[1]]]
    assert [[i.indicator for i in s.indicators] for s in out] == [["VERIFIED_CREDENTIAL_STRUCTURE"], ["EXPIRED_DOCUMENT"], ["VERIFIED_CREDENTIAL_STRUCTURE"], ["FUTURE_DOB_FRAUD_RISK", "MISSING_PASSPORT_NUMBER"]]
    assert out[0].findings[3].evidence == "L1 | L2" and "with standard entry" in out[1].findings[2].description
