"""Text cleaning and keyword classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a document type, types in the order they are tried.
KEYWORDS = {
    "DRIVING_LICENSE": ("DRIVING LICENCE", "DRIVING LICENSE", "UNION DRIVING", "LICENCE TO DRIVE", "LICENSE TO DRIVE", "DL NO", "DL.NO", "D.L. NO", "SARATHI", "MORTH", "VALIDITY ( NT )", "VALIDITY ( TR )", "VALIDITY(NT)", "VALIDITY(TR)", "DATE OF FIRST ISSUE", "HOLDER'S SIGNATURE", "SON/DAUGHTER/WIFE OF"),
    "PERMIT": ("INNER LINE PERMIT", "EILP", "ILP NO", "ARUNACHAL PRADESH", "NAGALAND", "MIZORAM", "MANIPUR", "LADAKH", "LAKSHADWEEP", "TEMPORARY SINGLE", "PERMIT TYPE", "PLACE OF VISIT", "CHECK GATE", "VEHICLE PERMIT", "STAGE CARRIAGE", "CONTRACT CARRIAGE", "GOODS CARRIAGE", "PERMIT NO", "FORM P.", "ALL INDIA TOURIST PERMIT"),
    "NATIONAL_ID": ("AADHAAR", "UNIQUE IDENTIFICATION", "PEHCHAN", "UIDAI"),
    "VISA": ("VISA", "VALIDE POUR", "ENTRY PERMIT"),
    "PASSPORT": ("PASSPORT", "REPUBLIC OF"),
}
#: Patterns that do, over the text and over the file name.
PATTERNS = {"DRIVING_LICENSE": r"\b[A-Z]{2}[0-9]{2}\s*(?:19|20)[0-9]{2}[0-9]{7}\b", "NATIONAL_ID": r"\b\d{4}\s+\d{4}\s+\d{4}\b", "PASSPORT": r"P<[A-Z]{3}"}
FILE_PATTERNS = {"DRIVING_LICENSE": r"(?i)^(?:.*[\\/])?DL[0-9_-]*", "PERMIT": r"(?i)^(?:.*[\\/])?permit[0-9_-]*"}


def normalise(text: Column) -> Column:
    """No control characters, plain quotes and dashes, single spaces, at most one blank line in a row."""
    plain = F.trim(F.translate(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), "‘’“”–—", "''\"\"--"))
    lines = F.regexp_replace(F.regexp_replace(plain, "\r\n?", "\n"), "[\t\f]", " ")
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, " {2,}", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit(""))


def document_type(text: Column, filename: Column) -> Column:
    """The first type with a keyword or pattern in the text or file name, or UNKNOWN."""
    pool = F.upper(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(filename, F.lit(""))))
    chain = None
    for kind, words in KEYWORDS.items():
        hit = reduce(lambda a, b: a | b, [F.contains(pool, F.lit(w)) for w in words])
        if kind in PATTERNS:
            hit = hit | pool.rlike(PATTERNS[kind])
        if kind in FILE_PATTERNS:
            hit = hit | F.coalesce(filename.rlike(FILE_PATTERNS[kind]), F.lit(False))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("UNKNOWN")
