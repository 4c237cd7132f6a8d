"""Checksums and field rules of identity documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplication in the dihedral group D5, and the position permutation of the Verhoeff scheme.
VERHOEFF_D = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))
#: State codes of driving licences.
STATES = ("AN", "AP", "AR", "AS", "BR", "CH", "CG", "DD", "DL", "DN", "GA", "GJ", "HR", "HP", "JH", "JK", "KA", "KL", "LA", "LD", "MP", "MH", "MN", "ML", "MZ", "NL", "OD", "OR", "PB", "PY", "RJ", "SK", "TN", "TS", "TR", "UP", "UK", "UA", "WB")
#: Those of them that rulesets don't know.
OLD_STATES = ("OR", "UA")
#: Spellings of a nationality and the code they stand for.
NATIONALITIES = {"IND": ("IND", "INDIAN", "INDIA"), "USA": ("USA", "UNITEDSTATES", "AMERICAN"), "GBR": ("GBR", "BRITISH", "UNITEDKINGDOM"), "CAN": ("CAN", "CANADA", "CANADIAN")}


def icao_digit(text: Column) -> Column:
    """Check digit of a machine-readable field: digits count as they are, letters from 10, anything else 0, with weights 7, 3, 1 in turn."""
    worth = F.create_map(*[F.lit(x) for k, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for x in (c, k)])
    places = F.transform(F.split(F.upper(text), ""), lambda c, i: F.coalesce(F.element_at(worth, c), F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10


def icao_digit_plain(text: Column) -> Column:
    """``icao_digit`` of text that is upper case, by the characters' codes: no table is looked up."""
    code = lambda c: F.ascii(c)
    worth = lambda c: F.when((c >= "0") & (c <= "9"), code(c) - 48).when((c >= "A") & (c <= "Z"), code(c) - 55).otherwise(0)
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    return F.aggregate(F.transform(F.split(text, ""), lambda c, i: worth(c) * weight(i)), F.lit(0), lambda a, x: a + x) % 10


def digit_accepted(found: Column, expected: Column, mode: str = "strict") -> Column:
    """Whether a document number's check digit holds. ``strict``: equal. ``filler``: or a filler for 0. ``old``: or any filler. ``new``: or a filler or 0."""
    same = found == expected.cast("string")
    more = {"strict": F.lit(False), "filler": (found == "<") & (expected == 0), "old": found == "<", "new": found.isin("<", "0")}
    return same | more[mode]


def verhoeff_valid(number: Column) -> Column:
    """Twelve digits (white space aside) that the Verhoeff scheme carries to 0; null counts as invalid."""
    d, p = (F.array(*[F.array(*[F.lit(x) for x in row]) for row in t]) for t in (VERHOEFF_D, VERHOEFF_P))
    clean = F.regexp_replace(number, r"\s+", "")
    digits = F.transform(F.split(F.reverse(F.when(clean.rlike(r"^\d{12}$"), clean)), ""), lambda c, i: F.get(F.get(p, (i % 8).cast("int")), c.cast("int")))
    return F.coalesce(F.aggregate(digits, F.lit(0), lambda a, x: F.get(F.get(d, a), x)) == 0, F.lit(False))


def aadhaar_rule(number: Column) -> Column:
    """The rule a national number breaks, or null: presence, prefix, checksum, shape (masked numbers pass)."""
    clean = F.regexp_replace(number, r"\s+", "")
    twelve = clean.rlike(r"^\d{12}$")
    return (
        F.when(F.coalesce(number, F.lit("")) == "", "MISSING_AADHAAR_IDENTIFIER")
        .when(twelve & clean.rlike("^[01]"), "AADHAAR_INVALID_PREFIX")
        .when(twelve & ~verhoeff_valid(clean), "VERHOEFF_CHECKSUM_FAILURE")
        .when(~twelve & ~clean.rlike(r"^[xX*]{8}\d{4}$"), "NATIONAL_ID_FORMAT_MISMATCH")
    )


def licence_rule(number: Column) -> Column:
    """The rule a driving licence number breaks, or null."""
    clean = F.upper(F.regexp_replace(number, r"[\s-]", ""))
    good = clean.rlike(r"^[A-Z]{2}\d{13,15}$") & F.substring(clean, 1, 2).isin(*STATES)
    return F.when(F.coalesce(number, F.lit("")) == "", "MISSING_LICENSE_IDENTIFIER").when(~good, "DRIVING_LICENSE_FORMAT_MISMATCH")


def canonical_nationality(text: Column) -> Column:
    clean = F.upper(F.regexp_replace(text, r"[\s<]", ""))
    chain = clean
    for code, names in NATIONALITIES.items():
        chain = F.when(clean.isin(*names), code).otherwise(chain)
    return chain


def noisy_nationality(text: Column) -> Column:
    """A label or a fragment rather than a nationality."""
    clean = F.lower(F.trim(text))
    noise = F.length(clean) < 2
    for word in ("/", "surname", "given", "name", "nom"):
        noise = noise | F.contains(clean, F.lit(word))
    return F.coalesce(noise, F.lit(False))


def numbers_differ(a: Column, b: Column) -> Column:
    """Both present and not the same, spaces, fillers and case aside."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"[\s<]", ""))
    return F.coalesce(norm(a) != norm(b), F.lit(False))


def names_differ(a: Column, b: Column) -> Column:
    """Both have words and share none."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Z]", " "), r"\s+"), lambda w: w != "")
    return F.coalesce((F.size(words(a)) > 0) & (F.size(words(b)) > 0) & ~F.arrays_overlap(words(a), words(b)), F.lit(False))
