"""Labelled fields of a visual zone: per field the first line of the text that shows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.dates import standard_date

#: Labels of the fields of a passport's visual zone and the shape of what follows them.
PASSPORT = {
    "passport_number": r"(?i)(?:passport\s*(?:no|number|#)?|no\s*du\s*passeport)[:\s]+([A-Z0-9]{7,10})",
    "surname": r"(?i)(?:surname\s*(?:/\s*nom)?|last\s*name)[:\s]+([A-Za-z\s.\-]{2,40})",
    "given_names": r"(?i)(?:given\s*names?\s*(?:\(s\))?\s*(?:/\s*pr[eé]noms?)?|first\s*name)[:\s]+([A-Za-z\s.\-]{2,40})",
    "nationality": r"(?i)(?:nationality\s*(?:/\s*nationalit[eé])?|citizenship)[:\s]+([A-Za-z\s]{3,30})",
    "sex": r"(?i)(?:sex\s*(?:/\s*sexe)?|gender)[:\s]+(MALE|FEMALE|HOMME|FEMME|[MFX])\b",
    "date_of_birth": r"(?i)(?:date\s*of\s*birth|dob|birth\s*date|date\s*de\s*naissance)[:\s]+([0-9A-Za-z/\-.\s]{8,15})",
    "date_of_issue": r"(?i)(?:date\s*of\s*issue|issue\s*date|date\s*de\s*d[eé]livrance|issued\s*on)[:\s]+([0-9A-Za-z/\-.\s]{8,15})",
}
#: Words that are labels, not values.
NOISE = r"(?i)^(nom|surname|given|name|passport|number|republic|identity|department|country|nationality|type|code|p|s)$"


def first_shown(text: Column, pattern: str) -> Column:
    """The value on the first line that matches and isn't itself a label, or null."""
    found = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(F.regexp_extract(line, pattern, 1), r"^[/:\s.\-]+", "")))
    return F.get(F.filter(found, lambda v: (v != "") & ~v.rlike(NOISE)), F.lit(0))


def passport_zone(text: Column, pivot: int) -> Column:
    """The visual zone as a struct; dates in one form, the sex as a letter."""
    raw = {name: first_shown(text, pattern) for name, pattern in PASSPORT.items()}
    sex = F.upper(raw["sex"])
    raw["passport_number"] = F.upper(raw["passport_number"])
    raw["sex"] = F.when(sex.rlike("^(M|HOMME)"), "M").when(sex.rlike("^F"), "F").when(sex.isNotNull(), "X")
    for name in ("date_of_birth", "date_of_issue"):
        raw[name] = standard_date(raw[name], pivot)
    full = F.when(raw["surname"].isNotNull() & raw["given_names"].isNotNull(), F.concat_ws(" ", raw["given_names"], raw["surname"]))
    return F.struct(*[c.alias(n) for n, c in raw.items()], full.alias("full_name"))
