"""Visual zones of visas, national identities, licences and permits: per field the first line of the text that shows it, with a confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.dates import standard_date

#: What a date after a label looks like.
_DATE = r"([0-9A-Za-z/\-.\s]{8,15})"
#: Words that are no part of a holder's name in a licence.
LICENCE_NOISE = (
    "SIGNATURE", "HOLDER", "HOLDER'S SIGNATURE", "SIGN", "LICENCE", "LICENSE", "DRIVING", "UNION", "INDIAN", "GUJARAT", "MAHARASHTRA", "GOVERNMENT", "STATE", "AUTHORITY", "TRANSPORT", "MINISTRY", "MORTH", "SARATHI",
    "SON", "DAUGHTER", "WIFE", "S/O", "D/O", "W/O", "DATE", "ISSUE", "EXPIRY", "VALIDITY", "CLASS", "ADDRESS", "BLOOD", "GROUP", "DONOR",
)
#: Confidence of dates that only their order names.
ORDERED = 0.90
_ANY_DATE = r"\b(\d{2}[/\-.]\d{2}[/\-.]\d{4})\b"


def _upper(v: Column, _: int) -> Column:
    return F.upper(v)


def _trimmed(v: Column, _: int) -> Column:
    return trimmed(v)


def _name(v: Column, _: int) -> Column:
    return F.upper(trimmed(v))


def _number(v: Column, _: int) -> Column:
    return F.upper(F.regexp_replace(v, r"[\s\-]", ""))


def _entries(v: Column, _: int) -> Column:
    raw = F.upper(v)
    return F.when(raw.contains("MULT") | (raw == "M"), "MULTIPLE").when(raw.contains("SING") | raw.isin("01", "1"), "SINGLE").when(raw.contains("DOUB") | raw.isin("02", "2"), "DOUBLE").otherwise(raw)


def _sex(v: Column, _: int) -> Column:
    raw = F.upper(v)
    return F.when(raw.startswith("M"), "M").when(raw.startswith("F"), "F").otherwise(raw)


@dataclass(frozen=True)
class Shown:
    """A field: patterns that a line is tried with in turn (group 1 is the value), confidence, what becomes of the value, and a pattern of values that are none."""

    patterns: tuple[str, ...]
    confidence: float
    clean: Callable[[Column, int], Column] = standard_date
    drop: str | None = None


#: Labels and shapes of the fields, in any case, and their confidence.
VISA = {
    "visa_number": Shown((r"(?i)(?:visa\s*(?:no|number|#)?[:\s]+)([A-Z0-9\-]{6,16})", r"(?i)(?:control\s*number[:\s]+)([A-Z0-9\-]{6,16})", r"(?i)\b(V[0-9]{7,9})\b"), 0.92, _upper),
    "visa_type": Shown((r"(?i)(?:visa\s*type|type\s*of\s*visa|category|class)[:\s]+([A-Za-z0-9/\-\s]{2,20})", r"(?i)\b(B1/B2|TOURIST|BUSINESS|STUDENT|SCHENGEN|WORK\s*PERMIT|DIPLOMATIC)\b"), 0.90, _name),
    "entry_validation": Shown((r"(?i)(?:entries|number\s*of\s*entries|entry\s*validation)[:\s]+([A-Za-z0-9]+)", r"(?i)\b(MULTIPLE|SINGLE|DOUBLE|MULT|01|02|M)\b"), 0.91, _entries),
    "stay_duration": Shown((r"(?i)(?:duration\s*of\s*stay|stay\s*duration|stay)[:\s]+([0-9]+\s*(?:days?|months?|years?))", r"(?i)\b([0-9]{1,3}\s*DAYS)\b"), 0.90, _trimmed),
    "valid_from": Shown((rf"(?i)(?:valid\s*from|issue\s*date|from)[:\s]+{_DATE}",), 0.89),
    "valid_until": Shown((rf"(?i)(?:valid\s*until|expiry\s*date|expiration|until)[:\s]+{_DATE}",), 0.89),
    "date_of_birth": Shown((rf"(?i)(?:date\s*of\s*birth|dob|birth\s*date)[:\s]+{_DATE}",), 0.89),
    "holder_name": Shown((r"(?i)(?:name\s*of\s*bearer|bearer|holder|name|full\s*name)[:\s]+([A-Za-z\s.\-]{3,40})",), 0.87, _trimmed, r"(?i)visa|passport|embassy|consulate|department"),
    "nationality": Shown((r"(?i)(?:nationality|citizenship)[:\s]+([A-Za-z\s]{3,30})",), 0.88, _name, r"(?i)visa|type|passport"),
    "gender": Shown((r"(?i)(?:sex|gender|sexe)[:\s]+([MFX]|MALE|FEMALE)",), 0.90, _sex),
    "passport_number": Shown((r"(?i)(?:passport\s*(?:no|number)?|pp\s*no)[:\s]+([A-Z0-9]{7,10})",), 0.90, _upper),
}
NATIONAL_ID = {
    "id_number": Shown((r"(?i)\b([A-Z]{2}[\s\-]?[0-9]{2}[\s\-]?(?:19|20)[0-9]{2}[\s\-]?[0-9]{7})\b", r"(?i)(?:id\s*(?:no|number|#)|license\s*(?:no|number|#)|dl\s*no)[:\s]+([A-Z0-9\s\-]{5,20})", r"(?i)\b([A-Z]{2}[0-9]{13})\b", r"\b([0-9]{4}\s*[0-9]{4}\s*[0-9]{4})\b"), 0.95, _number),
    "full_name": Shown((r"(?i)(?:Name|Full\s*Name|Naam)\s*[:\s\-]+([A-Za-z\s.\-]{3,40})", r"(?i)^Name\s*:\s*([A-Za-z\s.\-]{3,40})"), 0.95, _name, "(?i)" + "|".join(LICENCE_NOISE) + r"|^\s*\S{0,2}\s*$"),
    "date_of_birth": Shown((r"(?i)(?:Date\s*Of\s*Birth|DOB|Birth\s*Date|Janm\s*Tithi)\s*[:\s\-]*" + _DATE,), 0.94),
    "date_of_issue": Shown((r"(?i)(?:Issue\s*Date|Date\s*Of\s*First\s*Issue|Date\s*of\s*Issue|Issued\s*On|DOI|Issue)\s*[:\s\-]*" + _DATE,), 0.92),
    "date_of_expiry": Shown((r"(?i)(?:Validity\s*(?:\(\s*[A-Z]+\s*\))?|Valid\s*(?:Till|Upto|Until)|Expiry\s*Date|Date\s*of\s*Expiry|Expires|EXP)\s*[:\s\-]*" + _DATE,), 0.92),
    "license_class": Shown((r"(?i)\b(LMV|MCWG|MCWOG|HPMV|HTV|HGV|MGV|LPV|LDRXCV|ADAPT|TR|NT)\b",), 0.90, _upper),
}
PERMIT = {
    "permit_number": Shown((r"(?i)(?:eILP\s*no|ILP\s*no|permit\s*(?:no|number|#)?|authorization\s*(?:no|#)?|pass\s*no|work\s*permit\s*no)[:\s]+([A-Z0-9\-_/]{5,25})", r"(?i)\b(WP-[0-9]{5,10}|PERMIT-[0-9A-Z\-]{4,12}|[0-9]{12,20})\b"), 0.94, _upper),
    "permit_type": Shown((r"(?i)(?:permit\s*type|type\s*of\s*(?:permit|visit)|category|class)[:\s]+([A-Za-z0-9/\-\s]{3,35})", r"(?i)\b(SINGLE|MULTIPLE|TEMPORARY|INNER\s*LINE\s*PERMIT|WORK\s*PERMIT|BORDER\s*TRANSIT|RESIDENCE\s*PERMIT|SPECIAL\s*ENTRY\s*AUTHORIZATION|BUSINESS|TOURIST)\b"), 0.90, _name),
    "holder_name": Shown((r"(?i)^(?:name|holder|full\s*name|authorized\s*individual)[:\s]+([A-Za-z\s.\-]{3,40})$", r"(?i)\bName\s*[:\s]+([A-Za-z\s.\-]{3,40})\b"), 0.90, _trimmed, r"(?i)permit|authority|department|ministry|republic|immigration|government|arunachal|caution"),
    "date_of_birth": Shown((rf"(?i)(?:date\s*of\s*birth|dob|birth\s*date)[:\s]+{_DATE}",), 0.91),
    "authorized_port": Shown((r"(?i)(?:check\s*gate|port\s*of\s*entry|authorized\s*zone|checkpoint|port|zone)[:\s]+([A-Za-z0-9\s,.\-]{3,50})",), 0.89, _name),
    "place_of_visit": Shown((r"(?i)(?:place\s*of\s*visit|destination|visit\s*location)[:\s]+([A-Za-z0-9\s,.\-]{3,40})",), 0.90, _name),
    "valid_from": Shown((rf"(?i)(?:date\s*of\s*visit|date\s*of\s*issue|issue\s*date|valid\s*from|issued)[:\s]+{_DATE}",), 0.89),
    "valid_until": Shown((rf"(?i)(?:date\s*of\s*return|return\s*date|valid\s*until|expiry\s*date|expires|valid\s*upto|until)[:\s]+{_DATE}",), 0.89),
    "issuing_authority": Shown((r"(?i)(?:issuing\s*authority|issued\s*by|authority|place\s*of\s*issue)[:\s]+([A-Za-z0-9\s.\-]{3,40})", r"(?i)(DC\s*Lower\s*Subansiri|Government\s*of\s*Arunachal\s*Pradesh|Department\s*of\s*Immigration|Border\s*Security\s*Agency|Ministry\s*of\s*Interior)"), 0.91, _trimmed),
}
#: Fields of each zone that are another field's value under a further name, and those no line ever shows.
TWINS = {"VISA": {"date_of_expiry": "valid_until", "full_name": "holder_name"}, "NATIONAL_ID": {"license_number": "id_number", "name": "full_name", "vehicle_class": "license_class"}, "PERMIT": {}}
UNSHOWN = {"VISA": (), "NATIONAL_ID": ("address", "nationality"), "PERMIT": ("stay_duration", "employer_or_sponsor", "status")}
ZONES = {"VISA": VISA, "NATIONAL_ID": NATIONAL_ID, "PERMIT": PERMIT}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The trimmed lines of a text that aren't empty; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda v: v != "")


def first_match(line: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that the line has a match of, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])


def _found(value: Column, confidence: float) -> Column:
    return F.struct(value.cast("string").alias("value"), F.lit(confidence).alias("confidence"))


def shown(of: Column, field: Shown, pivot: int) -> Column:
    """The field's value on the first of the lines ``of`` that shows one, as struct (value, confidence); null and 0 where none does. A line whose first match is dropped doesn't count."""
    values = F.transform(of, lambda line: first_match(line, field.patterns))
    kept = F.filter(values, lambda v: v.isNotNull() & ~v.rlike(field.drop) if field.drop else v.isNotNull())
    first = F.transform(F.slice(kept, 1, 1), lambda v: _found(field.clean(v, pivot), field.confidence))
    return F.coalesce(F.get(first, F.lit(0)), _found(F.lit(None), 0.0))


def zone(docs: DataFrame, text: str, kind: str, pivot: int) -> DataFrame:
    """``docs`` with all fields of the visual zone of a VISA, NATIONAL_ID (or licence) or PERMIT, found in the column ``text``, each a struct (value, confidence).

    Dates take the form yyyy-mm-dd where they have a known one; ``pivot`` is the last two-digit year of this century. In a NATIONAL_ID dates without a
    label are told by their order: of three different ones or more the first is the birth, the second the issue, the third the expiry, of two the
    first is the birth and the second the expiry. A null text has no fields. Columns of ``docs`` stay; they may not begin with two underscores.
    """
    one = docs.withColumns({"__lines": lines(F.col(text)), "__every": F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_ANY_DATE), 1)})
    found = one.withColumns({f"__{name}": shown(F.col("__lines"), field, pivot) for name, field in ZONES[kind].items()})
    if kind == "NATIONAL_ID":
        found = found.withColumn("__dates", F.array_sort(F.array_distinct(F.transform("__every", lambda d: standard_date(d, pivot)))))
        n, at = F.size("__dates"), lambda i: F.get("__dates", i)
        told = {"date_of_birth": at(F.lit(0)), "date_of_issue": F.when(n >= 3, at(F.lit(1))), "date_of_expiry": at(F.least(F.lit(2), n - 1))}
        found = found.withColumns({f"__{name}": F.when(F.col(f"__{name}")["value"].isNull() & (n >= 2) & date.isNotNull(), _found(date, ORDERED)).otherwise(F.col(f"__{name}")) for name, date in told.items()})
    shown_ = {name: F.col(f"__{name}") for name in ZONES[kind]}
    every = shown_ | {twin: shown_[name] for twin, name in TWINS[kind].items()} | {name: _found(F.lit(None), 0.0) for name in UNSHOWN[kind]}
    return found.select(*docs.columns, *[c.alias(name) for name, c in every.items()])
