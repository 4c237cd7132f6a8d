"""Fields of a document's text regions in reading order: bilingual cleaning, the value a label stands for, and the fields of passports, visas and licences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.zones import LICENCE_NOISE, trimmed

#: Texts that are labels in either language, not values.
NOISE = (
    "NOM", "PRÉNOMS", "PRENOMS", "SEXE", "NATIONALITÉ", "NATIONALITE", "DATE DE NAISSANCE", "LIEU DE NAISSANCE", "LIEU DE DELIVRANCE", "LIEU DE DÉLIVRANCE", "DATE DE DELIVRANCE", "DATE DE DÉLIVRANCE",
    "DATE D'EXPIRATION", "DATE D'EMISSION", "NO DU PASSEPORT", "PASSEPORT", "TYPE", "CODE", "SURNAME", "GIVEN NAME", "GIVEN NAMES", "FIRST NAME", "LAST NAME", "SEX", "GENDER", "DOB", "DATE OF BIRTH",
    "DATE OF ISSUE", "DATE OF EXPIRY", "PLACE OF BIRTH", "PLACE OF ISSUE", "PASSPORT NO", "PASSPORT NUMBER", "HOLDER", "SIGNATURE", "(S)", "S", "P", "IND",
)
#: Second-language subtitles, in any case, in the order they are taken out.
SUBTITLES = (
    r"/\s*LIEU\s*DE\s*(?:NAISSANCE|D[EÉ']?LIVRANCE|DLIVRANCE)", r"/\s*DATE\s*DE\s*(?:NAISSANCE|D[EÉ']?LIVRANCE|DLIVRANCE)", r"/\s*DATE\s*D['\s]?(?:EXPIRATION|EMISSION)", r"/\s*NO\s*DU\s*PASSEPORT",
    r"/\s*CODE\s*DU\s*PAYS", r"/\s*CODE\s*PAYS", r"/\s*NATIONALIT[EÉ]", r"/\s*PR[EÉ]NOMS?", r"/\s*NOM", r"/\s*SEXE", r"/\s*TYPE",
)
PARENTHESES, LEADING = r"\([^)]*\)", r"^[/:\s.\-]+"
#: Labels of the fields, upper case, in the order they are tried in a region.
LABELS = {
    "passport_number": ("PASSPORT NO", "PASSPORT NUMBER", "NO DU PASSEPORT", "PASSPORT NO.", "PASSPORT#"),
    "sex": ("SEX", "SEXE", "GENDER"),
    "surname": ("SURNAME", "NOM", "LAST NAME", "SUR NAME"),
    "given_name": ("GIVEN NAME", "GIVEN NAMES", "PRÉNOMS", "PRENOMS", "FIRST NAME"),
    "full_name": ("FULL NAME", "NAME", "HOLDER"),
    "nationality": ("NATIONALITY", "NATIONALITÉ", "NATIONALITE", "CITIZENSHIP", "NATIONAL"),
    "date_of_birth": ("DOB", "DATE OF BIRTH", "DATE DE NAISSANCE", "BIRTH DATE", "BORN"),
    "date_of_issue": ("DATE OF ISSUE", "DATE DE DELIVRANCE", "ISSUE DATE", "DATE D'EMISSION", "ISSUED ON"),
    "date_of_expiry": ("EXPIRY", "EXPIRATION", "EXP DATE", "DATE OF EXPIRY", "DATE D'EXPIRATION", "VALID UNTIL", "VALID UPTO", "EXPIRY DATE"),
    "place_of_birth": ("PLACE OF BIRTH", "LIEU DE NAISSANCE", "BIRTH PLACE", "PLACE OF BIRT"),
    "place_of_issue": ("PLACE OF ISSUE", "LIEU DE DELIVRANCE", "LIEU DE DÉLIVRANCE", "LIEU DE D'ELIVRANCE", "LIEU DE DLIVRANCE", "ISSUE PLACE", "ISSUED AT", "PLACE OF ISSUANCE", "PLACE OF ISUE"),
}
VISA_LABELS = {
    "visa_number": ("VISA NUMBER", "VISA NO.", "VISA NO", "VISA#", "CONTROL NUMBER", "CONTROL NO", "ETA"),
    "visa_type": ("TYPE OF VISA", "VISA TYPE", "CATEGORY", "CLASS", "TYPE"),
    "entry_validation": ("NUMBER OF ENTRIES", "NO OF ENTRIES", "NO. OF ENTRIES", "ENTRIES", "ENTRY"),
    "stay_duration": ("DURATION OF STAY", "STAY DURATION", "DURATION", "PERIOD", "VALIDITY", "STAY"),
    "bearer": ("NAME OF BEARER", "FULL NAME", "BEARER", "NAME", "HOLDER"),
    "surname": ("SURNAME", "LAST NAME"),
    "given_name": ("GIVEN NAME", "GIVEN NAMES", "FIRST NAME"),
    "sex": ("SEX", "GENDER", "SEXE"),
    "nationality": ("NATIONALITY", "CITIZENSHIP", "NATIONAL"),
    "date_of_birth": ("DOB", "DATE OF BIRTH", "BIRTH DATE", "BORN"),
    "date_of_issue": ("VALID FROM", "DATE OF ISSUE", "ISSUE DATE", "FROM", "ISSUED ON"),
    "date_of_expiry": ("VALID UNTIL", "EXPIRY DATE", "EXPIRATION", "EXPIRY", "UNTIL", "DATE OF EXPIRY"),
    "passport_number": ("PASSPORT NO", "PASSPORT NUMBER", "PP NO", "DOC NO", "PASSPORT"),
}
LICENCE_LABELS = {
    "name": ("NAME", "NAAM"),
    "date_of_birth": ("DOB", "DATE OF BIRTH", "BIRTH DATE", "BIRTH"),
    "date_of_issue": ("ISSUE DATE", "DATE OF FIRST ISSUE", "DATE OF ISSUE", "ISSUED ON", "DOI", "ISSUE"),
    "date_of_expiry": ("VALIDITY ( NT )", "VALIDITY ( TR )", "VALIDITY(NT)", "VALIDITY(TR)", "VALIDITY", "VALID TILL", "VALID UPTO", "EXPIRY", "EXP", "EXPIRES"),
    "vehicle_class": ("CLASS", "VEHICLE CLASS", "COV", "CATEGORY"),
}
#: Shapes of values, in any case where marked.
NUMBER, SEX, SEX_SHOWN = r"\b([A-Z]{1,2}[0-9]{6,7})\b", r"\b(MALE|FEMALE|HOMME|FEMME|[MFX])\b", r"(?i)\b(?:SEX|SEXE|GENDER)\b\s*[:/]*\s*(?:SEXE\s*[:/]*)?\s*\b(MALE|FEMALE|HOMME|FEMME|[MFX])\b"
DAY, NAMED_DAY = r"\b(\d{2}[/\-.]\d{2}[/\-.]\d{4})\b", r"\b(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\b"
VISA_NUMBER, STAY = r"\b([A-Z0-9]{8,12}|\d{8})\b", r"(?i)\b([1-9][0-9]{0,3}\s*(?:day|days|month|months|year|years))\b"
LICENCE_NUMBER, CLASSES = r"(?i)\b([A-Z]{2}[\s\-]?[0-9]{2}[\s\-]?(?:19|20)[0-9]{2}[\s\-]?[0-9]{7})\b", r"(?i)\b(LMV|MCWG|MCWOG|HPMV|HTV|HGV|MGV|LPV|LDRXCV|ADAPT|TR|NT)\b"
LICENCE_NAME, LICENCE_NAME_ANYWHERE = r"(?i)^(?:Name|Full\s*Name|Naam)\s*[:\s\-]+([A-Za-z\s.\-]{3,40})$", r"(?i)\bName\s*[:\s\-]+([A-Z\s.\-]{3,40})\b"
LICENCE_DAYS = {
    "date_of_birth": r"(?i)(?:Date\s*Of\s*Birth|DOB|Birth\s*Date|Janm\s*Tithi)\s*[:\s\-]*(\d{2}[/\-.]\d{2}[/\-.]\d{4})",
    "date_of_issue": r"(?i)(?:Issue\s*Date|Date\s*Of\s*First\s*Issue|Date\s*of\s*Issue|Issued\s*On|DOI)\s*[:\s\-]*(\d{2}[/\-.]\d{2}[/\-.]\d{4})",
    "date_of_expiry": r"(?i)(?:Validity\s*(?:\(\s*[A-Z]+\s*\))?|Valid\s*(?:Till|Upto|Until)|Expiry\s*Date|Date\s*of\s*Expiry|Expires)\s*[:\s\-]*(\d{2}[/\-.]\d{2}[/\-.]\d{4})",
}
#: Where a value of a nationality, a place of birth and one of issue ends.
ENDS = {"nationality": r"(?i)\b(?:SEX|GENDER|DOB|DATE|BIRTH|EXPIRY|ISSUE|SURNAME|GIVEN|NAME)\b", "place_of_birth": r"(?i)\b(?:PLACE|ISSUE|DATE|EXPIRY|SEX|DOB)\b", "place_of_issue": r"(?i)\b(?:PLACE|BIRTH|DATE|EXPIRY|SEX|DOB)\b"}
PLACE_ANYWHERE, PLACE_ENDS = r"(?i)(?:PLACE\s*OF\s*ISSUE|LIEU\s*DE\s*D[EÉ']?LIVRANCE|ISSUE\s*PLACE|ISSUED\s*AT)[:\s/]*([A-Z\s,.\-]{2,40})", r"(?i)\b(?:DATE|EXPIRY|BIRTH|ISSUE|SEX|DOB|PASSPORT)\b"
#: Words that spoil a passport's names where they are one, or begin or end one; words no licence's name holds; names that are none.
NAME_NOISE = ("/", "NOM", "GIVEN", "SURNAME", "PRÉNOMS", "PRENOMS", "NAME", "PASSPORT", "REPUBLIC", "INDIA", "INDIAN", "NATIONALITY", "SEX", "SEXE", "DATE", "BIRTH", "EXPIRY", "ISSUE", "TYPE", "CODE", "HOLDER", "SIGNATURE", "(S)", "S", "P", "IND")
LICENCE_PARTS = ("SIGNATURE", "LICENCE", "LICENSE", "GOVERNMENT", "GUJARAT", "INDIAN UNION")
#: Words in a text that name a nationality, in the order they are looked for, what they say and how surely.
COUNTRIES = ((("INDIAN",), "INDIAN", 0.95), (("IND",), "IND", 0.90), (("USA", "UNITED STATES"), "USA", 0.85), (("CAN", "CANADA", "CANADIAN"), "CAN", 0.85), (("GBR", "BRITISH", "UNITED KINGDOM"), "GBR", 0.85))
#: Confidences of what is told otherwise than by a label.
BY_ORDER, BORN_BEFORE, ISSUED_LAST, EXPIRES_LATER, EXPIRES_LAST, PLACE_FOUND, CLASSES_FOUND, BOTH_NAMES = 0.99, 0.92, 0.88, 0.94, 0.85, 0.88, 0.95, 0.92


def _bound(value: Column, then) -> Column:
    """``then`` over a value that is worked out once, however often it is used, in functions over arrays too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null where it is empty or there is none."""
    return _bound(F.regexp_extract(text, pattern, 1), lambda v: F.when(v != "", v))


def clean_value(text: Column) -> Column:
    """A value without what is in parentheses, second-language subtitles and leading signs; empty for null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), PARENTHESES, "")
    without = lambda v: reduce(lambda v, p: F.regexp_replace(v, f"(?iu){p}", ""), SUBTITLES, v)
    # Every subtitle begins with a slash.
    return trimmed(F.regexp_replace(_bound(plain, lambda v: F.when(F.contains(v, F.lit("/")), without(v)).otherwise(v)), LEADING, ""))


def is_noise(text: Column) -> Column:
    """Whether a text is empty or only a label."""
    plain = trimmed(F.regexp_replace(F.regexp_replace(F.upper(trimmed(F.coalesce(text, F.lit("")))), PARENTHESES, ""), LEADING, ""))
    return plain.isin("", *NOISE)


def seen(regions: Column) -> Column:
    """An array of regions (struct of text and confidence, in reading order) prepared for ``labelled``: each with its upper-case text and, of the three after it, the first that is a value."""
    plain = F.transform(regions, lambda r: F.struct(r["text"].alias("text"), r["confidence"].cast("double").alias("confidence"), F.upper(r["text"]).alias("upper"), clean_value(r["text"]).alias("value")))
    fit = F.transform(plain, lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence"), r["upper"].alias("upper"), r["value"].alias("value"), (~is_noise(r["value"])).alias("fit")))
    after = lambda all_, i: F.get(F.filter(F.slice(all_, i + 2, F.lit(3)), lambda n: n["fit"]), F.lit(0))
    # Bound, since each region looks into the whole array.
    return _bound(fit, lambda all_: F.transform(all_, lambda r, i: F.struct(r["text"], r["confidence"], r["upper"], after(all_, i).alias("next"))))


def field(value: Column, confidence: Column, source: Column) -> Column:
    """A field as struct; null where there is no value."""
    return F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), source.cast("string").alias("source")))


def labelled(of: Column, labels: tuple[str, ...]) -> Column:
    """What the first label says, as struct (value, confidence, source) or null: the text after it in its region, else the region after it that is a value.

    ``of`` is an array made by ``seen``. Regions go in order, labels in order within a region; one that leads to no value is passed over.
    """

    def told(r: Column) -> Column:
        hits = F.filter(F.array(*map(F.lit, labels)), lambda label: F.contains(r["upper"], label))
        own = F.transform(hits, lambda label: clean_value(F.substring(r["text"], F.instr(r["upper"], label) + F.length(label), F.length(r["text"]))))
        below = field(r["next"]["value"], r["next"]["confidence"], r["next"]["text"])
        return F.transform(own, lambda v: F.when(~is_noise(v), field(v, r["confidence"], r["text"])).otherwise(below))

    return F.get(F.filter(F.flatten(F.transform(of, told)), lambda x: x.isNotNull()), F.lit(0))


def found_in(of: Column, pattern: str) -> Column:
    """Group 1 of the first region with a match, as a field."""
    matches = F.transform(of, lambda r: _bound(_found(r["text"], pattern), lambda v: field(v, r["confidence"], r["text"])))
    return F.get(F.filter(matches, lambda x: x.isNotNull()), F.lit(0))


def confidence_of(of: Column, text: Column) -> Column:
    """Confidence of the first region that holds a text; null where none does."""
    return F.get(F.filter(of, lambda r: F.contains(r["text"], text)), F.lit(0))["confidence"]


def searched(of: Column, raw: Column, pattern: str) -> Column:
    """Group 1 of the first match in a whole text, as a field with the confidence of the region that holds it."""
    return _bound(_found(raw, pattern), lambda v: field(v, confidence_of(of, v), v))


def dates_in(raw: Column) -> Column:
    """Days dd/mm/yyyy of a text (mm/dd where dd/mm is no day) by date, each spelling once, as structs of day and text."""
    part = lambda d, i: F.substring(d, *i)

    def parsed(d: Column) -> Column:
        a, b, year = part(d, (1, 2)), part(d, (4, 2)), part(d, (7, 4))
        day, month = F.when(b.cast("int") > 12, b).otherwise(a), F.when(b.cast("int") > 12, a).otherwise(b)
        return F.struct(F.concat_ws("-", year, month, day).try_cast("date").alias("day"), d.alias("text"))

    every = F.array_distinct(F.regexp_extract_all(raw, F.lit(DAY), 1))
    return F.array_sort(F.filter(F.transform(every, parsed), lambda d: d["day"].isNotNull() & (F.substring(d["text"], 7, 4) != "0000")))


def _map(name: Column, value) -> Column:
    """The field with its value changed; null where the value becomes null."""
    return _bound(name, lambda f: _bound(value(f["value"]), lambda new: F.when(new.isNotNull(), f.withField("value", new))))


def _sex(raw: Column) -> Column:
    return F.when(raw.startswith("M") | (raw == "HOMME"), "M").when(raw.startswith("F"), "F").otherwise("X")


def _shown_sex(v: Column) -> Column:
    shown = _found(trimmed(F.upper(F.regexp_replace(v, r"(?i)^[/\s]*SEXE\s*[:\s]*", ""))), SEX)
    return _bound(shown, lambda raw: F.when(raw.isNotNull(), _sex(raw)))


def passport_name(v: Column) -> Column:
    """A name as it is shown, or null: words that are labels, digits and single letters are none."""
    plain = F.upper(trimmed(F.regexp_replace(F.regexp_replace(v, PARENTHESES, ""), "/.*$", "")))
    words = "|".join(re.escape(n) for n in NAME_NOISE)
    return _bound(F.struct(v.alias("v"), plain.alias("plain")), lambda n: F.when((F.length(n["plain"]) >= 2) & ~n["plain"].rlike(rf"(?s)^(?:{words})(?: .*)?$|^.* (?:{words})$|[0-9]"), n["v"]))


def _spoken(v: Column) -> Column:
    return F.upper(trimmed(F.replace(F.regexp_replace(v, PARENTHESES, ""), F.lit("/"), F.lit(""))))


def _upto(v: Column, pattern: str) -> Column:
    return trimmed(F.split(v, pattern, 2)[0])


def _day_in(v: Column) -> Column:
    return F.coalesce(_found(v, DAY), _found(v, NAMED_DAY), trimmed(v))


def _dated(f: Column) -> Column:
    """A value that looks like a date: with a digit and a sign between parts."""
    return F.coalesce(f["value"].rlike(r"\d") & f["value"].rlike(r"[-/.]"), F.lit(False))


def _staged(docs: DataFrame, regions: str, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """``docs`` with __of (the prepared regions), __raw (the whole text) and, for each field, l_<field>: what its labels say. Stages are columns, so that nothing is worked out twice."""
    whole = docs.withColumn("__of", seen(F.coalesce(F.col(regions), F.array().cast("array<struct<text:string,confidence:double>>"))))
    return whole.withColumns({"__raw": F.array_join(F.transform("__of", lambda r: r["text"]), "\n"), **{f"__l_{n}": labelled(F.col("__of"), ls) for n, ls in labels.items()}})


def _finished(docs: DataFrame, kept: list[str], names: list[str]) -> DataFrame:
    return docs.select(*kept, *[F.col(f"__{n}").alias(n) for n in names])


def passport_fields(docs: DataFrame, regions: str, as_of: Column) -> DataFrame:
    """``docs`` with the fields of a passport's visual regions (array of text and confidence, in reading order), each struct (value, confidence, source) or null.

    A field is what its label says; a number, a nationality and a place of issue are otherwise searched in the whole text. Dates that no label shows as one are told by their order:
    of three or more the earliest is the birth, the next the issue, the last the expiry; of two the birth and the expiry; a single one is a birth if it is before ``as_of``. A row without regions has no fields.
    Columns of ``docs`` stay; they may not begin with two underscores.
    """
    c = lambda n: F.col(f"__{n}")
    one = _staged(docs, regions, LABELS)
    of, raw = c("of"), c("raw")
    days = ("date_of_birth", "date_of_issue", "date_of_expiry")
    anywhere = PLACE_ANYWHERE.replace("(?i)", "(?iu)")

    def country(v: Column) -> Column:
        told = lambda plain: F.when(plain.rlike("/|SURNAME|GIVEN|NAME|NOM|PASSPORT|CODE") | plain.isin("P", "TYPE"), None).when(plain.isin("IND", "INDIAN", "INDIA"), "INDIAN").when(F.length(plain) >= 2, plain)
        return _bound(F.upper(_upto(v, ENDS["nationality"])), told)

    two = one.withColumns({
        "__number": _map(c("l_passport_number"), lambda v: _found(F.replace(F.upper(v), F.lit(" "), F.lit("")), NUMBER)), "__other": searched(of, raw, NUMBER),
        "__shown": found_in(of, SEX_SHOWN), "__sex": _map(c("l_sex"), _shown_sex), "__last": _map(c("l_surname"), passport_name), "__first": _map(c("l_given_name"), passport_name), "__whole": _map(c("l_full_name"), passport_name),
        "__country": _map(c("l_nationality"), country), "__dates": dates_in(raw), **{f"__d_{n}": _map(c(f"l_{n}"), _day_in) for n in days},
        **{f"__p_{n}": _map(c(f"l_{n}"), lambda v, n=n: F.nullif(_upto(v, ENDS[n]), F.lit(""))) for n in ("place_of_birth", "place_of_issue")}, "__issued": F.nullif(_upto(F.regexp_extract(raw, anywhere, 1), PLACE_ENDS), F.lit("")), "__upper": F.upper(raw),
    })
    three = two.withColumns({"__surname": _map(c("last"), _spoken), "__given_name": _map(c("first"), _spoken), **{f"__q_{n}": _map(c(f"p_{n}"), passport_name) for n in ("place_of_birth", "place_of_issue")}, "__at": passport_name(c("issued"))})
    n, at = F.size("__dates"), lambda i: F.get("__dates", i)
    past = at(F.lit(0))["day"] < as_of
    ordered = {"date_of_birth": F.when((n >= 2) | ((n == 1) & past), at(F.lit(0))["text"]), "date_of_issue": F.when(n >= 3, at(F.lit(1))["text"]), "date_of_expiry": F.when((n >= 2) | ((n == 1) & ~past), at(n - 1)["text"])}
    surname, given = c("surname"), c("given_name")
    both = field(F.concat_ws(" ", given["value"], surname["value"]), F.least(F.coalesce(surname["confidence"], F.lit(0.9)), F.coalesce(given["confidence"], F.lit(0.9))), F.concat(surname["value"], F.lit(" / "), given["value"]))
    shout = lambda v: F.upper(trimmed(v))
    named = [F.when(c("upper").rlike("|".join(words)), field(F.lit(name), F.lit(sure), F.lit("Fallback raw search"))) for words, name, sure in COUNTRIES]
    four = three.withColumns({
        "__passport_number": F.coalesce(c("number"), c("other")), "__gender": F.coalesce(_map(c("shown"), lambda v: _sex(F.upper(v))), c("sex")), "__name": F.when(surname.isNotNull() & given.isNotNull(), both).otherwise(F.coalesce(given, surname, _map(c("whole"), shout))),
        "__nationality": F.coalesce(c("country"), *named), **{f"__{k}": F.when(date.isNotNull() & ~_dated(c(f"d_{k}")), field(date, F.lit(BY_ORDER), date)).otherwise(c(f"d_{k}")) for k, date in ordered.items()},
        "__place_of_birth": _map(c("q_place_of_birth"), shout), "__place_of_issue": F.coalesce(_map(c("q_place_of_issue"), shout), field(F.upper(c("at")), F.lit(PLACE_FOUND), F.regexp_extract(raw, anywhere, 0))),
    })
    return _finished(four, docs.columns, ["passport_number", "gender", "surname", "given_name", "name", "nationality", *days, "place_of_birth", "place_of_issue"])


def visa_fields(docs: DataFrame, regions: str) -> DataFrame:
    """``docs`` with the fields of a visa's visual regions, each struct (value, confidence, source) or null: what labels say; a number and a stay are otherwise searched in the whole text. Columns as in ``passport_fields``."""
    c = lambda n: F.col(f"__{n}")
    one = _staged(docs, regions, VISA_LABELS)
    nameless = lambda v, words: F.when(~F.lower(v).rlike("|".join(words)), F.upper(trimmed(v)))
    bare = lambda f: F.when(f.isNotNull(), f.withField("source", F.lit(None).cast("string")))
    two = one.withColumns({
        "__number": searched(c("of"), c("raw"), VISA_NUMBER), "__stay": searched(c("of"), c("raw"), STAY), **{f"__{n}": _map(c(f"l_{n}"), lambda v: nameless(v, ("visa", "passport", "republic"))) for n in ("surname", "given_name")},
        "__bearer": _map(c("l_bearer"), lambda v: nameless(v, ("visa", "passport", "republic", "consulate", "department", "embassy"))),
        "__gender": _map(c("l_sex"), lambda v: F.when(F.upper(v).startswith("M") | (F.upper(v) == "HOMME"), "M").when(F.upper(v).startswith("F"), "F").otherwise(F.upper(trimmed(v)))),
        "__nationality": _map(c("l_nationality"), lambda v: F.when(F.length(v) >= 2, F.upper(v))), "__passport_number": _map(c("l_passport_number"), F.upper),
        **{f"__{n}": c(f"l_{n}") for n in ("visa_type", "entry_validation", "date_of_birth", "date_of_issue", "date_of_expiry")},
    })
    both = field(F.concat_ws(" ", c("given_name")["value"], c("surname")["value"]), F.lit(BOTH_NAMES), F.lit(None))
    three = two.withColumns({"__visa_number": F.coalesce(c("l_visa_number"), bare(c("number"))), "__stay_duration": F.coalesce(c("l_stay_duration"), bare(c("stay"))), "__name": F.when(c("surname").isNotNull() & c("given_name").isNotNull(), both).otherwise(c("bearer"))})
    return _finished(three, docs.columns, ["visa_number", "visa_type", "entry_validation", "stay_duration", "name", "surname", "given_name", "gender", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "passport_number"])


def licence_name(v: Column) -> Column:
    """A personal name, or null: no signature or heading, three characters at least, nearly all letters, blanks and dots."""
    plain = F.upper(trimmed(v))
    noisy = lambda n: n.rlike("|".join(LICENCE_PARTS)) | n.isin(*LICENCE_NOISE)
    return _bound(plain, lambda n: F.when((F.length(n) >= 3) & ~noisy(n) & (F.length(F.regexp_replace(n, r"[^\p{L}\s.]", "")) >= F.length(n) * 0.85), n))


def licence_fields(docs: DataFrame, regions: str, as_of: Column) -> DataFrame:
    """``docs`` with the fields of a driving licence's regions, each struct (value, confidence, source) or null, dates as dd-mm-yyyy. Columns as in ``passport_fields``.

    Dates are those after a label in a region, else in what a label says, else of all dates of the text: the birth is the first before ``as_of``, the issue the last before it that isn't the birth (of two dates at least),
    the expiry the last one from then on, or the last of two at least. Classes are all that the text names, in order.
    """
    c = lambda n: F.col(f"__{n}")
    one = _staged(docs, regions, LICENCE_LABELS)
    of, raw, none = c("of"), c("raw"), F.lit(None).cast("string")
    dashed = lambda v: F.regexp_replace(v, "[./]", "-")
    shown = F.transform(of, lambda r: F.struct(_found(trimmed(r["text"]), LICENCE_NAME).alias("v"), r["confidence"], r["text"]))
    fit = F.transform(F.filter(shown, lambda r: r["v"].isNotNull()), lambda r: F.struct(licence_name(r["v"]).alias("value"), r["confidence"], r["text"].alias("source")))
    two = one.withColumns({
        "__found": searched(of, raw, LICENCE_NUMBER), "__line": F.get(F.filter(fit, lambda r: r["value"].isNotNull()), F.lit(0)), "__said": _map(c("l_name"), licence_name), "__anywhere": licence_name(_found(raw, LICENCE_NAME_ANYWHERE)), "__days": dates_in(raw),
        "__classes": F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(CLASSES), 1), F.upper)),
        **{f"__r_{n}": found_in(of, p) for n, p in LICENCE_DAYS.items()}, **{f"__y_{n}": _map(c(f"l_{n}"), lambda v: _found(v, DAY)) for n in LICENCE_DAYS},
    })
    days, n = c("days"), F.size("__days")
    first = lambda list_: F.get(list_, F.lit(0))["text"]
    last = lambda list_: F.try_element_at(list_, F.lit(-1))["text"]
    told = {k: _map(F.coalesce(c(f"r_{k}"), c(f"y_{k}")), dashed) for k in LICENCE_DAYS}
    three = two.withColumns({"__date_of_birth": F.coalesce(told["date_of_birth"], field(dashed(first(F.filter(days, lambda d: d["day"] < as_of))), F.lit(BORN_BEFORE), none)), "__later": last(F.filter(days, lambda d: d["day"] >= as_of))})
    four = three.withColumn("__before", last(F.filter(days, lambda d: (d["day"] < as_of) & (dashed(d["text"]) != F.coalesce(c("date_of_birth")["value"], F.lit(""))))))
    classes = field(F.array_join("__classes", ", "), F.lit(CLASSES_FOUND), none)
    five = four.withColumns({
        "__license_number": _map(c("found"), lambda v: F.regexp_replace(F.upper(v), r"[\s\-]", "")), "__name": F.coalesce(c("line"), c("said"), field(c("anywhere"), confidence_of(of, c("anywhere")), F.regexp_extract(raw, LICENCE_NAME_ANYWHERE, 0))),
        "__date_of_issue": F.coalesce(told["date_of_issue"], F.when(n >= 2, field(dashed(c("before")), F.lit(ISSUED_LAST), none))),
        "__date_of_expiry": F.coalesce(told["date_of_expiry"], field(dashed(c("later")), F.lit(EXPIRES_LATER), none), F.when(n >= 2, field(dashed(last(days)), F.lit(EXPIRES_LAST), none))),
        "__vehicle_class": F.when(F.size("__classes") > 0, classes).otherwise(F.when(c("l_vehicle_class").isNotNull(), c("l_vehicle_class").withField("source", none))),
    })
    return _finished(five, docs.columns, ["license_number", "name", "date_of_birth", "date_of_issue", "date_of_expiry", "vehicle_class"])
