"""Machine-readable zones: TD3 passports and MRV visas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.checks import digit_accepted, icao_digit
from attesta.functions.dates import standard_date


def candidate_line(line: Column) -> Column:
    """An OCR line as it would stand in a zone: no white space, brackets and underscores as fillers, upper case."""
    return F.upper(F.translate(F.regexp_replace(line, r"\s+", ""), "[]{}()_", "<<<<<<<"))


def _names(line1: Column) -> tuple[Column, Column]:
    parts = F.split(F.substring(line1, 6, 100), "<<")
    clean = lambda i: F.trim(F.translate(F.coalesce(F.get(parts, i), F.lit("")), "<", " "))
    return clean(0), clean(1)


def _field(line: Column, start: int, size: int) -> Column:
    return F.translate(F.substring(line, start, size), "<", "")


def zone(line1: Column, line2: Column, mode: str, pivot: int) -> Column:
    """Fields of two lines as a struct; ``mode`` says when the document number's digit counts as right (see ``digit_accepted``)."""
    surname, given = _names(line1)
    number, born, expires = (F.substring(line2, a, n) for a, n in ((1, 9), (14, 6), (22, 6)))
    digit = lambda i: F.substring(line2, i, 1)
    number_ok = digit_accepted(digit(10), icao_digit(number), mode)
    born_ok, expires_ok = digit(20) == icao_digit(born).cast("string"), digit(28) == icao_digit(expires).cast("string")
    sex = digit(21)
    return F.struct(
        _field(line1, 3, 3).alias("country"),
        surname.alias("surname"),
        given.alias("given_names"),
        F.translate(number, "<", "").alias("number"),
        _field(line2, 11, 3).alias("nationality"),
        standard_date(born, pivot).alias("date_of_birth"),
        F.when(sex.isin("M", "F", "X"), sex).alias("sex"),
        standard_date(expires, pivot).alias("date_of_expiry"),
        number_ok.alias("number_ok"),
        born_ok.alias("birth_ok"),
        expires_ok.alias("expiry_ok"),
        (number_ok & born_ok & expires_ok).alias("valid"),
    )


def passport(line1: Column, line2: Column, layout: str = "new", pivot: int = 54) -> Column:
    """A TD3 zone; the new layout also has a personal number."""
    fields = zone(line1, line2, layout, pivot)
    personal = _field(line2, 29, 14) if layout == "new" else F.lit(None).cast("string")
    return fields.withField("personal_number", F.when(personal != "", personal))


def visa(line1: Column, line2: Column, pivot: int = 54) -> Column:
    """An MRV-A or MRV-B zone: the longer line decides on 44 or 36 characters, shorter lines are filled."""
    long = F.greatest(F.length(line1), F.length(line2)) > 36
    size = F.when(long, 44).otherwise(36)
    whole = lambda x: F.substring(F.rpad(x, 44, "<"), F.lit(1), size)
    a, b = whole(line1), whole(line2)
    optional = F.translate(F.substring(b, 29, 44), "<", "")
    fields = zone(a, b, "filler", pivot).withField("format", F.when(long, "MRV_A").otherwise("MRV_B"))
    return fields.withField("passport_number", F.when(optional.rlike("^[A-Z0-9]{7,10}$"), optional))
