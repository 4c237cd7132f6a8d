"""Dates as documents spell them. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in order.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
_MONTH = "^(\\d{1,2})[\\s\\-]([A-Z]{3})[\\s\\-](\\d{4})$"
_DAY = "^(\\d{1,2})[/.\\-](\\d{1,2})[/.\\-](\\d{4})$"
_MRZ = "^(\\d{2})(\\d{2})(\\d{2})$"


def full_year(yy: Column, pivot: int) -> Column:
    """Century of a two-digit year: years after the pivot belong to the last one."""
    return F.concat(F.when(yy.cast("int") > pivot, "19").otherwise("20"), yy)


def standard_date(text: Column, pivot: int) -> Column:
    """yyyy-mm-dd from ISO, day-month-year, day month-name year or yymmdd; other text as it is. Days aren't checked against the calendar."""
    clean = F.upper(F.trim(text))
    part = lambda p, i: F.regexp_extract(clean, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(_MONTH, 2))
    return (
        F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), clean)
        .when(clean.rlike(_DAY), F.concat_ws("-", part(_DAY, 3), two(part(_DAY, 2)), two(part(_DAY, 1))))
        .when(clean.rlike(_MONTH) & (number > 0), F.concat_ws("-", part(_MONTH, 3), two(number.cast("string")), two(part(_MONTH, 1))))
        .when(clean.rlike(_MRZ), F.concat_ws("-", full_year(part(_MRZ, 1), pivot), part(_MRZ, 2), part(_MRZ, 3)))
        .otherwise(text)
    )


def expiry_status(expires: Column, as_of: Column) -> Column:
    return F.when(expires < as_of, "EXPIRED").when(expires < F.date_add(as_of, 180), "NEAR_EXPIRY").when(expires.isNotNull(), "VALID")


def birth_status(born: Column, as_of: Column) -> Column:
    return F.when(born > as_of, "INVALID_FUTURE_DOB").when(born.isNotNull(), "VALID")


def age_years(born: Column, as_of: Column) -> Column:
    return F.floor(F.datediff(as_of, born) / 365.25)


#: Month names in full, as they may be spelled beside their first three letters.
FULL_MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()
_NAMED = r"(JANUARY|FEBRUARY|MARCH|APRIL|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER|SEPT|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
#: Forms that are tried in turn: pattern, and the groups of year, month and day. A day comes before a month; what is no day in the calendar goes on to the next form.
FORMS = (
    (r"(?s)^(\d{4})-(\d{2})-(\d{2}).*$", 1, 2, 3),
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", 3, 2, 1),
    (rf"^(\d{{1,2}})(?:ST|ND|RD|TH)?[\s\-/.,]*(?:OF\s+)?{_NAMED}[\s\-/.,]*(\d{{4}}|\d{{2}})$", 3, 2, 1),
    (rf"^{_NAMED}[\s\-/.,]*(\d{{1,2}})(?:ST|ND|RD|TH)?[\s\-/.,]+(\d{{4}}|\d{{2}})$", 3, 1, 2),
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", 3, 1, 2),
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2})$", 3, 2, 1),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$", 1, 3, 2),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$", 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
)
#: Years to come in which a six-digit expiry still lies, and years around the present that a free two-digit year is taken from.
AHEAD, AROUND = 30, 50


def parse_date(text: Column, as_of: Column, expiry: bool = False) -> Column:
    """The date a text means, or null: six digits yymmdd, else the first of FORMS that is a day in the calendar.

    Six digits of an expiry lie up to AHEAD years after the year of ``as_of``, of a birth not after it; they have no other meaning. Two-digit years elsewhere are the nearest
    within AROUND years. Case and white space around the text don't matter.
    """
    clean = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    six = r"^(\d{2})(\d{2})(\d{2})$"
    coded, now = clean.rlike(six), F.year(as_of)
    last = F.when(coded, now + (AHEAD if expiry else 0)).otherwise(now + AROUND - 1)
    spelled = F.array(*[F.when(clean.rlike(p), F.regexp_replace(clean, p, f"${y}|${m}|${d}")) for p, y, m, d in FORMS])

    def day(parts: Column) -> Column:
        y, m = parts[0], parts[1]
        n = F.when(F.length(y) == 2, F.try_to_number(y, F.lit("99")).cast("int"))
        name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3))
        year = F.coalesce((F.floor((last - n) / 100) * 100 + n).cast("string"), y)
        return F.concat_ws("-", year, F.lpad(F.when(name > 0, name.cast("string")).otherwise(m), 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date")

    tried = F.when(coded, F.array(F.regexp_replace(clean, six, "$1|$2|$3"))).otherwise(F.array_compact(spelled))
    days = F.transform(F.transform(tried, lambda c: F.split(c, r"\|")), day)
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))
