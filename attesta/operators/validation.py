"""Documents checked against the ruleset of their type: presence, patterns, dates, machine-readable zone, and what is shown against what the zone says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import checks as C
from attesta.functions.dates import parse_date

#: Characters that don't count in a field, the fields that are compared in upper or in any case, and those whose blanks count as dashes.
IGNORED = {"passport_number": "[ <]", "nationality": "<", "visa_number": r"[\s<]", "id_number": r"\s", "license_number": r"[\s\-]", "permit_number": r"[\s\-]", "vehicle_no": r"[\s\-]"}
UPPER = ("passport_number", "nationality", "visa_number", "license_number", "permit_number", "vehicle_no")
ANY_CASE = ("visa_type", "entry_validation", "stay_duration", "permit_type", "gender")
DASHED = ("permit_type",)
#: Fields whose pattern decides on the check of their presence, and those that get a check of their own where it fails.
DECISIVE = ("passport_number", "nationality", "visa_number", "visa_type", "entry_validation", "stay_duration", "id_number", "license_number", "permit_number", "permit_type")
OPTIONAL = ("gender", "pin_code", "vehicle_no")
#: Types whose dates have to be dates, those whose zone is checked and the letter it begins with, those that are held against what is shown, and those whose expiry counts whatever their rules say.
DATED, ZONED, EXPIRING = ("passport", "visa"), {"passport": "P", "visa": "V"}, ("permit",)
SHOWN = {"passport": ("passport_number", "date_of_birth", "date_of_expiry", "gender", "nationality"), "visa": ("visa_number", "date_of_birth", "date_of_expiry", "gender", "nationality")}
#: Least characters of a zone's second line, and the confidence below which a field gets a warning.
ZONE_LENGTH, LEAST_CONFIDENCE = 28, 0.75
_FIELDS = "map<string,struct<value:string,confidence:double>>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _zone_faults(lines: Column, kind: Column) -> Column:
    """What is wrong with a zone's two lines: LENGTH, CHECKSUM or nothing (empty); null where there aren't two lines."""
    kept = F.filter(F.transform(F.split(lines, "\n"), _trim), lambda x: x != "")
    first, second = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
    letter = F.when(kind == "visa", "V").otherwise("P")
    zone = F.when(F.startswith(second, letter) & ~F.startswith(first, letter), first).otherwise(second)

    def digit(of: Column, at: int, start: int, size: int) -> Column:
        said, expected = F.substring(of, at, 1), C.icao_digit_plain(F.substring(of, start, size))
        return (said == expected.cast("string")) | (F.lit(at == 10) & (kind == "visa") & (said == "<") & (expected == 0))

    # The line is bound once; the check digits are worked out in one place.
    fault = F.transform(F.array(zone), lambda z: F.when(F.length(z) < ZONE_LENGTH, "LENGTH").when(~(digit(z, 10, 1, 9) & digit(z, 20, 14, 6) & digit(z, 28, 22, 6)), "CHECKSUM").otherwise(""))
    return F.when(F.size(kept) >= 2, fault[0])


def validate(documents: DataFrame, rulesets: DataFrame, as_of: Column) -> DataFrame:
    """``documents`` (document_type, fields: a map of struct value and confidence; further columns stay) with checks, warnings and valid, by ``rulesets`` as ``load_rulesets`` gives them (of several for a type the first file counts).

    ``checks`` is an array of struct (field, status, reason), in order: each required field as VALID, MISSING (blank or absent) or INVALID (its pattern or checksum fails: reason PATTERN, CHECKSUM, STATE, ZONE_LENGTH); optional
    fields that don't fit their pattern; dates that are none, or that a date rule refuses (FORMAT, FUTURE, EXPIRED), an expiry not after the birth as INCONSISTENT; values that the machine-readable zone gives and that differ from the
    shown ones (visual_<field>), as MISMATCH; a visa's zone. ``warnings`` names the fields read with too little confidence. ``valid``: nothing is INVALID or MISSING. A type without ruleset, or whose
    ruleset lacks a key, has null checks and is not valid. Types and patterns come from the rulesets alone. The rulesets are a few rows, which Spark broadcasts by their size.
    """
    kept = [c for c in documents.columns if c != "fields"]
    rows = documents.withColumn("__kind", F.lower("document_type")).withColumn("__fields", F.coalesce(F.col("fields").cast(_FIELDS), F.create_map().cast(_FIELDS)))
    ready = rulesets.where(F.size("missing") == 0)
    one_each = ready.groupBy(F.lower("document_type").alias("__kind")).agg(F.min_by("rules", "file").alias("__rules"))
    joined = rows.join(one_each, "__kind", "left")
    fields, kind, rules = F.col("__fields"), F.col("__kind"), F.col("__rules")
    value = lambda name: F.element_at(fields, F.lit(name) if isinstance(name, str) else name)["value"]
    said = lambda name: F.coalesce(value(name), F.lit(""))
    pattern = lambda name: F.element_at(rules["patterns"], F.lit(name))

    def plain(name: str) -> Column:
        clean = F.regexp_replace(_trim(value(name)), IGNORED[name], "") if name in IGNORED else _trim(value(name))
        clean = F.upper(clean) if name in UPPER else clean
        return F.replace(F.lower(clean), F.lit(" "), F.lit("-")) if name in DASHED else clean

    def broken(name: str) -> Column:
        """The reason why a shown field doesn't fit its pattern, or null."""
        whole = F.concat(F.lit("(?i)^(?:" if name in ANY_CASE else "^(?:"), pattern(name), F.lit(")$"))
        return F.when((said(name) != "") & pattern(name).isNotNull(), F.when(~F.regexp_like(plain(name), whole), "PATTERN"))

    one = joined.withColumns({f"__b_{n}": broken(n) for n in (*DECISIVE, *OPTIONAL)} | {"__born": parse_date(value("date_of_birth"), as_of), "__ends": parse_date(value("date_of_expiry"), as_of, True), "__zone": _zone_faults(value("mrz_lines"), kind), "__born_shown": parse_date(value("visual_date_of_birth"), as_of), "__ends_shown": parse_date(value("visual_date_of_expiry"), as_of, True)})
    number, licence = F.regexp_replace(_trim(value("id_number")), r"\s", ""), F.upper(F.regexp_replace(_trim(value("license_number")), r"[\s\-]", ""))
    two = one.withColumns({
        "__b_id_number": F.coalesce("__b_id_number", F.when((said("id_number") != "") & pattern("id_number").isNotNull() & ~C.verhoeff_valid(number), "CHECKSUM")),
        "__b_license_number": F.coalesce("__b_license_number", F.when((said("license_number") != "") & pattern("license_number").isNotNull() & ~F.substring(licence, 1, 2).isin(*(s for s in C.STATES if s not in C.OLD_STATES)), "STATE")),
    })
    check = lambda field, status, reason=None: F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), (F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(reason).cast("string") if reason is None or isinstance(reason, str) else reason).alias("reason"))
    decided = F.create_map(*[x for n in DECISIVE for x in (F.lit(n), F.col(f"__b_{n}"))], F.lit("mrz_lines"), F.when((kind == "passport") & (F.col("__zone") != ""), F.concat(F.lit("ZONE_"), F.col("__zone"))))

    def required(name: Column) -> Column:
        reason = F.element_at(F.col("__decided"), name)
        blank = F.coalesce(_trim(value(name)), F.lit("")) == ""
        return check(name, F.when(reason.isNotNull(), "INVALID").when(blank, "MISSING").otherwise("VALID"), reason)

    def when(test: Column, field: str, status: str, reason: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), check(field, status, reason))

    rule = lambda field, name: F.coalesce(F.element_at(F.element_at(rules["date_rules"], F.lit(field)), F.lit(name)), F.lit(False))
    born, ends, dated = F.col("__born"), F.col("__ends"), kind.isin(*DATED)
    expires = rule("date_of_expiry", "must_be_after_today") | kind.isin(*EXPIRING)
    dates = [
        when(dated & (said("date_of_birth") != "") & born.isNull(), "date_of_birth", "INVALID", "FORMAT"), when(rule("date_of_birth", "must_be_past") & (born >= as_of), "date_of_birth", "INVALID", "FUTURE"),
        when(dated & (said("date_of_expiry") != "") & ends.isNull(), "date_of_expiry", "INVALID", "FORMAT"), when(expires & (ends <= as_of), "date_of_expiry", "INVALID", "EXPIRED"),
        when(rule("date_of_expiry", "must_be_after_dob") & (ends <= born), "date_of_expiry", "INCONSISTENT", "BEFORE_BIRTH"),
    ]

    def differs(name: str) -> Column:
        """What the zone gives and what is shown are both there and not the same."""
        a, b = _trim(value(name)), _trim(value(f"visual_{name}"))
        if name == "date_of_birth":
            other = born != F.col("__born_shown")
        elif name == "date_of_expiry":
            other = ends != F.col("__ends_shown")
        elif name == "gender":
            letters = [F.upper(F.substring(x, 1, 1)) for x in (a, b)]
            other = letters[0].isin("M", "F", "X") & letters[1].isin("M", "F", "X") & (letters[0] != letters[1])
        elif name == "nationality":
            other = C.canonical_nationality(a) != C.canonical_nationality(b)
        else:
            other = C.numbers_differ(a, b)
        return (said(name) != "") & (said(f"visual_{name}") != "") & other

    order = ("passport_number", "visa_number", *SHOWN["passport"][1:])
    shown = [when(F.greatest(*[(kind == k) & F.lit(n in names) for k, names in SHOWN.items()]) & differs(n), n, "INVALID", "MISMATCH") for n in order]
    shown.append(when(dated & C.names_differ(value("name"), value("visual_name")), "name", "INVALID", "MISMATCH"))
    zone = F.when((kind == "visa") & F.col("__zone").isNotNull(), F.when(F.col("__zone") == "", check("mrz_lines", "VALID")).otherwise(check("mrz_lines", "INVALID", F.concat(F.lit("ZONE_"), F.col("__zone")))))
    optional = [F.when(F.col(f"__b_{n}").isNotNull(), check(n, "INVALID", F.col(f"__b_{n}"))) for n in OPTIONAL]
    three = two.withColumn("__decided", decided)
    four = three.withColumns({"__required": F.transform(rules["required_fields"], required), "__others": F.array_compact(F.array(*optional, *dates, *shown, zone))})
    low = F.map_keys(F.map_filter(fields, lambda _, f: f["confidence"] < LEAST_CONFIDENCE))
    told = four.select(*[F.col(f"`{c}`") for c in kept], F.concat("__required", "__others").alias("checks"), low.alias("warnings"))
    bad = F.exists("checks", lambda c: c["status"].isin("INVALID", "MISSING"))
    return told.withColumn("valid", ~F.coalesce(bad, F.lit(True)))
