"""Visual-zone extraction and rule sets over synthesised documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fields
from attesta.functions.checks import NATIONALITIES, OLD_STATES, STATES
from attesta.functions.rulesets import RULES
from attesta.operators import validation as V
from attesta.plans import query
from attesta.plans.calendar import parsed_sql
from attesta.plans.records import _verhoeff_sql
from attesta.sources.files import known_rulesets


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


@query(
    "f23_visual_zone",
    """SELECT c_custkey AS k, 'E' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS passport_number, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'DOE' END AS surname, 'Jane Mary' AS given_names, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Jane Mary DOE' END AS full_name,
    'INDIAN' AS nationality, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS sex, '1980-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date_of_birth, '2015-06-01' AS date_of_issue FROM customer""",
)
def visual_zone(t):
    """Lines with labels in two languages, noise between them, a label on its own before its value, and repeats that come too late."""
    k = F.col("c_custkey")
    sex = F.element_at(F.array(F.lit("Homme"), F.lit("F"), F.lit("x")), (k % 3 + 1).cast("int"))
    text = F.concat_ws(
        "\n", F.lit("REPUBLIC OF SOMEWHERE"), F.concat(F.lit("Passport No: e"), _pad(k, 7)), F.when(k % 4 != 0, "Surname / Nom: DOE").otherwise("Surname: nom"), F.lit("Given Names: - Jane Mary"), F.lit("Surname, second: too late"),
        F.lit("Nationality / Nationalité: INDIAN"), F.concat(F.lit("Sex / Sexe: "), sex), F.concat(F.lit("Date of Birth: "), _pad(k % 28 + 1, 2), F.lit("/02/1980")), F.lit("Date of Issue: 01 JUN 2015"), F.lit("Nationality: LATER"),
    )
    return t("customer").select(k.alias("k"), fields.passport_zone(text, 30).alias("z")).select("k", "z.*")


AS_OF = "2026-06-30"
#: The lines of a specimen passport and visa.
_PASSPORT_LINES = ("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10")
_VISA_LINES = ("V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L8988901C4XXX4009078F96121096ZE184226B<<<<<<")
_K = "c_custkey"


def _lines(first: str, second: str) -> str:
    """Both lines, tampered with, swapped, cut short, or only one of them."""
    return f"CASE {_K} % 6 WHEN 0 THEN '{first}' || chr(10) || '{second}' WHEN 1 THEN '{first}' || chr(10) || replace('{second}', '1', '2') WHEN 2 THEN ' {second}' || chr(10) || chr(10) || '{first} ' WHEN 3 THEN '{first}' || chr(10) || substr('{second}', 1, 27) WHEN 4 THEN '{first}' END"


def _day(shift: int) -> str:
    return f"CASE ({_K} + {shift}) % 7 WHEN 0 THEN '31/02/1990' WHEN 1 THEN CAST({_K} % 28 + 1 AS STRING) || '/05/' || CAST(1960 + ({_K} * 7 + {shift}) % 90 AS STRING) WHEN 2 THEN lpad(CAST({_K} % 100 AS STRING), 2, '0') || '0315' WHEN 3 THEN 'no date' WHEN 4 THEN '2031-0' || CAST({_K} % 9 + 1 AS STRING) || '-10' WHEN 5 THEN '14 Nov ' || CAST(1990 + {_K} % 60 AS STRING) END"


#: Fields of every document, as an expression over a customer that runs in both engines; null where a field isn't there.
DOCUMENTS = {
    "passport": {
        "passport_number": f"CASE {_K} % 5 WHEN 0 THEN ' ab' || lpad(CAST({_K} % 1000000 AS STRING), 6, '0') || '<' WHEN 1 THEN 'K 123 4567' WHEN 2 THEN '  ' WHEN 3 THEN 'ABC' || CAST({_K} AS STRING) END", "visual_passport_number": f"CASE {_K} % 3 WHEN 0 THEN 'k1234567' WHEN 1 THEN 'X' || CAST({_K} AS STRING) END",
        "name": f"CASE {_K} % 4 WHEN 0 THEN 'ANNA ERIKSSON' WHEN 1 THEN 'Jane' WHEN 2 THEN '12' END", "visual_name": f"CASE {_K} % 5 WHEN 0 THEN 'Eriksson, Anna' WHEN 1 THEN 'Roe' WHEN 2 THEN '--' END", "nationality": f"CASE {_K} % 6 WHEN 0 THEN 'ind<' WHEN 1 THEN ' Indian' WHEN 2 THEN 'U T O' WHEN 3 THEN 'AMERICAN' WHEN 4 THEN '' END",
        "visual_nationality": f"CASE {_K} % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'United States' WHEN 2 THEN 'uto' END", "gender": f"CASE {_K} % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'Male' END", "visual_gender": f"CASE {_K} % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'x' WHEN 2 THEN '?' END",
        "date_of_birth": _day(0), "visual_date_of_birth": _day(1), "date_of_expiry": _day(3), "visual_date_of_expiry": _day(5), "mrz_lines": _lines(*_PASSPORT_LINES),
    },
    "visa": {
        "visa_number": f"CASE {_K} % 4 WHEN 0 THEN lpad(CAST({_K} AS STRING), 8, '0') WHEN 1 THEN 'ab 12' WHEN 2 THEN ' v 123<4567 8' END", "visual_visa_number": f"CASE {_K} % 3 WHEN 0 THEN 'V12345678' WHEN 1 THEN '' END", "visa_type": f"CASE {_K} % 4 WHEN 0 THEN ' Tourist' WHEN 1 THEN 'x-MISC' WHEN 2 THEN 'holiday' END",
        "entry_validation": f"CASE {_K} % 3 WHEN 0 THEN 'MULTIPLE' WHEN 1 THEN 'twice' END", "stay_duration": f"CASE {_K} % 4 WHEN 0 THEN CAST({_K} % 3 AS STRING) || ' Days' WHEN 1 THEN '10 weeks' WHEN 2 THEN '3months' END", "name": f"CASE {_K} % 2 WHEN 0 THEN 'ANNA' END", "visual_name": f"CASE {_K} % 3 WHEN 0 THEN 'Bob' WHEN 1 THEN 'anna maria' END",
        "gender": f"CASE {_K} % 3 WHEN 0 THEN 'F' END", "visual_gender": "'male'", "nationality": "'GBR'", "visual_nationality": f"CASE {_K} % 2 WHEN 0 THEN 'British' ELSE 'Utopia' END", "date_of_birth": _day(2), "date_of_expiry": _day(4), "visual_date_of_expiry": _day(4), "mrz_lines": _lines(*_VISA_LINES),
    },
    "national_id": {
        "id_number": f"CASE {_K} % 5 WHEN 0 THEN '2341 2341 2346' WHEN 1 THEN CAST(200000000000 + {_K} * 7919 AS STRING) WHEN 2 THEN '1234 5678 9012' WHEN 3 THEN '   ' END", "name": f"CASE {_K} % 3 WHEN 0 THEN 'Jane' WHEN 1 THEN ' ' END", "date_of_birth": _day(0), "gender": f"CASE {_K} % 5 WHEN 0 THEN 'female' WHEN 1 THEN 'third  gender' WHEN 2 THEN 'M ' WHEN 3 THEN 'none' END", "pin_code": f"CASE {_K} % 4 WHEN 0 THEN '560001' WHEN 1 THEN '060001' WHEN 2 THEN ' 1' END",
    },
    "driving_license": {
        "license_number": f"CASE {_K} % 6 WHEN 0 THEN 'mh-01 2003' || lpad(CAST({_K} AS STRING), 7, '0') WHEN 1 THEN 'ZZ012003' || lpad(CAST({_K} AS STRING), 7, '0') WHEN 2 THEN 'MH0118990000001' WHEN 3 THEN 'KA' WHEN 4 THEN 'UA0120030034761' END", "name": f"CASE {_K} % 2 WHEN 0 THEN 'Jane' END", "date_of_birth": _day(1), "date_of_expiry": _day(2),
    },
    "permit": {
        "permit_number": f"CASE {_K} % 4 WHEN 0 THEN 'ar 01 2024 ABCDE' WHEN 1 THEN '12' WHEN 2 THEN lpad(CAST({_K} AS STRING), 12, '7') END", "name": "'Jane Doe'", "permit_type": f"CASE {_K} % 4 WHEN 0 THEN 'Inner Line permit' WHEN 1 THEN 'pilgrim' WHEN 2 THEN 'Special Entry' END", "vehicle_no": f"CASE {_K} % 4 WHEN 0 THEN 'ka 01 ab 1234' WHEN 1 THEN '!?' WHEN 2 THEN 'x1' END", "date_of_expiry": _day(6),
    },
}
_SURE = lambda i: f"CASE WHEN ({_K} + {i}) % 9 = 0 THEN NULL ELSE CAST(60 + ({_K} * 3 + {i} * 11) % 40 AS DOUBLE) / 100 END"


def _documents(t, kind: str):
    pairs = ", ".join(f"'{n}', CASE WHEN {e} IS NOT NULL THEN named_struct('value', {e}, 'confidence', {_SURE(i)}) END" for i, (n, e) in enumerate(DOCUMENTS[kind].items()))
    fields_ = F.map_filter(F.expr(f"map({pairs})"), lambda _, f: f.isNotNull())
    return t("customer").select(F.col("c_custkey").alias("k"), F.lit(kind.upper()).alias("document_type"), fields_.alias("fields"))


def _rules_sql(kind: str) -> str:
    """Checks of a type from columns of fields; a list in order, without those that don't apply."""
    rules, mine = RULES[kind], DOCUMENTS[kind]
    q = lambda text: "'" + text.replace("'", "''") + "'"
    trim = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    number = lambda v: f"upper(regexp_replace({v}, '[\\s<]', '', 'g'))"

    def plain(n: str) -> str:
        v = trim(n) if n not in V.IGNORED else f"regexp_replace({trim(n)}, {q(V.IGNORED[n])}, '', 'g')"
        v = f"upper({v})" if n in V.UPPER else v
        return f"replace(lower({v}), ' ', '-')" if n in V.DASHED else v

    def broken(n: str) -> str:
        tests = [f"WHEN NOT regexp_matches({plain(n)}, {q(('(?i)' if n in V.ANY_CASE else '') + '^(?:' + rules['patterns'][n] + ')$')}) THEN 'PATTERN'"]
        if n == "id_number":
            tests.append(f"WHEN NOT {_verhoeff_sql(plain(n))} THEN 'CHECKSUM'")
        if n == "license_number":
            tests.append(f"WHEN substr({plain(n)}, 1, 2) NOT IN ({', '.join(q(s) for s in STATES if s not in OLD_STATES)}) THEN 'STATE'")
        return f"CASE WHEN coalesce({n}, '') <> '' THEN CASE {' '.join(tests)} END END"

    struct = lambda n, status, reason: f"{{'f': '{n}', 's': {status}, 'r': {reason}}}"
    parsed = {n: parsed_sql(n, AS_OF, "expiry" in n) for n in mine if "date_of" in n}
    worth = "CASE WHEN substr({0}, j, 1) BETWEEN '0' AND '9' THEN ascii(substr({0}, j, 1)) - 48 WHEN substr({0}, j, 1) BETWEEN 'A' AND 'Z' THEN ascii(substr({0}, j, 1)) - 55 ELSE 0 END"
    digit = lambda at, start, size: f"(substr(z, {at}, 1) = CAST(list_sum(list_transform(range({start}, {start + size}), lambda j: ({worth.format('z')}) * [7, 3, 1][(j - {start}) % 3 + 1])) % 10 AS VARCHAR))"
    letter = V.ZONED.get(kind, "?")
    zone = f"CASE WHEN length(z) < 28 THEN 'LENGTH' WHEN NOT ({digit(10, 1, 9)} AND {digit(20, 14, 6)} AND {digit(28, 22, 6)}) THEN 'CHECKSUM' WHEN z IS NOT NULL THEN '' END" if kind in V.ZONED else "NULL"
    l2 = f"list_filter(list_transform(string_split(mrz_lines, chr(10)), lambda v: {trim('v')}), lambda v: v <> '')" if kind in V.ZONED else "NULL::VARCHAR[]"
    checks = []
    for n in rules["required_fields"]:
        reason = broken(n) if n in V.DECISIVE else "CASE WHEN zf <> '' THEN 'ZONE_' || zf END" if n == "mrz_lines" else "NULL::VARCHAR"
        checks.append(struct(n, f"CASE WHEN {reason} IS NOT NULL THEN 'INVALID' WHEN coalesce({trim(n)}, '') = '' THEN 'MISSING' ELSE 'VALID' END", reason))
    for n in V.OPTIONAL:
        if n in rules["patterns"] and n in mine:
            checks.append(f"CASE WHEN {broken(n)} IS NOT NULL THEN {struct(n, q('INVALID'), broken(n))} END")
    on = lambda test, n, status, reason: checks.append(f"CASE WHEN {test} THEN {struct(n, q(status), q(reason))} END")
    strict = kind in V.DATED
    if "date_of_birth" in mine:
        if strict:
            on("date_of_birth <> '' AND p_date_of_birth IS NULL", "date_of_birth", "INVALID", "FORMAT")
        on(f"p_date_of_birth >= DATE '{AS_OF}'", "date_of_birth", "INVALID", "FUTURE")
    if "date_of_expiry" in mine:
        if strict:
            on("date_of_expiry <> '' AND p_date_of_expiry IS NULL", "date_of_expiry", "INVALID", "FORMAT")
        on(f"p_date_of_expiry <= DATE '{AS_OF}'", "date_of_expiry", "INVALID", "EXPIRED")
        if strict:
            on("p_date_of_expiry <= p_date_of_birth", "date_of_expiry", "INCONSISTENT", "BEFORE_BIRTH")
    canonical = lambda v: f"(SELECT CASE {' '.join(f'WHEN y IN ({chr(44).join(q(x) for x in names)}) THEN {q(code)}' for code, names in NATIONALITIES.items())} ELSE y END FROM (SELECT {number(v)} AS y))"
    for n in V.SHOWN.get(kind, ()):
        if f"visual_{n}" in mine:
            if n.startswith("date"):
                test = f"p_{n} <> p_visual_{n}"
            elif n == "gender":
                test = "upper(gender[1]) IN ('M', 'F', 'X') AND upper(visual_gender[1]) IN ('M', 'F', 'X') AND upper(gender[1]) <> upper(visual_gender[1])"
            else:
                test = f"{canonical(n)} <> {canonical('visual_' + n)}" if n == "nationality" else f"{number(n)} <> {number('visual_' + n)}"
            on(f"{n} <> '' AND visual_{n} <> '' AND {test}", n, "INVALID", "MISMATCH")
    if strict:
        words = lambda v: f"regexp_extract_all(upper({v}), '[A-Z]+')"
        on(f"len({words('name')}) > 0 AND len({words('visual_name')}) > 0 AND NOT list_has_any({words('name')}, {words('visual_name')})", "name", "INVALID", "MISMATCH")
    if kind == "visa":
        checks.append(f"CASE WHEN zf IS NOT NULL THEN {struct('mrz_lines', 'CASE WHEN zf = ' + q('') + ' THEN ' + q('VALID') + ' ELSE ' + q('INVALID') + ' END', 'CASE WHEN zf <> ' + q('') + ' THEN ' + q('ZONE_') + ' || zf END')} END")
    low = ", ".join(f"CASE WHEN {n} IS NOT NULL AND {_SURE(i).replace(_K, 'k')} < 0.75 THEN '{n}' END" for i, n in enumerate(mine))
    return f"""WITH t AS (SELECT c_custkey AS k, {', '.join(f'{e} AS {n}' for n, e in mine.items())} FROM customer), a AS (SELECT *, {l2} AS ls{''.join(f', {e} AS p_{n}' for n, e in parsed.items())} FROM t),
        b AS (SELECT *, CASE WHEN len(ls) >= 2 THEN CASE WHEN starts_with(ls[2], '{letter}') AND NOT starts_with(ls[1], '{letter}') THEN ls[1] ELSE ls[2] END END AS z FROM a), c AS (SELECT *, {zone} AS zf FROM b),
        d AS (SELECT k, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS checks, array_to_string(list_filter([{low}], lambda x: x IS NOT NULL), ',') AS warnings FROM c)
        SELECT k, array_to_string(list_transform(checks, lambda x: x.f || ':' || x.s || coalesce(':' || x.r, '')), ',') AS checks, warnings, len(list_filter(checks, lambda x: x.s IN ('INVALID', 'MISSING'))) = 0 AS valid FROM d"""


def _ruleset(kind: str):
    @query(f"g2_{kind}_rules", _rules_sql(kind))
    def rules(t):
        """Documents against the ruleset of their type, which is data: every check in order, fields read badly, and whether the document stands."""
        documents = _documents(t, kind)
        found = V.validate(documents, known_rulesets(documents.sparkSession), F.lit(AS_OF).cast("date"))
        told = F.transform("checks", lambda c: F.concat_ws(":", c["field"], c["status"], c["reason"]))
        return found.select("k", F.array_join(told, ",").alias("checks"), F.array_join("warnings", ",").alias("warnings"), "valid")


for _kind in DOCUMENTS:
    _ruleset(_kind)
