"""Fields extracted from text regions in reading order; the SQL works from the region table by joins with the labels and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from attesta.functions import labelled as L
from attesta.functions.zones import LICENCE_NOISE
from attesta.plans import query
from attesta.plans.extraction import _DAY, _K8, _TRIM, _quoted

#: Regions of documents of several layouts, a line each. The same expression runs in both engines; what is in them is found by the queries alone.
REGIONS = {
    "PASSPORT": f"""CASE c_custkey % 6
        WHEN 0 THEN concat_ws(chr(10), 'REPUBLIC OF INDIA', 'Type / Type', 'P', 'Code / Code du pays', 'IND', 'Passport No. / No du passeport', 'Z' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'), 'Surname / Nom', 'DOE', 'Given Name(s) / Prénoms', 'JANE MARY', 'Nationality / Nationalité', 'INDIAN', 'Sex / Sexe', 'F', 'Date of Birth / Date de naissance', {_DAY.format('c_custkey')} || '/02/1980', 'Place of Birth / Lieu de naissance', 'PUNE, MAHARASHTRA', 'Date of Issue / Date de délivrance', '01/06/2015', 'Date of Expiry / Date d''expiration', '31/05/2025')
        WHEN 1 THEN concat_ws(chr(10), 'Passport No: ab ' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') || ' x', 'Surname: NAME', 'Given Names: R2D2', 'Full Name: Ana Lúcia', 'SEX: SEXE: homme', 'Nationality: P', 'seen in the UNITED STATES', '13/25/1990', '25/13/1991', {_DAY.format('c_custkey')} || '.07.1991', '04-05-2031')
        WHEN 2 THEN concat_ws(chr(10), 'no label ' || 'K' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'), 'Surname (s)', '/ Nom', 'Type', 'late ROE', 'First Name', 'HOLDER', 'Signature', 'Code', 'Tom', 'Citizenship British Date 1990', 'DOB 3 Mar 1977', 'ISSUED AT: LONDON DATE 2019', '11/11/2011')
        WHEN 3 THEN concat_ws(chr(10), 'Name', 'Holder', '', 'Paul Sex M', 'Gender', '/ SEXE F', 'NATIONAL IND', 'Place of issue', 'Birth place: Date', '09/09/2040')
        WHEN 4 THEN concat_ws(chr(10), 'Prénoms: (first) Zoé', 'Lieu de délivrance', '/ Lieu de délivrance: PARIS', 'CANADA', 'Expiry: unknown', '01/01/1999', '02/02/1999', '02/02/1999', '03-03-2033')
        END""",
    "VISA": f"""CASE c_custkey % 5
        WHEN 0 THEN concat_ws(chr(10), 'VISA', 'Visa No. / No du visa', 'V' || {_K8}, 'Type of Visa', 'Tourist', 'Number of Entries: Multiple', 'Duration of Stay', '(days)', CAST(c_custkey % 90 + 1 AS STRING) || ' Days', 'Name of Bearer: Jane Doe', 'Sex', 'F', 'Nationality: ind', 'Date of Birth: ' || {_DAY.format('c_custkey')} || '/02/1980', 'Valid From 01 JAN 2024', 'Valid Until: 2025', 'Passport No x1234567')
        WHEN 1 THEN concat_ws(chr(10), 'ref ' || {_K8} || 'QX', 'Surname: Roe', 'Given Names - Rick', 'Full name: Consulate General', 'stay of ' || CAST(c_custkey % 200 AS STRING) || ' months', 'gender: homme', 'Citizenship: X')
        WHEN 2 THEN concat_ws(chr(10), 'Category', 'Type', 'Class', 'S', 'Entry', 'Single', 'for ' || CAST(c_custkey % 9 + 1 AS STRING) || ' days', 'Holder: the Embassy', 'Surname: Visa Office', 'First Name: Li', 'Sexe', 'Date of birth', 'Code', 'Type', 'P', 'Born 1990')
        WHEN 3 THEN 'nothing of use'
        END""",
    "LICENCE": f"""CASE c_custkey % 6
        WHEN 0 THEN concat_ws(chr(10), 'INDIAN UNION DRIVING LICENCE', 'GJ06 2023' || lpad(CAST(c_custkey AS STRING), 7, '0'), 'Name : PARTH PATHAK', 'Date Of Birth : ' || {_DAY.format('c_custkey')} || '-08-1996', 'Issue Date', '04-02-2023', 'Validity ( NT )', '25/08/2046', 'COV: LMV, mcwg LMV')
        WHEN 1 THEN concat_ws(chr(10), 'mh-01-2003-' || lpad(CAST(c_custkey AS STRING), 7, '0'), 'Name: Holder''s Signature', 'Name', 'Asha R. Rao', {_DAY.format('c_custkey')} || '/05/1990', '01.01.2020', '31/12/2035')
        WHEN 2 THEN concat_ws(chr(10), 'his Name : Ravi Kumar', 'and more', 'DOB: soon', '12.03.1988', 'Valid upto 11/03/' || CAST(2020 + c_custkey % 20 AS STRING), 'Class', 'heavy')
        WHEN 3 THEN concat_ws(chr(10), 'Naam: X1 Y2 Z3', 'Government', 'Date of First Issue: 30/02/2001', '05/06/2001', '07/08/1999')
        WHEN 4 THEN concat_ws(chr(10), 'Full Name - Eve', 'Birth', '11/11/1971', 'DOI 12/12/2012 TR', '01/01/2010')
        END""",
}
AS_OF = "2026-01-01"
#: Tasks for each core that documents are dealt to.
TASKS = 4


def _clean(v: str) -> str:
    plain = f"regexp_replace(coalesce({v}, ''), '{L.PARENTHESES}', '', 'g')"
    plain = reduce(lambda x, p: f"regexp_replace({x}, {_quoted('(?i)' + p)}, '', 'g')", L.SUBTITLES, plain)
    return _TRIM.format(f"regexp_replace({plain}, '{L.LEADING}', '')")


def _noise(v: str) -> str:
    plain = _TRIM.format(f"regexp_replace(regexp_replace(upper({_TRIM.format(v)}), '{L.PARENTHESES}', '', 'g'), '{L.LEADING}', '')")
    return f"(SELECT z = '' OR z IN ({', '.join(_quoted(n) for n in L.NOISE)}) FROM (SELECT {plain} AS z))"


def _labelled(kind: str, labels: dict[str, tuple[str, ...]]) -> str:
    """CTEs: n (regions with the value after them), d (a row per document: what labels say as struct columns l_<field>, raw and regions e)."""
    rows = ", ".join(f"('{f}', {p}, {_quoted(label)})" for f, ls in labels.items() for p, label in enumerate(ls))
    pivot = ", ".join(f"any_value(s) FILTER (f = '{f}') AS l_{f}" for f in labels)
    return f"""t AS (SELECT c_custkey AS k, {REGIONS[kind]} AS text FROM customer), r AS (SELECT k, CAST(i AS INT) AS i, text, (70 + (i * 7 + k) % 30) / 100.0::DOUBLE AS q FROM (SELECT k, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t WHERE text IS NOT NULL)),
        c AS MATERIALIZED (SELECT *, upper(text) AS u, {_clean('text')} AS c FROM r), x AS MATERIALIZED (SELECT *, NOT {_noise('c')} AS fit, {{'v': c, 'q': q, 's': text}} AS s FROM c),
        n AS (SELECT *, CASE WHEN lead(fit, 1) OVER w THEN lead(s, 1) OVER w WHEN lead(fit, 2) OVER w THEN lead(s, 2) OVER w WHEN lead(fit, 3) OVER w THEN lead(s, 3) OVER w END AS nx FROM x WINDOW w AS (PARTITION BY k ORDER BY i)),
        l(f, p, label) AS (VALUES {rows}), o AS MATERIALIZED (SELECT n.*, l.f, l.p, {_clean('substr(text, strpos(u, label) + length(label))')} AS own FROM n JOIN l ON contains(u, label)),
        m AS (SELECT k, f, i, p, CASE WHEN NOT {_noise('own')} THEN {{'v': own, 'q': q, 's': text}} ELSE nx END AS s FROM o), h AS (SELECT k, f, arg_min(s, i * 100 + p) FILTER (s IS NOT NULL) AS s FROM m GROUP BY k, f), g AS (SELECT k, {pivot} FROM h GROUP BY k),
        e AS (SELECT k, string_agg(text, chr(10) ORDER BY i) AS raw, list({{'q': q, 's': text}} ORDER BY i) AS e FROM r GROUP BY k), d AS (SELECT t.k, coalesce(raw, '') AS raw, e, g.* EXCLUDE k FROM t LEFT JOIN e ON t.k = e.k LEFT JOIN g ON t.k = g.k)"""


def _first(v: str, pattern: str) -> str:
    return f"nullif(regexp_extract({v}, {_quoted(pattern)}, 1), '')"


def _sure(v: str) -> str:
    return f"list_filter(e, lambda el: contains(el.s, {v}))[1].q"


def _in_region(pattern: str) -> str:
    return f"list_filter(list_transform(e, lambda el: {{'v': {_first('el.s', pattern)}, 'q': el.q}}), lambda el: el.v IS NOT NULL)[1]"


def _days(raw: str = "raw") -> str:
    return rf"""list_sort(list_filter(list_transform(list_distinct(regexp_extract_all({raw}, '{L.DAY}', 1)), lambda el: {{'day': TRY_CAST(el[7:10] || '-' || CASE WHEN CAST(el[4:5] AS INT) > 12 THEN el[1:2] || '-' || el[4:5] ELSE el[4:5] || '-' || el[1:2] END AS DATE), 't': el}}), lambda el: el.day IS NOT NULL))"""


def _documents(t, kind: str):
    """k and regions; every document with regions that all have a confidence.

    The keys alone lie in few files and would be read by few tasks, while the work is in the regions: keys are dealt out first, to tasks for all cores.
    """
    keys = t("customer").select("c_custkey")
    dealt = keys.repartition(TASKS * keys.sparkSession.sparkContext.defaultParallelism, "c_custkey")
    texts = dealt.select(F.col("c_custkey").alias("k"), F.split(F.expr(REGIONS[kind]), "\n").alias("texts"))
    return texts.select("k", F.transform("texts", lambda x, i: F.struct(x.alias("text"), ((70 + ((i + 1) * 7 + F.col("k")) % 30) / F.lit(100.0)).alias("confidence"))).alias("regions"))


def _told(found):
    return found.select("k", *[x for n in found.columns[2:] for x in (F.col(n)["value"].alias(n), F.round(F.col(n)["confidence"], 4).alias(f"{n}_c"))])


def _fields(*pairs: tuple[str, str, str]) -> str:
    """Columns of fields given as (name, value, confidence); a field without a value has no confidence."""
    return ", ".join(f"{v} AS {n}, CASE WHEN {v} IS NOT NULL THEN round({q}, 4) END AS {n}_c" for n, v, q in pairs)


_VISA_BAD = "NOT regexp_matches(lower({0}.v), 'visa|passport|republic{1}')"


@query(
    "f27_visa_regions",
    f"""WITH {_labelled('VISA', L.VISA_LABELS)},
    a AS (SELECT *, {_first('raw', L.VISA_NUMBER)} AS rn, {_first('raw', L.STAY)} AS rs, CASE WHEN {_VISA_BAD.format('l_surname', '')} THEN upper(l_surname.v) END AS sn, CASE WHEN {_VISA_BAD.format('l_given_name', '')} THEN upper(l_given_name.v) END AS gn,
        CASE WHEN {_VISA_BAD.format('l_bearer', '|consulate|department|embassy')} THEN upper(l_bearer.v) END AS bn, upper(l_sex.v) AS sx FROM d),
    b AS (SELECT *, CASE WHEN sn IS NOT NULL AND gn IS NOT NULL THEN gn || ' ' || sn ELSE bn END AS nm, CASE WHEN starts_with(sx, 'M') OR sx = 'HOMME' THEN 'M' WHEN starts_with(sx, 'F') THEN 'F' ELSE sx END AS gd, CASE WHEN length(l_nationality.v) >= 2 THEN upper(l_nationality.v) END AS nt FROM a)
    SELECT k, {_fields(('visa_number', 'coalesce(l_visa_number.v, rn)', f"CASE WHEN l_visa_number IS NOT NULL THEN l_visa_number.q ELSE {_sure('rn')} END"), ('visa_type', 'l_visa_type.v', 'l_visa_type.q'), ('entry_validation', 'l_entry_validation.v', 'l_entry_validation.q'),
        ('stay_duration', 'coalesce(l_stay_duration.v, rs)', f"CASE WHEN l_stay_duration IS NOT NULL THEN l_stay_duration.q ELSE {_sure('rs')} END"), ('name', 'nm', 'CASE WHEN sn IS NOT NULL AND gn IS NOT NULL THEN 0.92 ELSE l_bearer.q END'), ('surname', 'sn', 'l_surname.q'), ('given_name', 'gn', 'l_given_name.q'),
        ('gender', 'gd', 'l_sex.q'), ('nationality', 'nt', 'l_nationality.q'), ('date_of_birth', 'l_date_of_birth.v', 'l_date_of_birth.q'), ('date_of_issue', 'l_date_of_issue.v', 'l_date_of_issue.q'), ('date_of_expiry', 'l_date_of_expiry.v', 'l_date_of_expiry.q'), ('passport_number', 'upper(l_passport_number.v)', 'l_passport_number.q'))} FROM b""",
)
def visa_regions(t):
    return _told(L.visa_fields(_documents(t, "VISA"), "regions"))


def _licence_name(v: str) -> str:
    words = ", ".join(_quoted(n) for n in LICENCE_NOISE)
    return rf"(SELECT CASE WHEN length(z) >= 3 AND NOT regexp_matches(z, '{'|'.join(L.LICENCE_PARTS)}') AND z NOT IN ({words}) AND length(regexp_replace(z, '[^\p{{L}}\s.]', '', 'g')) >= length(z) * 0.85 THEN z END FROM (SELECT upper({_TRIM.format(v)}) AS z))"


_DASHED = "regexp_replace({0}, '[./]', '-', 'g')"


@query(
    "f27_licence_regions",
    f"""WITH {_labelled('LICENCE', L.LICENCE_LABELS)},
    rn AS (SELECT k, i, q, {_first(_TRIM.format('text'), L.LICENCE_NAME)} AS v FROM r), ry AS MATERIALIZED (SELECT k, i, q, {_licence_name('v')} AS v FROM rn WHERE v IS NOT NULL), rm AS (SELECT k, arg_min({{'v': v, 'q': q}}, i) AS nm FROM ry WHERE v IS NOT NULL GROUP BY k),
    a AS MATERIALIZED (SELECT d.*, nm, {_first('raw', L.LICENCE_NUMBER)} AS num, {_licence_name('l_name.v')} AS ln, {_licence_name(_first('raw', L.LICENCE_NAME_ANYWHERE))} AS an, {_days()} AS days, list_distinct(list_transform(regexp_extract_all(raw, {_quoted(L.CLASSES)}, 1), lambda el: upper(el))) AS cs0, list_transform(regexp_extract_all(raw, {_quoted(L.CLASSES)}, 1), lambda el: upper(el)) AS cs,
        {', '.join(f"{_in_region(p)} AS r_{n}, {_first(f'l_{n}.v', L.DAY)} AS y_{n}" for n, p in L.LICENCE_DAYS.items())} FROM d LEFT JOIN rm ON d.k = rm.k),
    b AS (SELECT *, CASE WHEN r_date_of_birth IS NOT NULL THEN {{'v': {_DASHED.format('r_date_of_birth.v')}, 'q': r_date_of_birth.q}} WHEN y_date_of_birth IS NOT NULL THEN {{'v': {_DASHED.format('y_date_of_birth')}, 'q': l_date_of_birth.q}}
        WHEN len(list_filter(days, lambda el: el.day < DATE '{AS_OF}')) > 0 THEN {{'v': {_DASHED.format(f"list_filter(days, lambda el: el.day < DATE '{AS_OF}')[1].t")}, 'q': 0.92::DOUBLE}} END AS b FROM a),
    i AS (SELECT *, list_filter(days, lambda el: el.day < DATE '{AS_OF}' AND regexp_replace(el.t, '[./]', '-', 'g') <> coalesce(b.v, '')) AS past, list_filter(days, lambda el: el.day >= DATE '{AS_OF}') AS later FROM b),
    j AS (SELECT *, CASE WHEN r_date_of_issue IS NOT NULL THEN {{'v': r_date_of_issue.v, 'q': r_date_of_issue.q}} WHEN y_date_of_issue IS NOT NULL THEN {{'v': y_date_of_issue, 'q': l_date_of_issue.q}} WHEN len(days) >= 2 AND len(past) > 0 THEN {{'v': past[-1].t, 'q': 0.88::DOUBLE}} END AS s,
        CASE WHEN r_date_of_expiry IS NOT NULL THEN {{'v': r_date_of_expiry.v, 'q': r_date_of_expiry.q}} WHEN y_date_of_expiry IS NOT NULL THEN {{'v': y_date_of_expiry, 'q': l_date_of_expiry.q}} WHEN len(later) > 0 THEN {{'v': later[-1].t, 'q': 0.94::DOUBLE}} WHEN len(days) >= 2 THEN {{'v': days[-1].t, 'q': 0.85::DOUBLE}} END AS x FROM i),
    y AS (SELECT *, list_filter(list_transform(generate_series(1, len(cs)), lambda n: CASE WHEN list_position(cs, cs[n]) = n THEN cs[n] END), lambda el: el IS NOT NULL) AS once FROM j)
    SELECT k, {_fields(('license_number', r"regexp_replace(upper(num), '[\s\-]', '', 'g')", _sure('num')), ('name', 'coalesce(nm.v, ln, an)', f"CASE WHEN nm IS NOT NULL THEN nm.q WHEN ln IS NOT NULL THEN l_name.q ELSE {_sure('an')} END"), ('date_of_birth', 'b.v', 'b.q'), ('date_of_issue', _DASHED.format('s.v'), 's.q'), ('date_of_expiry', _DASHED.format('x.v'), 'x.q'),
        ('vehicle_class', "CASE WHEN len(once) > 0 THEN array_to_string(once, ', ') ELSE l_vehicle_class.v END", 'CASE WHEN len(once) > 0 THEN 0.95 ELSE l_vehicle_class.q END'))} FROM y""",
)
def licence_regions(t):
    return _told(L.licence_fields(_documents(t, "LICENCE"), "regions", F.lit(AS_OF).cast("date")))


def _passport_name(v: str) -> str:
    noisy = " OR ".join(f"z = {_quoted(n)} OR starts_with(z, {_quoted(n + ' ')}) OR ends_with(z, {_quoted(' ' + n)})" for n in L.NAME_NOISE)
    return f"(SELECT CASE WHEN length(z) >= 2 AND NOT ({noisy}) AND NOT regexp_matches(z, '[0-9]') THEN {v} END FROM (SELECT upper({_TRIM.format(f'''regexp_replace(regexp_replace({v}, '{L.PARENTHESES}', '', 'g'), '/.*$', '')''')}) AS z))"


def _upto(v: str, pattern: str) -> str:
    return _TRIM.format(f"string_split_regex({v}, {_quoted(pattern)})[1]")


_SPOKEN = f"upper({_TRIM.format(f'''replace(regexp_replace({{0}}, '{L.PARENTHESES}', '', 'g'), '/', '')''')})"
_SEXED = "CASE WHEN starts_with({0}, 'M') OR {0} = 'HOMME' THEN 'M' WHEN starts_with({0}, 'F') THEN 'F' WHEN {0} IS NOT NULL THEN 'X' END"
_COUNTRY = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(upper(raw), '{w}')''' for w in words)} THEN {{{{'v': '{name}', 'q': {sure}::DOUBLE}}}}" for words, name, sure in L.COUNTRIES) + " END"
_COUNTRY = _COUNTRY.replace("{{", "{").replace("}}", "}")
_AS_DATE = lambda v: rf"coalesce(regexp_matches({v}, '\d') AND regexp_matches({v}, '[-/.]'), false)"


def _passport_sql() -> str:
    shown = {n: f"coalesce({_first(f'l_{n}.v', L.DAY)}, {_first(f'l_{n}.v', L.NAMED_DAY)}, {_TRIM.format(f'l_{n}.v')})" for n in ("date_of_birth", "date_of_issue", "date_of_expiry")}
    ordered = {"date_of_birth": f"CASE WHEN len(days) >= 2 OR (len(days) = 1 AND days[1].day < DATE '{AS_OF}') THEN days[1].t END", "date_of_issue": "CASE WHEN len(days) >= 3 THEN days[2].t END", "date_of_expiry": f"CASE WHEN len(days) >= 2 OR (len(days) = 1 AND NOT days[1].day < DATE '{AS_OF}') THEN days[-1].t END"}
    return rf"""WITH {_labelled('PASSPORT', L.LABELS)},
    a AS MATERIALIZED (SELECT *, {_first("replace(upper(l_passport_number.v), ' ', '')", L.NUMBER)} AS pl, {_first('raw', L.NUMBER)} AS pr, {_in_region(L.SEX_SHOWN)} AS g1, {_first(_TRIM.format(r"upper(regexp_replace(l_sex.v, '(?i)^[/\s]*SEXE\s*[:\s]*', ''))"), L.SEX)} AS g2,
        {_passport_name('l_surname.v')} AS s0, {_passport_name('l_given_name.v')} AS n0, {_passport_name('l_full_name.v')} AS f0, upper({_upto('l_nationality.v', L.ENDS['nationality'])}) AS c0, {_days()} AS days, {', '.join(f'{v} AS y_{n}' for n, v in shown.items())},
        nullif({_upto('l_place_of_birth.v', L.ENDS['place_of_birth'])}, '') AS b0, nullif({_upto('l_place_of_issue.v', L.ENDS['place_of_issue'])}, '') AS i0, nullif({_upto(_first('raw', L.PLACE_ANYWHERE), L.PLACE_ENDS)}, '') AS w0 FROM d),
    b AS MATERIALIZED (SELECT *, {_SPOKEN.format('s0')} AS sn, {_SPOKEN.format('n0')} AS gn, upper({_TRIM.format('f0')}) AS fn, {_SEXED.format('upper(g1.v)')} AS gs, {_SEXED.format('g2')} AS gl, {_COUNTRY} AS cr, upper({_passport_name('b0')}) AS pb, upper({_passport_name('i0')}) AS pi, upper({_passport_name('w0')}) AS pw,
        CASE WHEN regexp_matches(c0, '/|SURNAME|GIVEN|NAME|NOM|PASSPORT|CODE') OR c0 IN ('P', 'TYPE') THEN NULL WHEN c0 IN ('IND', 'INDIAN', 'INDIA') THEN 'INDIAN' WHEN length(c0) >= 2 THEN c0 END AS cl, {', '.join(f'{v} AS o_{n}' for n, v in ordered.items())} FROM a)
    SELECT k, {_fields(('passport_number', 'coalesce(pl, pr)', f"CASE WHEN pl IS NOT NULL THEN l_passport_number.q ELSE {_sure('pr')} END"), ('gender', 'coalesce(gs, gl)', 'CASE WHEN gs IS NOT NULL THEN g1.q ELSE l_sex.q END'), ('surname', 'sn', 'l_surname.q'), ('given_name', 'gn', 'l_given_name.q'),
        ('name', "CASE WHEN sn IS NOT NULL AND gn IS NOT NULL THEN gn || ' ' || sn ELSE coalesce(gn, sn, fn) END", 'CASE WHEN sn IS NOT NULL AND gn IS NOT NULL THEN least(l_surname.q, l_given_name.q) WHEN gn IS NOT NULL THEN l_given_name.q WHEN sn IS NOT NULL THEN l_surname.q ELSE l_full_name.q END'),
        ('nationality', 'coalesce(cl, cr.v)', 'CASE WHEN cl IS NOT NULL THEN l_nationality.q ELSE cr.q END'), *((n, f'CASE WHEN o_{n} IS NOT NULL AND NOT {_AS_DATE(f"y_{n}")} THEN o_{n} ELSE y_{n} END', f'CASE WHEN o_{n} IS NOT NULL AND NOT {_AS_DATE(f"y_{n}")} THEN 0.99 ELSE l_{n}.q END') for n in shown),
        ('place_of_birth', 'pb', 'l_place_of_birth.q'), ('place_of_issue', 'coalesce(pi, pw)', 'CASE WHEN pi IS NOT NULL THEN l_place_of_issue.q ELSE 0.88 END'))} FROM b"""


@query("f27_passport_regions", _passport_sql())
def passport_regions(t):
    return _told(L.passport_fields(_documents(t, "PASSPORT"), "regions", F.lit(AS_OF).cast("date")))


@query("f29_bilingual_cleaning", f"WITH t AS (SELECT c_custkey AS k, {REGIONS['PASSPORT']} AS text FROM customer), r AS (SELECT k, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t WHERE text IS NOT NULL) SELECT k, CAST(i AS INT) AS i, {_clean('text')} AS value, {_noise('text')} AS noise FROM r")
def bilingual_cleaning(t):
    """Each region without its second language, and whether it is only a label."""
    texts = t("customer").select(F.col("c_custkey").alias("k"), F.posexplode(F.split(F.expr(REGIONS["PASSPORT"]), "\n")).alias("i", "text"))
    return texts.select("k", (F.col("i") + 1).alias("i"), L.clean_value(F.col("text")).alias("value"), L.is_noise(F.col("text")).alias("noise"))
