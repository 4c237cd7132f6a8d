"""Record-level rules: checksums, dates, machine-readable zones, validators, text classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import checks as C
from attesta.functions import dates, mrz, text
from attesta.plans import query

AS_OF = "1998-01-01"
#: Pivot of two-digit years: later ones are of the last century.
PIVOT = 30

_WEIGHTED = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: (CASE WHEN regexp_matches(substr(upper({0}), i, 1), '[0-9]') THEN ascii(substr({0}, i, 1)) - 48 WHEN regexp_matches(substr(upper({0}), i, 1), '[A-Z]') THEN ascii(substr(upper({0}), i, 1)) - 55 ELSE 0 END) * (CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END))) % 10"


def _icao(x: str) -> str:
    return f"CAST({_WEIGHTED.format(x)} AS INT)"


#: Lines of a passport of every customer: number, birth and expiry from the key, every fifth with a wrong digit.
_BASE_SQL = "SELECT c_custkey AS k, chr(65 + CAST(c_custkey % 26 AS INT)) || lpad(CAST(c_custkey * 37 % 10000000 AS VARCHAR), 7, '0') || '<' AS number, lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS born, lpad(CAST((c_custkey * 3 + 7) % 100 AS VARCHAR), 2, '0') || '0629' AS expires FROM customer"
_LINE2_SQL = f"b.number || CAST(({_icao('b.number')} + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) || 'IND' || b.born || CAST({_icao('b.born')} AS VARCHAR) || CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END || b.expires || CAST({_icao('b.expires')} AS VARCHAR)"


def _base(t):
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return t("customer").select(
        k.alias("k"),
        F.concat(F.chr((65 + k % 26).cast("int")), pad(k * 37 % 10000000, 7), F.lit("<")).alias("number"),
        F.concat(pad(k % 97, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2)).alias("born"),
        F.concat(pad((k * 3 + 7) % 100, 2), F.lit("0629")).alias("expires"),
    )


def _line2(wrong: bool = False):
    """Line two of the zone; ``wrong`` spoils the number's digit of every fifth."""
    digit = lambda c, more=0: ((C.icao_digit(F.col(c)) + more) % 10).cast("string")
    spoilt = F.when(F.col("k") % 5 == 0, 1).otherwise(0) if wrong else 0
    return F.concat("number", digit("number", spoilt), F.lit("IND"), "born", digit("born"), F.when(F.col("k") % 2 == 0, "M").otherwise("F"), "expires", digit("expires"))


@query("f1_icao_digit", f"SELECT k, number, {_icao('number')} AS digit FROM ({_BASE_SQL})")
def icao_digit(t):
    return _base(t).select("k", "number", C.icao_digit(F.col("number")).alias("digit"))


def _verhoeff_sql(x: str) -> str:
    table = lambda rows: "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in rows) + "]"
    # positions from the right, checked pairwise through the group table
    digits = f"list_transform(range(1, 13), lambda i: {table(C.VERHOEFF_P)}[((i - 1) % 8) + 1][CAST(substr({x}, 13 - i, 1) AS INT) + 1])"
    return f"list_reduce(list_prepend(0, {digits}), lambda a, p: {table(C.VERHOEFF_D)}[a + 1][p + 1]) = 0"


_NUMBERS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'XXXXXXXX' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') WHEN o_orderkey % 13 = 0 THEN 'ID' || CAST(o_orderkey AS VARCHAR) ELSE CAST(100000000000 + (o_orderkey * 7919 * 104729) % 899999999999 AS VARCHAR) END AS number FROM orders"


def _numbers(t):
    k = F.col("o_orderkey")
    full = (F.lit(100000000000) + (k * 7919 * 104729) % F.lit(899999999999)).cast("string")
    masked = F.concat(F.lit("XXXXXXXX"), F.lpad((k % 10000).cast("string"), 4, "0"))
    number = F.when(k % 11 == 0, None).when(k % 7 == 0, masked).when(k % 13 == 0, F.concat(F.lit("ID"), k.cast("string"))).otherwise(full)
    return t("orders").select(k.alias("k"), number.alias("number"))


@query("f3_verhoeff", f"SELECT k, number, CASE WHEN regexp_full_match(number, '[0-9]{{12}}') THEN {_verhoeff_sql('number')} ELSE false END AS valid FROM ({_NUMBERS})")
def verhoeff(t):
    return _numbers(t).select("k", "number", C.verhoeff_valid(F.col("number")).alias("valid"))


@query(
    "f4_aadhaar_rule",
    f"SELECT k, CASE WHEN number IS NULL THEN 'MISSING_AADHAAR_IDENTIFIER' WHEN regexp_full_match(number, '[01][0-9]{{11}}') THEN 'AADHAAR_INVALID_PREFIX' WHEN regexp_full_match(number, '[0-9]{{12}}') THEN CASE WHEN NOT {_verhoeff_sql('number')} THEN 'VERHOEFF_CHECKSUM_FAILURE' END WHEN NOT regexp_full_match(number, '[xX*]{{8}}[0-9]{{4}}') THEN 'NATIONAL_ID_FORMAT_MISMATCH' END AS rule FROM ({_NUMBERS})",
)
def aadhaar_rule(t):
    return _numbers(t).select("k", C.aadhaar_rule(F.col("number")).alias("rule"))


_LICENCES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 'KA-' WHEN 1 THEN 'mh ' WHEN 2 THEN 'ZZ' ELSE 'DL' END || lpad(CAST(c_custkey * 104729 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 13 END, '0') END AS number FROM customer"


@query("f5_licence_rule", f"SELECT k, CASE WHEN number IS NULL THEN 'MISSING_LICENSE_IDENTIFIER' WHEN NOT regexp_full_match(c, '[A-Z]{{2}}[0-9]{{13,15}}') OR left(c, 2) NOT IN ({', '.join(repr(s) for s in C.STATES)}) THEN 'DRIVING_LICENSE_FORMAT_MISMATCH' END AS rule FROM (SELECT *, upper(regexp_replace(number, '[\\s-]', '', 'g')) AS c FROM ({_LICENCES}))")
def licence_rule(t):
    k = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("KA-", "mh ", "ZZ", "DL")]), (k % 4 + 1).cast("int"))
    digits = F.when(k % 3 == 0, F.lpad((k * 104729).cast("string"), 12, "0")).otherwise(F.lpad((k * 104729).cast("string"), 13, "0"))
    return t("customer").select(k.alias("k"), C.licence_rule(F.when(k % 10 != 0, F.concat(state, digits))).alias("rule"))


_SPELT = "SELECT o_orderkey AS k, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d ') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, ' %Y') WHEN 3 THEN strftime(o_orderdate, '%y%m%d') ELSE 'circa ' || strftime(o_orderdate, '%Y') END AS spelt FROM orders"


@query("f8_standard_date", f"SELECT k, spelt, CASE WHEN k % 5 = 4 THEN spelt ELSE strftime(d, '%Y-%m-%d') END AS standard FROM ({_SPELT})")
def standard_date(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    form = lambda p: F.date_format(d, p)
    spelt = F.when(k % 5 == 0, form("yyyy-MM-dd")).when(k % 5 == 1, form("dd/MM/yyyy")).when(k % 5 == 2, F.upper(form("dd MMM yyyy"))).when(k % 5 == 3, form("yyMMdd")).otherwise(F.concat(F.lit("circa "), form("yyyy")))
    return t("orders").select(k.alias("k"), spelt.alias("spelt")).withColumn("standard", dates.standard_date(F.col("spelt"), PIVOT))


@query("f11_expiry_status", f"SELECT o_orderkey, CASE WHEN e < DATE '{AS_OF}' THEN 'EXPIRED' WHEN e < DATE '{AS_OF}' + 180 THEN 'NEAR_EXPIRY' ELSE 'VALID' END AS status FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 400 AS e FROM orders)")
def expiry_status(t):
    return t("orders").select("o_orderkey", dates.expiry_status(F.date_add(F.to_date("o_orderdate"), 400), F.lit(AS_OF).cast("date")).alias("status"))


@query("f12_birth", f"SELECT o_orderkey, CASE WHEN b > DATE '{AS_OF}' THEN 'INVALID_FUTURE_DOB' ELSE 'VALID' END AS status, CAST(floor(date_diff('day', b, DATE '{AS_OF}') / 365.25) AS BIGINT) AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b FROM orders)")
def birth(t):
    b, now = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    return t("orders").select("o_orderkey", dates.birth_status(b, now).alias("status"), dates.age_years(b, now).cast("long").alias("age"))


_LISTED = "SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Indian' WHEN 1 THEN 'UNITED STATES' WHEN 2 THEN 'Name / Nom' WHEN 3 THEN 'GBR<' WHEN 4 THEN 'F' ELSE 'Canadian' END AS visual, CASE c_custkey % 4 WHEN 0 THEN 'IND' WHEN 1 THEN 'USA' WHEN 2 THEN 'GBR' ELSE 'CAN' END AS zone FROM customer"


@query(
    "f16_nationality",
    f"SELECT k, CASE WHEN contains(lower(visual), '/') OR contains(lower(visual), 'name') OR length(trim(visual)) < 2 THEN true ELSE false END AS noisy, CASE k % 6 WHEN 0 THEN 'IND' WHEN 1 THEN 'USA' WHEN 2 THEN 'NAME/NOM' WHEN 3 THEN 'GBR' WHEN 4 THEN 'F' ELSE 'CAN' END AS code, CASE k % 6 WHEN 0 THEN 'IND' WHEN 1 THEN 'USA' WHEN 2 THEN 'NAME/NOM' WHEN 3 THEN 'GBR' WHEN 4 THEN 'F' ELSE 'CAN' END <> zone AS differs FROM ({_LISTED})",
)
def nationality(t):
    k = F.col("c_custkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    visual, zone = pick(("Indian", "UNITED STATES", "Name / Nom", "GBR<", "F", "Canadian"), 6), pick(("IND", "USA", "GBR", "CAN"), 4)
    return t("customer").select(k.alias("k"), C.noisy_nationality(visual).alias("noisy"), C.canonical_nationality(visual).alias("code"), (C.canonical_nationality(visual) != zone).alias("differs"))


@query("f14_f15_cross_field", "SELECT c_custkey AS k, c_custkey % 3 = 0 AS number_differs, c_custkey % 4 = 0 AS name_differs FROM customer")
def cross_field(t):
    """Visual against machine-readable fields: spaces, fillers and case don't matter to numbers, order doesn't to names."""
    k = F.col("c_custkey")
    number = F.concat(F.lit("P"), F.lpad(k.cast("string"), 7, "0"))
    seen = F.when(k % 3 == 0, F.concat(number, F.lit("9"))).otherwise(F.concat(F.lower(number), F.lit(" <")))
    name = F.when(k % 4 == 0, "Somebody Else").otherwise("second-name, FIRST")
    return t("customer").select(k.alias("k"), C.numbers_differ(number, seen).alias("number_differs"), C.names_differ(F.lit("FIRST<OTHER"), name).alias("name_differs"))


_YEAR = "CASE WHEN CAST(left({0}, 2) AS INT) > 30 THEN '19' ELSE '20' END || left({0}, 2) || '-' || substr({0}, 3, 2) || '-' || right({0}, 2)"


@query(
    "f20_passport_zone",
    f"SELECT k, 'IND' AS country, 'CUSTOMER' AS surname, 'NO ' || CAST(k AS VARCHAR) AS given_names, left(number, 8) AS number, 'IND' AS nationality, {_YEAR.format('born')} AS date_of_birth, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sex, {_YEAR.format('expires')} AS date_of_expiry, k % 5 <> 0 AS valid FROM ({_BASE_SQL})",
)
def passport_zone(t):
    line1 = F.rpad(F.concat(F.lit("P<INDCUSTOMER<<NO<"), F.col("k").cast("string")), 44, "<")
    rows = _base(t).withColumn("z", mrz.passport(line1, F.rpad(_line2(wrong=True), 44, "<"), "strict", PIVOT))
    return rows.select("k", *[f"z.{c}" for c in ("country", "surname", "given_names", "number", "nationality", "date_of_birth", "sex", "date_of_expiry", "valid")])


@query("f20_line_digits", f"SELECT k, {_LINE2_SQL} AS line2 FROM ({_BASE_SQL}) AS b")
def line_digits(t):
    return _base(t).select("k", _line2(wrong=True).alias("line2"))


@query("f22_visa_zone", f"SELECT k, CASE WHEN k % 2 = 0 THEN 'MRV_A' ELSE 'MRV_B' END AS format, left(number, 8) AS number, CASE WHEN k % 2 = 0 THEN 'A1234567' END AS passport_number, true AS valid FROM ({_BASE_SQL})")
def visa_zone(t):
    """Even keys have long lines and a passport number, odd ones short lines."""
    even = F.col("k") % 2 == 0
    line1 = F.when(even, F.rpad(F.lit("V<INDCUSTOMER<<ONE"), 44, "<")).otherwise("V<INDCUSTOMER<<ONE")
    line2 = F.concat(_line2(), F.when(even, "A1234567").otherwise(""))
    z = mrz.visa(line1, line2, PIVOT)
    return _base(t).withColumn("z", z).select("k", "z.format", "z.number", "z.passport_number", "z.valid")


@query("f19_candidate_lines", "SELECT c_custkey AS k, 'P<IND' || CAST(c_custkey AS VARCHAR) || '<<X' AS line FROM customer")
def candidate_lines(t):
    """From noisy OCR text the line that is a zone's."""
    raw = F.concat(F.lit("some label\np [ind "), F.col("c_custkey").cast("string"), F.lit("_]x\nother"))
    lines = F.filter(F.transform(F.split(raw, "\n"), mrz.candidate_line), lambda x: x.rlike("^P<"))
    return t("customer").select(F.col("c_custkey").alias("k"), F.get(lines, F.lit(0)).alias("line"))


@query("f28_normalise", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '‘’“”–—', '''''""--'), '\r\n?', chr(10), 'g'), '[\t\f]', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS clean FROM documents")
def normalise(t):
    return t("documents").select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("clean"))


_CASES = ("UNION OF INDIA driving licence", "Inner Line Permit no 5", "id 1234 5678 9012 x", "Entry visa", "P<INDDOE<<JOHN", "nothing here")
_KINDS = ("DRIVING_LICENSE", "PERMIT", "NATIONAL_ID", "VISA", "PASSPORT", "UNKNOWN")


@query("f30_document_type", "SELECT c_custkey AS k, CASE WHEN c_custkey % 12 = 11 THEN 'DRIVING_LICENSE' ELSE CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END END AS kind FROM customer")
def document_type(t):
    """Six texts in turn; of those with nothing in them every second has a telling file name."""
    k = F.col("c_custkey")
    body = F.element_at(F.array(*[F.lit(c) for c in _CASES]), (k % 6 + 1).cast("int"))
    return t("customer").select(k.alias("k"), text.document_type(body, F.when(k % 12 == 11, "scans/dl_0042.png").otherwise("scan.png")).alias("kind"))


@query("s9_file_kind", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'PNG' WHEN 2 THEN 'JPEG' ELSE 'TEXT' END AS kind FROM customer")
def file_kind(t):
    """Magic bytes first, the extension where they say nothing."""
    k = F.col("c_custkey")
    content = F.when(k % 4 == 0, F.lit(b"%PDF-1.7")).when(k % 4 == 1, F.lit(b"\x89PNG\r\n\x1a\n")).when(k % 4 == 2, F.lit(b"\xff\xd8\xff\xe0")).otherwise(F.lit(b"hello"))
    name, head = F.lit("upload.txt"), F.hex(F.substring(content, 1, 4))
    kind = F.when(head == "25504446", "PDF").when(head == "89504E47", "PNG").when(F.startswith(head, F.lit("FFD8FF")), "JPEG").when(F.endswith(name, F.lit(".txt")), "TEXT").otherwise("UNKNOWN")
    return t("customer").select(k.alias("k"), kind.alias("kind"))


@query("s19_encrypted_roundtrip")
def encrypted_roundtrip(t):
    """AES-GCM with a key given by the caller; the digest of the plain bytes is checked after decryption."""
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    rows = t("customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"), F.aes_encrypt(F.encode("c_name", "UTF-8"), key, F.lit("GCM")).alias("sealed"))
    plain = F.decode(F.aes_decrypt("sealed", key, F.lit("GCM")), "UTF-8")
    return rows.select("c_custkey", (F.sha2(plain, 256) == F.col("digest")).alias("intact"))
