"""Golden strings, plain-Python twins and edge cases of record rules."""

import random
from datetime import date

from pyspark.sql import functions as F

from attesta.functions import checks, dates, mrz, text
from attesta.operators import decisions, geometry
from attesta.operators import relational as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_passport_layouts(spark):
    name = F.lit("P<INDDOE<<JANE<MARY<<<<<<<<<<<<<<<<<<<<<<<<<")
    new = one(spark, mrz.passport(name, F.lit("AT983807<0IND0608266M36062963067652860226<36"), "new").alias("z")).z
    assert (new.number, new.date_of_birth, new.date_of_expiry, new.sex, new.personal_number, new.valid) == ("AT983807", "2006-08-26", "2036-06-29", "M", "3067652860226", True)
    assert (new.country, new.surname, new.given_names) == ("IND", "DOE", "JANE MARY")
    old = one(spark, mrz.passport(name, F.lit("E7251023<2IND8101246M13111303<<<<<<<<<<<<<<2"), "old").alias("z")).z
    assert (old.number, old.date_of_birth, old.date_of_expiry, old.valid) == ("E7251023", "1981-01-24", "2013-11-13", True)


def test_visas(spark):
    a = one(spark, mrz.visa(F.lit("V<USADOE<<JOHN<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<"), F.lit("12345678<8USA8501019M3001019A1234567<<<<<<<<")).alias("z")).z
    assert (a.format, a.number, a.passport_number, a.date_of_birth, a.date_of_expiry, a.valid) == ("MRV_A", "12345678", "A1234567", "1985-01-01", "2030-01-01", True)
    b = one(spark, mrz.visa(F.lit("V<GBRDOE<<JANE"), F.lit("V9876543<1GBR9005156F2812313<<<<<<<<")).alias("z")).z
    assert (b.format, b.number, b.nationality, b.sex, b.valid) == ("MRV_B", "V9876543", "GBR", "F", True)
    for wrong in "35":
        assert not one(spark, mrz.visa(F.lit("V<USADOE<<JOHN<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<"), F.lit(f"12345678<{wrong}USA8501019M3001019A1234567<<<<<<<<")).alias("z")).z.valid


def test_checksums_against_python(spark):
    rng = random.Random(3)
    numbers = ["".join(rng.choices("0123456789", k=12)) for _ in range(200)] + ["", "12", None, "1234 5678 9012", "ABC"]

    def verhoeff(x):
        x = "".join((x or "").split())
        if len(x) != 12 or not x.isdigit():
            return False
        c = 0
        for i, d in enumerate(reversed(x)):
            c = checks.VERHOEFF_D[c][checks.VERHOEFF_P[i % 8][int(d)]]
        return c == 0

    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", checks.verhoeff_valid(F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [verhoeff(r.n) for r in got]

    def icao(x):
        return sum((int(c) if c.isdigit() else ord(c) - 55 if c.isascii() and c.isalpha() else 0) * (7, 3, 1)[i % 3] for i, c in enumerate(x.upper())) % 10

    fields = ["".join(rng.choices("<0123456789ABCXYZ", k=9)) for _ in range(200)]
    got = spark.createDataFrame([(f,) for f in fields], "f string").select("f", checks.icao_digit(F.col("f")).alias("d")).collect()
    assert [r.d for r in got] == [icao(r.f) for r in got]


def test_digit_modes(spark):
    said = {m: [one(spark, checks.digit_accepted(F.lit(c), F.lit(e), m).alias("x")).x for c, e in (("4", 4), ("<", 0), ("<", 4), ("0", 4))] for m in ("strict", "filler", "old", "new")}
    assert said == {"strict": [True, False, False, False], "filler": [True, True, False, False], "old": [True, True, True, False], "new": [True, True, True, True]}


def test_dates(spark):
    cases = {"2020-02-31": "2020-02-31", "31/02/2020": "2020-02-31", "1.2.1999": "1999-02-01", "14 may 1995": "1995-05-14", "14-XXX-1995": "14-XXX-1995", "500101": "1950-01-01", "260101": "2026-01-01", "": "", "soon": "soon"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dates.standard_date(F.col("t"), 30).alias("d")).collect()
    assert {r.t: r.d for r in got} == cases
    now = F.lit(date(2024, 1, 1))
    assert [one(spark, dates.expiry_status(F.lit(d), now).alias("s")).s for d in (date(2023, 12, 31), date(2024, 1, 1), date(2024, 6, 28), date(2024, 6, 29), None)] == ["EXPIRED", "NEAR_EXPIRY", "NEAR_EXPIRY", "VALID", None]


def test_text(spark):
    assert one(spark, text.normalise(F.lit("a\x00\t\t b\r\n\r\n\r\nc “d” ")).alias("t")).t == 'a b\n\nc "d"'
    assert one(spark, text.document_type(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("t")).t == "UNKNOWN"


def test_geometry(spark):
    box = lambda p, x, y, w, h: [F.lit(v).alias(f"{p}{c}") for c, v in zip("xywh", (x, y, w, h), strict=True)]
    r = spark.range(1).select(*box("a_", 0, 0, 10, 10), *box("b_", 5, 0, 10, 10), *box("c_", 50, 50, 5, 5))
    r = r.select(geometry.iou("a_", "a_").alias("same"), geometry.iou("a_", "b_").alias("half"), geometry.iou("a_", "c_").alias("none"), geometry.smaller_overlap("a_", "b_").alias("small")).first()
    assert (r.same, round(r.half, 6), r.none, r.small) == (1.0, 0.333333, 0.0, 0.5)


def test_risk_levels_and_monotony(spark):
    rows = spark.range(101).select("id", decisions.level(F.col("id"), decisions.IMAGE_LEVELS).alias("l")).collect()
    assert {r.l for r in rows if r.id in (85, 65, 40, 10)} == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    s = {k: F.lit(None).cast("int") for k in decisions.DETECTORS}
    scores = [r.s for r in spark.range(101).select(decisions.overall_score(s | {"splicing": F.col("id").cast("int")}, F.lit(0), F.lit(0)).alias("s")).collect()]
    assert scores == sorted(scores) and scores[0] == 0 and scores[-1] == 96


def test_relational_blocks_on_edges(spark):
    empty = spark.createDataFrame([], "k int, at int, v string")
    assert R.latest_one(empty, ["k"], ["at"]).count() == 0 and R.latest_ties(empty, ["k"], "at").count() == 0
    assert R.page_counts(empty, 10).first().asDict() == {"total": 0, "total_pages": 1}
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "c", True)], "k int, at int, v string, gone boolean")
    assert [tuple(r) for r in R.replaced_by_latest(log, ["k"], ["at"], "gone").collect()] == [(1, 2, "b")]
