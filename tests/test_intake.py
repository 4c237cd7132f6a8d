"""Regions and findings on written cases."""

from pyspark.sql import functions as F

from attesta.functions import findings as N
from attesta.operators import regions as G


def test_checks_of_every_kind(spark):
    schema = "id int, valid boolean, formed boolean, errors array<string>, checks array<struct<field:string,status:string,message:string,confidence:double>>"
    rows = [
        (1, False, False, ["e"], [("passport_number", "invalid", None, 0.5), ("issue_date", "missing", "m", None), ("visa_number", "missing", None, None)]),
        (2, False, True, ["e"], [("issue_date", "inconsistent", "odd", None), (None, "invalid", None, None)]),
        (3, None, None, None, None),
    ]
    found = F.col("f")
    df = spark.createDataFrame(rows, schema).withColumn("f", N.folded_checks(F.col("checks"), F.col("valid"), F.col("errors"), F.col("formed"), F.lit("VISA")))
    got = {r.id: ([(f.rule, f.severity, f.impact) for f in r.f], r.total, r.ok) for r in df.select("id", "f", N.total_impact(found).alias("total"), N.passes(found).alias("ok")).collect()}
    assert got[1] == ([("AI_REGULATORY_VALIDATION_FAILURE", "CRITICAL", 35), ("AI_VALIDATION_PASSPORT_NUMBER", "CRITICAL", 25), ("AI_MISSING_VISA_NUMBER", "CRITICAL", 30), ("AI_VALIDATION_ERROR", "HIGH", 20)], 40, False)
    assert got[2] == ([("AI_VALIDATION_ISSUE_DATE", "MEDIUM", 0), ("AI_VALIDATION_RULE", "MEDIUM", 0)], 0, True)
    assert got[3] == ([], 0, True)


def test_nested_and_folded(spark):
    box = "struct<id:int,x:int,y:int,w:int,h:int,score:double,severity:string>"
    boxes = [(1, 0, 0, 100, 100, 0.2, "LOW"), (2, 10, 10, 20, 20, 0.9, "HIGH"), (3, 95, 95, 50, 50, 0.5, "MEDIUM"), (4, 300, 0, 10, 10, 0.7, "LOW")]
    df = spark.createDataFrame([(boxes,), ([],)], f"r array<{box}>")
    got = df.select(G.without_nested(F.col("r"))["id"].alias("a"), G.folded_splices(F.col("r")).alias("b"), G.numbered(F.transform("r", lambda r: F.struct(r["id"].alias("id"), r["severity"].alias("severity"), F.lit(1).alias("detectors"), r["score"].alias("signal")))).alias("c")).collect()
    assert got[0].a == [1, 3, 4] and [(b.id, b.score, b.severity) for b in got[0].b] == [(1, 0.9, "HIGH"), (4, 0.7, "LOW"), (3, 0.5, "MEDIUM")]
    assert [(c.id, c.region_id) for c in got[0].c] == [(2, "R001"), (3, "R002"), (4, "R003"), (1, "R004")]
    assert (got[1].a, got[1].b, got[1].c) == ([], [], [])


def test_layouts_and_dates(spark):
    rows = [("Passport K1234567", None, None, "OLD_FORMAT"), ("AB123456", None, None, "NEW_FORMAT"), ("A123456 country code", None, None, "OLD_FORMAT"), (None, "AT983807<0IND0608266M36062963067652860226<36", "P<IND", "NEW_FORMAT"), (None, "P<IND", "E7251023<2IND8101246M13111303<<<<<<<<<<<<<<2", "OLD_FORMAT")]
    df = spark.createDataFrame(rows, "text string, line1 string, line2 string, want string")
    assert all(r.got == r.want for r in df.select("want", N.passport_layout(F.col("text"), F.col("line1"), F.col("line2")).alias("got")).collect())
    dates = spark.createDataFrame([("260101", "01/01/2026"), ("510230", "30/02/2051"), ("520101", "01/01/1952"), ("26010", "26010"), (None, "")], "d string, want string")
    assert all(r.got == r.want for r in dates.select("want", N.shown_date(F.col("d"), 2026).alias("got")).collect())
