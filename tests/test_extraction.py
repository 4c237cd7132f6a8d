"""Dates, visual zones and labelled regions on hand-made cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, labelled, zones



def _now():
    return F.lit("2026-06-30").cast("date")


@pytest.mark.parametrize(
    "text, birth, expiry",
    [("260630", date(2026, 6, 30), date(2026, 6, 30)), ("270101", date(1927, 1, 1), date(2027, 1, 1)), ("560101", date(1956, 1, 1), date(2056, 1, 1)), ("570101", date(1957, 1, 1), date(1957, 1, 1)), ("310230", None, None), ("31/02/2020", None, None), ("29/02/2020", date(2020, 2, 29), date(2020, 2, 29)), ("29.02.2021", None, None), (" 2020-02-29T10:00 ", date(2020, 2, 29), date(2020, 2, 29)), ("2020-13-01", None, None),
     ("14 November 2003", date(2003, 11, 14), date(2003, 11, 14)), ("14th of Nov, 2003", date(2003, 11, 14), date(2003, 11, 14)), ("nov 14 2003", date(2003, 11, 14), date(2003, 11, 14)), ("05/25/2001", date(2001, 5, 25), date(2001, 5, 25)), ("14-11-76", date(1976, 11, 14), date(1976, 11, 14)), ("14-11-75", date(2075, 11, 14), date(2075, 11, 14)), ("20031114", date(2003, 11, 14), date(2003, 11, 14)), ("", None, None), (None, None, None), ("soon", None, None)],
)
def test_dates(spark, text, birth, expiry):
    row = spark.createDataFrame([(text,)], "t string").select(dates.parse_date(F.col("t"), _now()).alias("b"), dates.parse_date(F.col("t"), _now(), True).alias("e")).first()
    assert (row.b, row.e) == (birth, expiry)


def test_zone_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "x" * 100_000 + "\nVisa No: V1234567"), (4, "x" * 100_000 + "\nVisa No: V1234567")], "id int, text string")
    got = zones.zone(docs, "text", "VISA", 56).collect()
    assert sorted((r.id, r.visa_number.value, r.visa_number.confidence) for r in got) == sorted([(1, None, 0.0), (2, None, 0.0), (3, None, 0.0), (4, "V1234567", 0.92), (4, "V1234567", 0.92)], key=repr)
    assert zones.zone(docs.limit(0), "text", "PERMIT", 56).count() == 0


REGIONS = "id int, regions array<struct<text:string,confidence:double>>"


def test_a_label_leads_to_the_next_value(spark):
    rows = [(1, [("Expiry", 0.9), ("Type", 0.8), ("(s)", 0.7), ("/ Sexe", 0.6), ("Late", 0.5), ("Date of issue", 0.4), ("code", 0.3), ("P", 0.2), ("1 Jan 2020 at noon", 0.1)]), (2, []), (3, None), (4, [(None, 0.5), ("surname: Roe", None)])]
    docs = spark.createDataFrame(rows, REGIONS).withColumn("mine", F.lit("kept"))
    got = {r.id: r for r in labelled.passport_fields(docs, "regions", _now()).collect()}
    assert got[1].date_of_expiry is None and got[1].mine == "kept"  # three labels follow it
    assert tuple(got[1].date_of_issue) == ("1 Jan 2020", 0.1, "1 Jan 2020 at noon")
    assert got[2].name is None and got[3].passport_number is None
    assert (got[4].surname.value, got[4].surname.confidence) == ("ROE", None)
    assert labelled.visa_fields(docs.limit(0), "regions").count() == 0


def test_cleaning(spark):
    cases = {"/ Nationalité: INDIAN (x)": (": INDIAN", False), "Surname / Nom": ("Surname", False), " / sexe ": ("", True), "(S) date of birth": ("date of birth", True), "P": ("P", True), None: ("", True), "Pune": ("Pune", False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.v, r.n) for r in df.select("t", labelled.clean_value(F.col("t")).alias("v"), labelled.is_noise(F.col("t")).alias("n")).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in cases.items()} and got["Surname / Nom"][0] == "Surname" and got["Pune"][0] == "Pune"


def test_regions_are_worked_out_once_and_by_many_tasks(spark):
    """Whatever looks into all regions of a document does so on values that are there already; documents from one small file go to all cores."""
    from attesta.plans import regions
    from tests.oracle import DATA

    assert str(labelled.seen(F.col("r"))).count("PAYS") == 2  # its two subtitles
    assert str(labelled.searched(F.col("r"), F.col("raw"), labelled.STAY)).count("month") == 2  # within one pattern
    docs = regions._documents(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"), "VISA")
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    long = spark.createDataFrame([(1, [("Surname / Nom", 0.5)] * 1500 + [("Late", 0.4)])], REGIONS)
    assert labelled.visa_fields(long, "regions").first().surname.value == "LATE"
