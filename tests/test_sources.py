"""Files, sinks and pixel operators."""

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import pixels
from attesta.operators.validation import validate
from attesta.sources import files


def test_uploads(spark, tmp_path):
    for name, content in {"a.bin": b"%PDF-1.7 x", "b.txt": b"plain", "c.xyz": b"what", "e.jpg": b"\xff\xd8\xff\xe0"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.refused, r.content is not None) for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": ("PDF", None, True), "b.txt": ("TEXT", None, True), "c.xyz": (None, "UNKNOWN_KIND", False), "e.jpg": ("JPEG", None, True)}


def test_rulesets(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"required_fields": ["a"],\n "patterns": {"a": "^x$"}, "date_rules": {"b": {"must_be_past": true}}}')
    (tmp_path / "bad.json").write_text('{"patterns": {}}')
    got = {r.file.rsplit("/", 1)[1]: r for r in files.load_rulesets(spark, str(tmp_path)).collect()}
    assert got["good.json"].missing == [] and got["good.json"].rules.patterns == {"a": "^x$"}
    assert got["bad.json"].missing == ["required_fields", "date_rules"]


def test_documents_against_rulesets_from_files(spark, tmp_path):
    """A type of the user's own; files that lack a key, types without a file, null and empty fields."""
    (tmp_path / "badge_rules.json").write_text('{"required_fields": ["permit_number", "note"], "patterns": {"permit_number": "^B[0-9]+$", "gender": "^(?:M|F)$"}, "date_rules": {"date_of_birth": {"must_be_past": true}, "date_of_expiry": {"must_be_after_today": true, "must_be_after_dob": true}}}')
    (tmp_path / "broken_rules.json").write_text('{"patterns": {}}')
    docs = spark.sql("""SELECT * FROM VALUES
        (1, 'BADGE', map('permit_number', named_struct('value', ' b-1 2', 'confidence', 0.9D), 'note', named_struct('value', 'x', 'confidence', 0.7D), 'gender', named_struct('value', 'm', 'confidence', CAST(NULL AS DOUBLE)))),
        (2, 'badge', map('permit_number', named_struct('value', 'C1', 'confidence', 0.9D), 'note', named_struct('value', ' ', 'confidence', 0.9D), 'date_of_birth', named_struct('value', '01/01/2030', 'confidence', 0.9D), 'date_of_expiry', named_struct('value', '1 Jan 2027', 'confidence', 0.9D))),
        (3, 'broken', map('note', named_struct('value', 'x', 'confidence', 0.9D))), (4, NULL, NULL), (5, 'badge', NULL) AS t(id, document_type, fields)""").withColumn("rules", F.lit("mine")).withColumn("checks_", F.lit(1))
    got = {r.id: r for r in validate(docs, files.load_rulesets(spark, str(tmp_path)), F.lit("2026-01-01").cast("date")).collect()}
    told = {i: [f"{c.field}:{c.status}:{c.reason}" for c in r.checks] if r.checks is not None else None for i, r in got.items()}
    assert told[1] == ["permit_number:VALID:None", "note:VALID:None"] and got[1].valid and got[1].warnings == ["note"] and got[1].rules == "mine"
    assert told[2] == ["permit_number:INVALID:PATTERN", "note:MISSING:None", "date_of_birth:INVALID:FUTURE", "date_of_expiry:INCONSISTENT:BEFORE_BIRTH"] and not got[2].valid
    assert told[3] is None and told[4] is None and not got[3].valid and not got[4].valid
    assert told[5] == ["permit_number:MISSING:None", "note:MISSING:None"]


def test_known_rulesets_are_whole(spark):
    got = {r.document_type: r for r in files.known_rulesets(spark).collect()}
    assert sorted(got) == ["driving_license", "national_id", "passport", "permit", "visa"] and all(r.missing == [] for r in got.values())
    assert got["passport"].rules.date_rules["date_of_expiry"] == {"must_be_after_today": True, "must_be_after_dob": True} and len(got["visa"].rules.patterns) == 9


def test_sinks(spark, tmp_path):
    rows = spark.range(25).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    files.append_rows(rows, f"{tmp_path}/t", "k")
    files.append_rows(rows, f"{tmp_path}/t", "k")
    assert spark.read.parquet(f"{tmp_path}/t").where("k = 1").count() == 24
    report = files.dossier(rows, "k").orderBy("k").collect()
    assert report[0].document.startswith('{"k":0,"total":13,"items":[{"v":0},{"v":2}') and report[0].document.count('"v"') == 10
    files.write_evaluation(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 25


def test_noise(spark):
    rng = np.random.default_rng(0)
    flat = rng.normal(128, 2, (120, 120)).clip(0, 255).astype(np.uint8)
    pasted = flat.copy()
    pasted[40:80, 40:80] = rng.normal(128, 40, (40, 40)).clip(0, 255)
    assert np.allclose(pixels.box_mean(flat, 5)[10, 10], flat[8:13, 8:13].mean())
    rows = [(1, 120, 120, flat.tobytes()), (2, 120, 120, pasted.tobytes()), (3, 5, 5, b"x"), (4, 1, 1, None)]
    got = {r.image_id: r for r in pixels.noise(spark.createDataFrame([(i, h, w, bytearray(p) if p else None) for i, h, w, p in rows], "image_id long, height int, width int, pixels binary")).collect()}
    assert got[2].anomalous > 2 * got[1].anomalous and got[2].score > got[1].score and got[3].score is None and got[4].score is None
