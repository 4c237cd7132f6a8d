"""Files in and out: uploads, rulesets, appended rows, reports and evaluation tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.rulesets import RULES

#: Limits of an upload, and the first bytes (in hex) and extensions of the kinds accepted.
MOST_BYTES = 50 * 1024 * 1024
MAGIC = {"25504446": "PDF", "89504E47": "PNG", "FFD8FF": "JPEG", "49492A00": "TIFF", "4D4D002A": "TIFF", "424D": "BMP", "47494638": "GIF"}
EXTENSIONS = {"pdf": "PDF", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "tif": "TIFF", "tiff": "TIFF", "bmp": "BMP", "webp": "WEBP", "txt": "TEXT"}
#: Keys a ruleset has to have.
RULE_KEYS = ("required_fields", "patterns", "date_rules")


def file_kind(content: Column, path: Column) -> Column:
    """By the first bytes, or else by the extension; null for neither."""
    head = F.hex(F.substring(content, 1, 4))
    chain = None
    for magic, kind in MAGIC.items():
        chain = F.when(F.startswith(head, F.lit(magic)), kind) if chain is None else chain.when(F.startswith(head, F.lit(magic)), kind)
    named = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return chain.otherwise(F.element_at(named, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as path, length, kind, checksum, content and the reason a file is refused, or null. Refused files keep no content, empty ones are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = file_kind(F.col("content"), F.col("path"))
    reason = F.when(F.col("length") > MOST_BYTES, "TOO_LARGE").when(kind.isNull(), "UNKNOWN_KIND")
    rows = files.select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("checksum"), "content", reason.alias("refused"))
    return rows.withColumn("content", F.when(F.col("refused").isNull(), F.col("content")))


def _rulesets(raw: DataFrame) -> DataFrame:
    """Rulesets from ``file`` and ``value`` (JSON): document_type (the file's name before _rules.json), file, missing and rules."""
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    shape = "required_fields array<string>, patterns map<string,string>, date_rules map<string,map<string,boolean>>"
    kind = F.nullif(F.regexp_extract("file", r"([^/\\]+?)(?:_rules)?\.json$", 1), F.lit(""))
    return raw.select(kind.alias("document_type"), "file", F.array_except(F.array(*[F.lit(k) for k in RULE_KEYS]), keys).alias("missing"), F.from_json("value", shape).alias("rules"))


def load_rulesets(spark: SparkSession, path: str) -> DataFrame:
    """Rulesets (one JSON document a file, <document_type>_rules.json) with the keys that are missing in each; small, so joined by broadcast where Spark sees fit."""
    return _rulesets(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value")))


def known_rulesets(spark: SparkSession) -> DataFrame:
    """The rulesets that come with the library, as ``load_rulesets`` reads them from files."""
    return _rulesets(spark.createDataFrame([(f"{kind}_rules.json", json.dumps(rules)) for kind, rules in RULES.items()], "file string, value string"))


def append_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Appends rows to a table; ``by`` lays it out in folders that later filters prune."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def dossier(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """One JSON document per key with its first ``most`` rows in the order of all their columns."""
    rest = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(*rest))), 1, most).alias("items"), F.count("*").alias("total"))
    return packed.select(key, F.to_json(F.struct(key, "total", "items")).alias("document"))


def write_evaluation(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
