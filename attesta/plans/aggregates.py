"""Telemetry counts, roll-ups, evaluation figures and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import relational as R
from attesta.plans import query


@query(
    "a1_telemetry",
    "SELECT count(*) AS events, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'login' OR value >= 50) AS alerts, CAST(CASE WHEN count(*) = 0 THEN 94 ELSE floor(100.0::DOUBLE * count_if(event_type = 'login') / count(*) + 0.5) END AS BIGINT) AS success_rate FROM events",
)
def telemetry(t):
    """All counts of a table in one scan; the rate is 94 where there is nothing to count."""
    n, good = F.count("*"), F.count_if(F.col("event_type") == "login")
    rate = F.when(n == 0, 94).otherwise(F.floor(100.0 * good / n + 0.5)).cast("long")
    return t("events").agg(n.alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if((F.col("event_type") == "login") | (F.col("value") >= 50)).alias("alerts"), rate.alias("success_rate"))


@query("a4_joined_count", "SELECT count(*) AS total FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' AND c_nationkey < 10")
def joined_count(t):
    return t("events").where("event_type = 'view'").join(t("customer").where("c_nationkey < 10"), F.col("user_id") == F.col("c_custkey")).agg(F.count("*").alias("total"))


@query("a5_counts_per_parent", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS documents FROM customer")
def counts_per_parent(t):
    """Zero where a parent has none."""
    n = t("orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("documents"))


@query("a6_latest_times", "SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")
def latest_times(t):
    return t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))


@query("a7_next_version", "SELECT o_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next_version FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25 GROUP BY o_orderkey")
def next_version(t):
    last = t("lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("v"))
    return t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@query("a11_types", "SELECT coalesce(nullif(event_type, 'logout'), 'OTHER') AS kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY 1")
def types(t):
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("logout")), F.lit("OTHER"))
    return R.share_of_total(t("events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")), "n", "percent")


@query("a12_average_risk", "SELECT CAST(floor(avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 100 WHEN o_orderkey % 3 = 0 THEN 75 ELSE 0 END) + 0.5) AS BIGINT) AS average_risk FROM orders")
def average_risk(t):
    """The score, or 75 for tampered documents without one; over all rows."""
    key = F.col("o_orderkey")
    risk = F.when(key % 4 != 0, key % 100).when(key % 3 == 0, 75).otherwise(0)
    return t("orders").agg(F.floor(F.avg(risk) + 0.5).cast("long").alias("average_risk"))


@query("a13_flagged", "SELECT o_orderpriority AS kind, count_if(o_totalprice > 200000) AS flagged, count_if(o_totalprice <= 200000) AS clean, round(100.0::DOUBLE * count_if(o_totalprice > 200000) / count(*), 6) AS percent FROM orders GROUP BY 1")
def flagged(t):
    hit = F.col("o_totalprice") > 200000
    return t("orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_if(hit).alias("flagged"), F.count_if(~hit).alias("clean"), F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("percent"))


@query("a14_storage", "SELECT CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def storage(t):
    return t("documents").agg(F.sum("n_chars").alias("bytes"))


@query(
    "a15_field_confidence",
    "SELECT l_orderkey, coalesce(floor(avg(CASE WHEN c > 0 THEN c END) + 0.5), 90) / 100 AS confidence FROM (SELECT l_orderkey, CAST(round(l_discount * 1000) AS BIGINT) AS c FROM lineitem UNION ALL SELECT l_orderkey, CAST(round(l_tax * 1000) AS BIGINT) FROM lineitem) GROUP BY 1",
)
def field_confidence(t):
    """Mean of the positive confidences of a document's fields, 0.90 without any."""
    return _confidence(t("lineitem"))


def _confidence(lines):
    c = F.explode(F.array(F.round(F.col("l_discount") * 1000).cast("long"), F.round(F.col("l_tax") * 1000).cast("long")))  # in hundredths
    rows = lines.select("l_orderkey", c.alias("c"))
    return rows.groupBy("l_orderkey").agg((F.coalesce(F.floor(F.avg(F.when(F.col("c") > 0, F.col("c"))) + 0.5), F.lit(90)) / 100).alias("confidence"))


_PAGES = "SELECT l_orderkey AS document_id, l_linenumber AS page, CAST(l_quantity AS DOUBLE) / 50 AS score FROM lineitem"


@query(
    "a17_page_rollup",
    f"""SELECT document_id, arg_max(page, score * 1000 - page) AS worst_page, round(max(score), 6) AS score, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (score >= 0.5), '') AS suspicious,
    bool_or(score >= 0.6) AS flagged FROM ({_PAGES}) GROUP BY document_id""",
)
def page_rollup(t):
    """The worst page of a document, its suspicious ones and whether any is bad enough to flag."""
    pages = t("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity").cast("double") / 50).alias("score"))
    bad = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("score") >= 0.5, F.col("page")))), lambda p: p.cast("string")), ",")
    return pages.groupBy("document_id").agg(F.max_by("page", F.col("score") * 1000 - F.col("page")).alias("worst_page"), F.round(F.max("score"), 6).alias("score"), bad.alias("suspicious"), F.bool_or(F.col("score") >= 0.6).alias("flagged"))


@query(
    "a19_confusion",
    """WITH p AS (SELECT l.quality = 0 AS bad, d.n_chars % 101 > 35 AS said FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT count_if(bad AND said) AS tp, count_if(NOT bad AND said) AS fp, count_if(NOT bad AND NOT said) AS tn, count_if(bad AND NOT said) AS fn FROM p)
    SELECT *, round((tp + tn) / greatest(tp + fp + tn + fn, 1), 6) AS accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c""",
)
def confusion(t):
    """Figures of a detector that calls scores above 35 tampered; empty denominators give 0."""
    rows = t("labels").join(t("documents"), "doc_id").select((F.col("quality") == 0).alias("bad"), (F.col("n_chars") % 101 > 35).alias("said"))
    b, s = F.col("bad"), F.col("said")
    c = rows.agg(F.count_if(b & s).alias("tp"), F.count_if(~b & s).alias("fp"), F.count_if(~b & ~s).alias("tn"), F.count_if(b & ~s).alias("fn"))
    per = lambda a, n: F.round(F.expr(a) / F.greatest(F.expr(n), F.lit(1)), 6)
    return c.select("*", per("tp + tn", "tp + fp + tn + fn").alias("accuracy"), per("tp", "tp + fp").alias("precision"), per("tp", "tp + fn").alias("recall"), per("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("a20_distribution", "SELECT quality, count(*) AS n, min(n_chars % 101) AS low, round(avg(n_chars % 101), 6) AS mean, median(n_chars % 101) AS median, max(n_chars % 101) AS high, round(stddev_pop(n_chars % 101), 6) AS deviation FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def distribution(t):
    s = F.col("n_chars") % 101
    return t("labels").join(t("documents"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.min(s).alias("low"), F.round(F.avg(s), 6).alias("mean"), F.median(s).alias("median"), F.max(s).alias("high"), F.round(F.stddev_pop(s), 6).alias("deviation"))


@query("a22_severity_points", "SELECT o_custkey, CAST(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 25 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 8 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 0 END) AS BIGINT) AS points, bool_or(o_orderpriority = '1-URGENT') AS any_critical FROM orders GROUP BY o_custkey")
def severity_points(t):
    p = F.col("o_orderpriority")
    points = F.when(p == "1-URGENT", 25).when(p == "2-HIGH", 15).when(p == "3-MEDIUM", 8).when(p == "4-NOT SPECIFIED", 2).otherwise(0)
    return t("orders").groupBy("o_custkey").agg(F.sum(points).alias("points"), F.bool_or(p == "1-URGENT").alias("any_critical"))


@query("w3_region_ids", "SELECT l_orderkey, l_linenumber, 'R' || lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS VARCHAR), 3, '0') AS region_id FROM lineitem")
def region_ids(t):
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("R"), F.lpad(F.row_number().over(order).cast("string"), 3, "0")).alias("region_id"))


@query("w4_smoothing", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def smoothing(t):
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return t("events").select("event_id", F.round(F.avg("value").over(last), 6).alias("smooth"))


@query("w5_variance", "WITH e AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT event_id, round(CAST(sum(v * v) OVER w AS DOUBLE) / count(*) OVER w - (CAST(sum(v) OVER w AS DOUBLE) / count(*) OVER w) * (CAST(sum(v) OVER w AS DOUBLE) / count(*) OVER w), 6) AS variance FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def variance(t):
    """Population variance of the last 30 readings (whole numbers, so that sums are exact)."""
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    rows = t("events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("v"))
    n, squares, mean = F.count("*").over(last), F.sum(F.col("v") * F.col("v")).over(last).cast("double"), F.sum("v").over(last).cast("double") / F.count("*").over(last)
    return rows.select("event_id", F.round(squares / n - mean * mean, 6).alias("variance"))


@query("j21_neighbours", "SELECT event_id, coalesce(nullif(lag(event_type, 1) OVER w, 'view'), nullif(lag(event_type, 2) OVER w, 'view'), nullif(lag(event_type, 3) OVER w, 'view')) AS before, coalesce(nullif(lead(event_type, 1) OVER w, 'view'), nullif(lead(event_type, 2) OVER w, 'view')) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbours(t):
    """The nearest usable value among the last three and the next two."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    usable = lambda f, n: F.nullif(f("event_type", n).over(w), F.lit("view"))
    return t("events").select("event_id", F.coalesce(*[usable(F.lag, n) for n in (1, 2, 3)]).alias("before"), F.coalesce(*[usable(F.lead, n) for n in (1, 2)]).alias("after"))


@query("t9_weighted_top3", "SELECT l_orderkey, round(CASE WHEN n = 1 THEN s[1] ELSE 0.75 * s[1] + 0.25 * list_avg(s[1:3]) END, 6) AS score FROM (SELECT l_orderkey, count(*) AS n, list(CAST(l_discount AS DOUBLE) ORDER BY l_discount DESC) AS s FROM lineitem GROUP BY 1)")
def weighted_top3(t):
    s = F.slice(F.sort_array(F.collect_list(F.col("l_discount").cast("double")), asc=False), 1, 3)
    rows = t("lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return rows.select("l_orderkey", F.round(F.when(F.size("s") == 1, F.col("s")[0]).otherwise(0.75 * F.col("s")[0] + 0.25 * mean), 6).alias("score"))


@query("k3_rate_limit", "SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2")
def rate_limit(t):
    """Requests per client and quarter of an hour, and whether they exceed the limit."""
    w = F.window(F.col("ts").cast("timestamp"), "15 minutes")
    rows = t("events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", (F.col("n") > 1).alias("limited"))


@query("k4_token_reuse", "SELECT DISTINCT user_id FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE event_type = 'purchase' AND previous = 'purchase'")
def token_reuse(t):
    """Families whose token is used again right after it was revoked."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t("events").select("user_id", "event_type", F.lag("event_type").over(order).alias("previous"))
    return rows.where("event_type = 'purchase' AND previous = 'purchase'").select("user_id").distinct()
