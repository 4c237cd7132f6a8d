"""Further predicates, evidence scoring and record repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from attesta.operators import correlation as C
from attesta.operators import decisions as D
from attesta.plans import query
from attesta.plans.decisions import _SCORES, _evidence, _signals, SIGNALS

#: Detector sources and the category they are filed under.
CATEGORIES = {"ela": "COMPRESSION_ARTIFACT", "noise": "NOISE_INCONSISTENCY", "copy_move": "CLONE_DETECTED", "splicing": "SPLICING", "metadata": "METADATA_ANOMALY"}
_SIG = SIGNALS.format(orders="orders")


@query("p12_threats", f"SELECT document_id, coalesce(ocr * 100 > 30, false) OR tampered OR coalesce(tampering >= 0.35, false) OR coalesce(face = 'NO_MATCH', false) AS threat FROM ({_SIG})")
def threats(t):
    """Risk above 30, a tampering flag or score, or a bad verdict; what is missing counts as harmless."""
    tests = (F.col("ocr") * 100 > 30, F.col("tampered"), F.col("tampering") >= 0.35, F.col("face") == "NO_MATCH")
    return _signals(t).select("document_id", reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests]).alias("threat"))


@query("p13_bands", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN finding_points >= 40 OR tampering >= 0.7 THEN 'critical' WHEN finding_points >= 24 OR tampering >= 0.5 THEN 'high' WHEN finding_points > 0 OR tampering >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM ({_SIG})) GROUP BY band")
def bands(t):
    p, s = F.col("finding_points"), F.col("tampering")
    band = F.when((p >= 40) | (s >= 0.7), "critical").when((p >= 24) | (s >= 0.5), "high").when((p > 0) | (s >= 0.35), "medium").otherwise("low")
    return _signals(t).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("p15_coercion", "SELECT event_id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS score, event_id % 2 = 1 AS flag FROM events")
def coercion(t):
    return t("events").select("event_id", F.col("value").cast("string").cast("double").alias("score"), (F.col("event_id") % 2).cast("int").cast("boolean").alias("flag"))


@query("p17_categories", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'COMPRESSION_ARTIFACT' WHEN 2 THEN 'NOISE_INCONSISTENCY' WHEN 3 THEN 'CLONE_DETECTED' WHEN 4 THEN 'SPLICING' WHEN 5 THEN 'METADATA_ANOMALY' ELSE 'EDGE_DISCONTINUITY' END AS category FROM lineitem")
def categories(t):
    source = F.element_at(F.array(*[F.lit(x) for x in (*CATEGORIES, "stamp", "other")]), F.col("l_linenumber").cast("int"))
    named = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return t("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.element_at(named, source), F.lit("EDGE_DISCONTINUITY")).alias("category"))


@query("j6_invitations", "SELECT o_orderkey, c_name, n_name, s_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_suppkey = o_orderkey % 100 + 1 WHERE o_orderstatus = 'P'")
def invitations(t):
    rows = t("orders").where("o_orderstatus = 'P'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t("supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 100 + 1).select("o_orderkey", "c_name", "n_name", "s_name")


@query("j9_creators", "SELECT n_nationkey, n_name, c_name AS creator FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 3 AND c_nationkey < 20")
def creators(t):
    people = t("customer").where("c_nationkey < 20").select("c_custkey", "c_name")
    return t("nation").join(people, F.col("c_custkey") == F.col("n_nationkey") * 3, "left").select("n_nationkey", "n_name", F.col("c_name").alias("creator"))


@query("a8_admins", "SELECT c_nationkey, count(*) AS admins FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' GROUP BY c_nationkey")
def admins(t):
    some = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t("customer").join(some, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("admins"))


@query("a16_strongest_signal", "SELECT l_orderkey, l_returnflag AS detector, round(CAST(max(l_discount) AS DOUBLE), 6) AS score, count(*) AS regions FROM lineitem GROUP BY 1, 2")
def strongest_signal(t):
    """Per detector over a document's pages the best score, and all its regions."""
    return t("lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("detector")).agg(F.round(F.max("l_discount").cast("double"), 6).alias("score"), F.count("*").alias("regions"))


@query("u3_name_tokens", "SELECT c_custkey, len(list_intersect(string_split(lower(c_name), '#'), ['customer', '000000007'])) > 0 AS shared FROM customer")
def name_tokens(t):
    return t("customer").select("c_custkey", F.arrays_overlap(F.split(F.lower("c_name"), "#"), F.array(F.lit("customer"), F.lit("000000007"))).alias("shared"))


@query("u5_distinct_dates", "SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS dates FROM orders GROUP BY o_custkey")
def distinct_dates(t):
    """The date set of every customer."""
    return _dates(t("orders"))


def _dates(orders):
    return orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))), ",").alias("dates"))


@query("f13_date_order", "SELECT o_orderkey, b < DATE '1996-01-01' AS birth_past, e > DATE '1996-01-01' AS expiry_future, e > b AS in_order FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 - 100 AS INT) AS e FROM orders)")
def date_order(t):
    b = F.to_date("o_orderdate")
    e, now = F.date_add(b, (F.col("o_orderkey") % 900 - 100).cast("int")), F.lit("1996-01-01").cast("date")
    return t("orders").select("o_orderkey", (b < now).alias("birth_past"), (e > now).alias("expiry_future"), (e > b).alias("in_order"))


@query("f18_gender", "SELECT c_custkey, c_custkey % 3 = 2 AS differs FROM customer")
def gender(t):
    first = lambda c: F.left(F.upper(F.trim(c)), F.lit(1))
    seen = F.element_at(F.array(F.lit(" male"), F.lit("M"), F.lit("Female")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t("customer").select("c_custkey", (first(seen) != first(F.lit("M"))).alias("differs"))


@query("f37_token_hash", "SELECT c_custkey, sha256(lower(trim(c_name))) AS token_hash FROM customer")
def token_hash(t):
    return t("customer").select("c_custkey", F.sha2(F.lower(F.trim("c_name")), 256).alias("token_hash"))


@query(
    "f41_face_quality",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 90 < 40 THEN 'TOO_SMALL' WHEN o_orderkey % 71 < 35 THEN 'LOW_CONFIDENCE' WHEN o_orderkey % 256 < 20 THEN 'TOO_DARK' WHEN o_orderkey % 256 > 245 THEN 'OVEREXPOSED' WHEN o_orderkey % 61 < 20 THEN 'BLURRED' END AS reason FROM orders",
)
def face_quality(t):
    """The first quality check a face fails, over measured size, confidence, brightness and sharpness."""
    k = F.col("o_orderkey")
    size, confidence, brightness, sharpness = k % 90, (k % 71) / 70, k % 256, k % 61
    reason = F.when(size < 40, "TOO_SMALL").when(confidence < 0.5, "LOW_CONFIDENCE").when(brightness < 20, "TOO_DARK").when(brightness > 245, "OVEREXPOSED").when(sharpness < 20, "BLURRED")
    return t("orders").select("o_orderkey", reason.alias("reason"))


@query(
    "f43_head_pose",
    "SELECT vec_id, round(degrees(asin(least(greatest((e[1] - (e[2] + e[3]) / 2) / (greatest(0.00001::DOUBLE, abs(e[3] - e[2])) / 2), -1), 1))) * 1.5, 6) AS yaw, round(CASE WHEN abs(e[3] - e[1]) > 0.00001 THEN abs(e[1] - e[2]) / greatest(abs(e[3] - e[1]), 0.00001::DOUBLE) ELSE 1.0 END, 6) AS nose_ratio FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def head_pose(t):
    """Yaw and nose ratio from nose and cheek positions, where no rotation matrix is known."""
    e = t("embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("nose", "left", "right"))])
    width = F.greatest(F.lit(1e-5), F.abs(F.col("right") - F.col("left")))
    offset = (F.col("nose") - (F.col("left") + F.col("right")) / 2) / (width / 2)
    near, far = F.abs(F.col("nose") - F.col("left")), F.abs(F.col("right") - F.col("nose"))
    yaw = F.degrees(F.asin(F.least(F.greatest(offset, F.lit(-1.0)), F.lit(1.0)))) * 1.5
    return e.select("vec_id", F.round(yaw, 6).alias("yaw"), F.round(F.when(far > 1e-5, near / F.greatest(far, F.lit(1e-5))).otherwise(1.0), 6).alias("nose_ratio"))


@query("f44_metadata_score", "SELECT p_partkey, least(1.0, CASE WHEN contains(lower(p_type), 'brushed') OR contains(lower(p_type), 'plated') THEN 0.5 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.4 ELSE 0 END)::DOUBLE AS score FROM part")
def metadata_score(t):
    """An editor's name in the software tag and an impossible time add up."""
    editors = F.contains(F.lower("p_type"), F.lit("brushed")) | F.contains(F.lower("p_type"), F.lit("plated"))
    total = F.when(editors, 5).otherwise(0) + F.when(F.col("p_size") % 5 == 0, 4).otherwise(0)
    return t("part").select("p_partkey", F.least(F.lit(1.0), total / 10).alias("score"))


@query("f46_repair_output", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, 'LOW' AS severity FROM events")
def repair_output(t):
    """Model output read leniently, missing parts filled with defaults."""
    parsed = F.from_json("props", "k long, severity string")
    return t("events").select("event_id", F.coalesce(parsed["k"], F.lit(0)).alias("k"), F.coalesce(parsed["severity"], F.lit("LOW")).alias("severity"))


@query("f48_low_confidence", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS fields FROM lineitem WHERE l_discount * 10 < 0.75 GROUP BY l_orderkey")
def low_confidence(t):
    """Fields of a document read with too little confidence."""
    rows = t("lineitem").where(F.col("l_discount") * 10 < 0.75)
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("fields"))


@query("g9_stage_adapters", f"SELECT document_id, NOT (tampered AND coalesce(tampering >= 0.35, false)) AS tampering_passed, coalesce(face = 'MATCH', false) AND NOT liveness_failed AS face_passed FROM ({_SIG})")
def stage_adapters(t):
    bad = F.col("tampered") & F.coalesce(F.col("tampering") >= 0.35, F.lit(False))
    return _signals(t).select("document_id", (~bad).alias("tampering_passed"), (F.coalesce(F.col("face") == "MATCH", F.lit(False)) & ~F.col("liveness_failed")).alias("face_passed"))


@query("g10_indicators", _SCORES + " SELECT document_id, detector, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT document_id, unnest(['ela', 'noise', 'stamp']) AS detector, unnest([ela, noise, stamp]) AS score FROM s) WHERE score >= 25")
def indicators(t):
    """Detector scores as indicator rows with their severity."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("detector"), F.col(k).alias("score")) for k in ("ela", "noise", "stamp")]))
    rows = _evidence(t).select("document_id", pairs.alias("p")).select("document_id", "p.*").where("score >= 25")
    return rows.select("document_id", "detector", F.when(F.col("score") >= 70, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW").alias("severity"))


@query("g11_face_decision", f"SELECT document_id, CASE WHEN liveness_failed THEN 'NO_MATCH' WHEN tampering IS NULL THEN 'NO_FACE_DETECTED' WHEN tampering >= 0.45 THEN 'MATCH' WHEN tampering >= 0.35 THEN 'INCONCLUSIVE' ELSE 'NO_MATCH' END AS status FROM ({_SIG})")
def face_decision(t):
    """A failed liveness challenge overrules the similarity."""
    s = F.col("tampering")
    return _signals(t).select("document_id", F.when(F.col("liveness_failed"), "NO_MATCH").when(s.isNull(), "NO_FACE_DETECTED").when(s >= 0.45, "MATCH").when(s >= 0.35, "INCONCLUSIVE").otherwise("NO_MATCH").alias("status"))


@query("g14_region_bonus", _SCORES + " SELECT document_id, CAST(least(100, greatest(least(strong * 25, 60) + least(moderate * 12, 30), CAST(floor(greatest(coalesce(ela, 0), coalesce(noise, 0)) * 0.60::DOUBLE) AS INT))) AS INT) AS bonus FROM s")
def region_bonus(t):
    best = F.greatest(F.coalesce("ela", F.lit(0)), F.coalesce("noise", F.lit(0)))
    return _evidence(t).select("document_id", C.region_bonus(F.col("strong"), F.col("moderate"), best).alias("bonus"))


_NAMED = "list_filter([{}], lambda x: x IS NOT NULL)"
_STRONG = _NAMED.format(", ".join(f"CASE WHEN {k} >= 60 THEN '{v}' END" for k, v in C.LABELS.items()))
_MODERATE = _NAMED.format(", ".join(f"CASE WHEN {k} >= 35 AND {k} < 60 THEN '{v}' END" for k, v in C.LABELS.items()))
_AND = "CASE len({0}) WHEN 0 THEN NULL WHEN 1 THEN '{1} ' || {0}[1] || ' detected.' ELSE '{1} ' || array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[len({0})] || ' detected.' END"


def _cases(key, table):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(
    "g18_explanations",
    _SCORES + f""", x AS (SELECT *, {_STRONG} AS a, {_MODERATE} AS b, list_avg(list_filter([ela, noise, copy_move, splicing, content_alteration, text_tampering, stamp], lambda x: x IS NOT NULL)) AS mean,
    CASE WHEN greatest(ela, noise) >= 80 THEN 'CRITICAL' WHEN greatest(ela, noise) >= 60 THEN 'HIGH' WHEN greatest(ela, noise) >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s)
    SELECT document_id, array_to_string(list_filter([{_AND.format('a', 'Strong')}, {_AND.format('b', 'Moderate')}, CASE WHEN copy_move >= 40 THEN '{C.DUPLICATED}' END,
    CASE WHEN strong > 0 THEN strong || CASE WHEN strong > 1 THEN ' regions' ELSE ' region' END || '{C.STRONG_SAID}' END, CASE WHEN moderate > 0 THEN moderate || CASE WHEN moderate > 1 THEN ' regions' ELSE ' region' END || '{C.MODERATE_SAID}' END,
    {_cases("CASE WHEN metadata >= 50 AND mean < 25 THEN 'METADATA' WHEN mean >= 60 AND metadata < 15 THEN 'IMAGE' END", C.CONFLICTS)}, {_cases('level', C.ASSESSMENTS)}], lambda x: x IS NOT NULL), chr(10)) AS sentences FROM x""",
)
def explanations(t):
    """All sentences on a document's evidence, a line each; the level here is that of the higher of two detectors."""
    scores = {k: F.col(k) for k in D.DETECTORS}
    level = D.level(F.greatest("ela", "noise"), D.IMAGE_LEVELS)
    return _evidence(t).select("document_id", F.array_join(C.explanations(scores, F.col("strong"), F.col("moderate"), D.conflict(scores), level), "\n").alias("sentences"))


_LEVELS = {"ela": (40, 20, 10), "noise": (35, 15, 5), "copy_move": (50, 25, 10)}
_SIX = "CASE WHEN {0} >= 60 THEN {1} WHEN {0} >= 35 THEN {2} WHEN {0} IS NOT NULL THEN {3} ELSE 0 END"


@query(
    "g26_stamp_score",
    _SCORES + ", x AS (SELECT document_id, 10 + " + " + ".join(_SIX.format(k, *v) for k, v in _LEVELS.items()) + " + CASE (ela IS NOT NULL)::INT + (noise IS NOT NULL)::INT + (copy_move IS NOT NULL)::INT WHEN 3 THEN 30 WHEN 2 THEN 20 ELSE 0 END AS p FROM s) SELECT document_id, least(p, 100) AS points, CASE WHEN p > 70 THEN 'HIGH' WHEN p > 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM x",
)
def stamp_score(t):
    """A stamp's score in hundredths from the severities of signals over it, more where several agree."""
    part = lambda k: F.when(F.col(k) >= 60, _LEVELS[k][0]).when(F.col(k) >= 35, _LEVELS[k][1]).when(F.col(k).isNotNull(), _LEVELS[k][2]).otherwise(0)
    n = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in _LEVELS])
    p = F.lit(10) + part("ela") + part("noise") + part("copy_move") + F.when(n == 3, 30).when(n == 2, 20).otherwise(0)
    return _evidence(t).select("document_id", F.least(p, F.lit(100)).alias("points"), F.when(p > 70, "HIGH").when(p > 40, "MEDIUM").otherwise("LOW").alias("severity"))


@query(
    "g27_alteration_rules",
    "SELECT l_orderkey, l_linenumber, l_partkey, (w >= 50 AND h >= 40 AND a >= 600 AND thin >= 75 AND spread >= 30 AND dyn >= 70 AND fill <= 65 AND (ela >= 15 OR a >= 1800)) OR (w >= 40 AND h >= 40 AND a >= 550 AND thin >= 60 AND spread >= 45 AND dyn >= 95 AND (ela >= 18 OR a >= 1800)) AS altered FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 90 AS w, l_suppkey % 80 AS h, l_partkey % 2500 AS a, l_partkey % 130 AS thin, l_suppkey % 70 AS spread, l_partkey % 140 AS dyn, l_suppkey % 100 AS fill, l_partkey % 40 AS ela FROM lineitem)",
)
def alteration_rules(t):
    """Stroke defacements and local scribbles among coloured components, over their measured features."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    f = {"w": p % 90, "h": s % 80, "a": p % 2500, "thin": p % 130, "spread": s % 70, "dyn": p % 140, "fill": s % 100, "ela": p % 40}
    large = f["a"] >= 1800
    stroke = (f["w"] >= 50) & (f["h"] >= 40) & (f["a"] >= 600) & (f["thin"] >= 75) & (f["spread"] >= 30) & (f["dyn"] >= 70) & (f["fill"] <= 65) & ((f["ela"] >= 15) | large)
    scribble = (f["w"] >= 40) & (f["h"] >= 40) & (f["a"] >= 550) & (f["thin"] >= 60) & (f["spread"] >= 45) & (f["dyn"] >= 95) & ((f["ela"] >= 18) | large)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (stroke | scribble).alias("altered"))


@query("s13_plain_text", "SELECT page_id, length(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS n FROM pages")
def plain_text(t):
    content = F.encode("html", "UTF-8")
    return t("pages").select("page_id", F.length(F.regexp_replace(F.decode(content, "UTF-8"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")).cast("long").alias("n"))


@query("s14_printable_runs", "SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '[ -~]{4,50}'), lambda x: length(trim(x)) > 5)) AS BIGINT) AS runs FROM pages")
def printable_runs(t):
    """Printable runs of 4 to 50 characters, as a last resort for reading binary content."""
    runs = F.filter(F.regexp_extract_all("html", F.lit("([ -~]{4,50})"), F.lit(1)), lambda x: F.length(F.trim(x)) > 5)
    return t("pages").select("page_id", F.size(runs).cast("long").alias("runs"))


@query("s15_ocr_confidence", "SELECT l_orderkey, round(avg(least(greatest(CAST(l_discount AS DOUBLE) * 30 - 0.5, 0), 1)), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def ocr_confidence(t):
    """Mean of a document's region confidences, each clamped to 0..1."""
    c = F.least(F.greatest(F.col("l_discount").cast("double") * 30 - 0.5, F.lit(0.0)), F.lit(1.0))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.avg(c), 6).alias("confidence"))


@query("s23_page_envelope", "SELECT l_orderkey, l_returnflag AS page, round(max(CAST(l_discount AS DOUBLE)), 6) AS score, bool_or(l_quantity > 45 OR l_discount >= 0.06) AS flagged FROM lineitem GROUP BY 1, 2")
def page_envelope(t):
    return t("lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("page")).agg(F.round(F.max(F.col("l_discount").cast("double")), 6).alias("score"), F.bool_or((F.col("l_quantity") > 45) | (F.col("l_discount") >= 0.06)).alias("flagged"))
