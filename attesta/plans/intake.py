"""Regions, findings, routing and small lookups over the star-schema stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import findings as N
from attesta.operators import regions as G
from attesta.plans import query

#: Lines of an order as regions of a document.
_REGIONS = ["l_orderkey AS doc", "l_linenumber AS id", "l_partkey % 60 AS x", "l_suppkey % 60 AS y", "CAST(10 + l_quantity AS INT) AS w", "CAST(12 + l_linenumber * 4 AS INT) AS h", "CASE WHEN l_discount >= 0.08 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM' WHEN l_discount >= 0.01 THEN 'LOW' ELSE 'NOTE' END AS severity", "CAST(l_tax AS DOUBLE) AS score"]
_R = f"r AS (SELECT {', '.join(_REGIONS)} FROM lineitem)"
_RANK = "CASE {}severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_SHARED = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


def _regions(t):
    return t("lineitem").selectExpr(*_REGIONS)


def _listed(rows, *columns):
    """A document's regions as one array, by id."""
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("regions"))


@query("s1_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000")
def parameters(t):
    """A SQL text with named parameters over a table that is handed in."""
    orders = t("orders")
    return orders.sparkSession.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least", args={"status": "O", "least": 200000}, orders=orders)


@query("p10_valid_tokens", "SELECT event_id FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 12 HOUR >= TIMESTAMP '2024-01-15 00:00:00'")
def valid_tokens(t):
    """Tokens neither used nor expired; a purchase is a use."""
    used = F.when(F.col("event_type") == "purchase", F.col("ts"))
    expires = F.col("ts") + F.expr("INTERVAL 12 HOURS")
    return t("events").where(used.isNull() & (expires >= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).select("event_id")


@query("j8_organisations", "SELECT l_orderkey AS member, s_suppkey AS organisation, s_name, p_brand AS role FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND s_suppkey % 5 <> 0")
def organisations(t):
    """Members with their organisations and roles, where neither side is suspended."""
    active = t("lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey", "l_partkey")
    joined = active.join(t("supplier").where("s_suppkey % 5 <> 0"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(F.col("l_orderkey").alias("member"), F.col("s_suppkey").alias("organisation"), "s_name", F.col("p_brand").alias("role"))


@query("t5_ordered_lists", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) AS versions, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey, l_linenumber) AS members FROM lineitem GROUP BY 1")
def ordered_lists(t):
    """Versions of each document newest first, members in ascending order."""
    down = F.sort_array(F.collect_list("l_linenumber"), asc=False)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return t("lineitem").groupBy("l_orderkey").agg(text(down).alias("versions"), text(F.sort_array(F.collect_list("l_suppkey"))).alias("members"))


@query("t4_feeds", """(SELECT 'orders' AS feed, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
    UNION ALL (SELECT 'events', event_id FROM events ORDER BY ts DESC, event_id LIMIT 12) UNION ALL (SELECT 'members', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6)""")
def feeds(t):
    """The dashboard's three feeds, each a top-k of its own."""
    top = lambda table, name, key, by, n: t(table).orderBy(F.col(by).desc(), key).limit(n).select(F.lit(name).alias("feed"), F.col(key).cast("long").alias("id"))
    return top("orders", "orders", "o_orderkey", "o_orderdate", 10).union(top("events", "events", "event_id", "ts", 12)).union(top("customer", "members", "c_custkey", "c_acctbal", 6))


@query("j15_overlap_severity", f"""WITH {_R}, m AS (SELECT s.doc, s.id, max({_RANK.format('a.')}) AS r FROM r s JOIN r a ON s.doc = a.doc AND s.id % 2 = 0 AND a.id % 2 = 1 AND {_SHARED.format(a='s', b='a')} > 0.2 * a.w * a.h GROUP BY 1, 2)
    SELECT s.doc, s.id, CASE m.r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 0 THEN 'NOTE' END AS severity FROM r s LEFT JOIN m ON s.doc = m.doc AND s.id = m.id WHERE s.id % 2 = 0""")
def overlap_severity(t):
    """Even regions are stamps, odd ones anomalies: the highest severity each stamp covers."""
    r = _regions(t)
    return G.overlap_severity(r.where("id % 2 = 0").select("doc", "id", "x", "y", "w", "h"), r.where("id % 2 = 1"), ["doc"]).select("doc", "id", "severity")


@query("t7_region_order", f"WITH {_R} SELECT doc, id, printf('R%03d', row_number() OVER (PARTITION BY doc ORDER BY {_RANK.format('')} DESC, w % 3 DESC, score DESC, id)) AS region_id FROM r")
def region_order(t):
    rows = _listed(_regions(t), "id", "severity", F.expr("w % 3").alias("detectors"), F.col("score").alias("signal"))
    return rows.select("doc", F.explode(G.numbered(F.col("regions"))).alias("r")).select("doc", "r.id", "r.region_id")


@query("g22_without_nested", f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY w * h DESC, id, x, y, w, h) AS step FROM r),
    f AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(id INT, x INT, y INT, w INT, h INT)[]) AS kept FROM r
        UNION ALL SELECT f.doc, o.step, CASE WHEN len(list_filter(f.kept, lambda k: {_SHARED.format(a='k', b='o')} > 0.8 * o.w * o.h)) = 0 THEN list_append(f.kept, {{'id': CAST(o.id AS INT), 'x': CAST(o.x AS INT), 'y': CAST(o.y AS INT), 'w': o.w, 'h': o.h}}) ELSE f.kept END FROM f JOIN o ON o.doc = f.doc AND o.step = f.step + 1)
    SELECT doc, unnest(max_by(kept, step)).id AS id FROM f GROUP BY doc""")
def nested(t):
    """Stamps without those that a larger one covers."""
    rows = _listed(_regions(t), "id", "x", "y", "w", "h")
    return rows.select("doc", F.explode(G.without_nested(F.col("regions"))["id"]).alias("id")).select("doc", F.col("id").cast("int").alias("id"))


@query("g22_folded_splices", f"""WITH RECURSIVE {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id, x, y, w, h, score) AS step FROM r), f AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(id INT, x INT, y INT, w INT, h INT, score DOUBLE)[]) AS kept, CAST(0 AS BIGINT) AS hit FROM r
        UNION ALL SELECT g.doc, g.step, CASE WHEN g.hit = 0 THEN list_append(g.kept, g.one) ELSE list_transform(g.kept, lambda k, i: CASE WHEN i = g.hit AND g.one.score > k.score THEN struct_update(k, score := g.one.score) ELSE k END) END, g.hit
        FROM (SELECT f.doc, o.step, f.kept, {{'id': CAST(o.id AS INT), 'x': CAST(o.x AS INT), 'y': CAST(o.y AS INT), 'w': o.w, 'h': o.h, 'score': o.score}} AS one,
            coalesce(list_position(list_transform(f.kept, lambda k: {_SHARED.format(a='k', b='o')} > 0.5 * least(k.w * k.h, o.w * o.h)), true), 0) AS hit FROM f JOIN n o ON o.doc = f.doc AND o.step = f.step + 1) AS g)
    SELECT doc, k.id AS id, round(k.score, 6) AS score FROM (SELECT doc, unnest(max_by(kept, step)) AS k FROM f GROUP BY doc)""")
def splices(t):
    """Splices kept in order; a repetition lifts the score of the one it repeats."""
    rows = _listed(_regions(t), "id", "x", "y", "w", "h", "score", "severity")
    return rows.select("doc", F.explode(G.folded_splices(F.col("regions"))).alias("r")).select("doc", F.col("r.id").cast("int").alias("id"), F.round("r.score", 6).alias("score"))


_SEALS = ["l_orderkey AS doc", "l_linenumber AS id", "CAST(40 + l_quantity AS INT) AS w", "CAST(60 + l_linenumber * 4 AS INT) AS h", "CAST(l_tax AS DOUBLE) * 12 AS score", "'LOW' AS severity"]


@query("g23_cloned_seals", f"""WITH s AS (SELECT {', '.join(_SEALS)} FROM lineitem), c AS (SELECT l_orderkey AS doc, l_linenumber AS a, CAST(1 + l_partkey % 7 AS INT) AS b, CAST(l_suppkey % 10 AS DOUBLE) / 10 AS correlation FROM lineitem),
    p AS (SELECT DISTINCT c.doc, least(a, b) AS a, greatest(a, b) AS b FROM c JOIN s u ON u.doc = c.doc AND u.id = a AND u.w >= 65 AND u.h >= 65 JOIN s v ON v.doc = c.doc AND v.id = b AND v.w >= 65 AND v.h >= 65 WHERE a <> b AND correlation >= 0.7),
    e AS (SELECT doc, a AS id, b AS other, a, b FROM p UNION ALL SELECT doc, b, a, a, b FROM p), m AS (SELECT doc, id, arg_max(other, a * 100 + b) AS target_id FROM e GROUP BY 1, 2)
    SELECT s.doc, s.id, round(CASE WHEN target_id IS NULL THEN score ELSE greatest(score, 0.85) END, 6) AS score, CASE WHEN target_id IS NULL THEN severity ELSE 'HIGH' END AS severity, target_id FROM s LEFT JOIN m USING (doc, id)""")
def cloned_seals(t):
    alike = t("lineitem").selectExpr("l_orderkey AS doc", "CAST(l_linenumber AS INT) AS a", "CAST(1 + l_partkey % 7 AS INT) AS b", "CAST(l_suppkey % 10 AS DOUBLE) / 10 AS correlation")
    found = G.cloned_seals(t("lineitem").selectExpr(*_SEALS), alike, ["doc"])
    return found.select("doc", "id", F.round("score", 6).alias("score"), "severity", F.col("target_id").cast("int").alias("target_id"))


_BOXES = ["l_orderkey AS doc", "l_linenumber AS id", "l_partkey % 900 AS x", "l_suppkey % 50 AS y", "CAST(5 + l_quantity AS INT) AS w", "CAST(6 + l_linenumber * 3 AS INT) AS h", "CAST(l_quantity AS DOUBLE) AS sharp", "CAST(l_discount AS DOUBLE) * 100 AS ela"]


@query("j19_text_neighbours", f"""WITH b AS (SELECT {', '.join(_BOXES)} FROM lineitem),
    n AS (SELECT f.doc, f.id, median(g.sharp) AS sharp, median(g.ela) AS ela FROM b f JOIN b g ON f.doc = g.doc AND f.id <> g.id AND abs(g.y - f.y) < greatest(20, f.h) AND abs(g.x - f.x) < 220 AND abs(g.h - f.h) < greatest(8, 0.4 * f.h) GROUP BY 1, 2),
    d AS (SELECT doc, coalesce(median(CASE WHEN w >= 20 AND h >= 10 THEN sharp END), median(sharp)) AS sharp, coalesce(median(CASE WHEN w >= 20 AND h >= 10 THEN ela END), median(ela)) AS ela FROM b GROUP BY 1)
    SELECT b.doc, b.id, round(coalesce(n.sharp, d.sharp), 6) AS near_sharp, round(coalesce(n.ela, d.ela), 6) AS near_ela, n.id IS NOT NULL AS has_neighbours FROM b JOIN d ON b.doc = d.doc LEFT JOIN n ON b.doc = n.doc AND b.id = n.id""")
def text_neighbours(t):
    found = G.text_neighbours(t("lineitem").selectExpr(*_BOXES), ["doc"])
    return found.select("doc", "id", F.round("near_sharp", 6).alias("near_sharp"), F.round("near_ela", 6).alias("near_ela"), "has_neighbours")


_CUES = ["l_orderkey AS doc", "l_linenumber AS id", "l_orderkey % 3 <> 0 AS noisy", "CAST(l_partkey % 80 AS DOUBLE) / 100 AS void", "abs(CAST(l_suppkey % 13 AS DOUBLE) / 2 - 2) AS background_gap", "CAST(l_suppkey % 13 AS DOUBLE) / 2 - 2 AS background_step", "CAST(l_tax AS DOUBLE) * 60 AS background_std", "CAST(2.5 AS DOUBLE) AS paper_std", "l_partkey % 90 AS background_pixels", "CAST(l_discount AS DOUBLE) * 200 AS ela", "CAST(l_tax AS DOUBLE) * 100 AS near_ela", "CAST(l_quantity AS DOUBLE) / 16 AS ela_gap", "CAST(l_quantity AS DOUBLE) AS sharp", "CAST(30 AS DOUBLE) AS near_sharp", "CAST(l_linenumber AS DOUBLE) / 5 AS sharp_gap", "CAST(l_suppkey % 23 AS DOUBLE) * 12 AS border", "20 + l_partkey % 40 AS w", "10 + l_suppkey % 12 AS h"]


@query("g25_cue_score", f"""WITH f AS (SELECT {', '.join(_CUES)}, FROM lineitem),
    c AS (SELECT *, list_filter([CASE WHEN noisy AND (void >= 0.5 OR (void >= 0.4 AND background_gap >= 3)) AND background_std < 3.5 THEN least(1, 0.45 + 0.55 * void) END,
        CASE WHEN (ela_gap >= 1.6 AND ela >= 7 AND abs(ela - near_ela) >= 3.5) OR (ela >= 10 AND ela_gap >= 1.8) THEN least(1, 0.45 + 0.35 * ela_gap) END,
        CASE WHEN sharp_gap >= 0.55 AND (sharp > 40 OR near_sharp > 40) AND (ela >= 5 OR void >= 0.3 OR background_gap >= 3.5) THEN least(1, 0.35 + 0.45 * sharp_gap) END,
        CASE WHEN background_step >= 3 AND noisy AND w >= 35 AND h >= 15 AND background_pixels >= 60 THEN least(1, 0.4 + 0.1 * background_step) END,
        CASE WHEN border > 160 AND w >= 30 AND h >= 16 AND background_pixels >= 35 AND background_gap >= 3 THEN least(1, border / 400) END], lambda x: x IS NOT NULL) AS s FROM f),
    a AS (SELECT *, noisy AND (void >= 0.55 OR (void >= 0.45 AND background_gap >= 3)) AND background_std < 3.2 AS strong, noisy AND ela >= 14 AND ela_gap >= 2.5 AND abs(ela - near_ela) >= 8 AND w >= 30 AND h >= 14 AS anomaly,
        noisy AND background_step >= 4 AND w >= 40 AND h >= 16 AND background_std <= paper_std AS patch, len(s) >= 2 AND (void >= 0.4 OR background_gap >= 3 OR (noisy AND ela_gap >= 1.5 AND ela >= 6)) AS several FROM c)
    SELECT doc, id, round(CASE WHEN len(s) >= 2 THEN least(1, list_avg(s) + 0.12 * (len(s) - 1)) WHEN strong THEN least(1, 0.45 + 0.55 * void) WHEN patch THEN least(1, 0.5 + 0.1 * background_step) ELSE coalesce(list_avg(s), 0.7) END, 6) AS score FROM a WHERE strong OR anomaly OR patch OR several""".replace(", FROM", " FROM"))
def cue_score(t):
    f = t("lineitem").selectExpr(*_CUES)
    names = [c for c in f.columns if c not in ("doc", "id")]
    return f.select("doc", "id", F.round(G.cue_score({c: F.col(c) for c in names}), 6).alias("score")).where("score IS NOT NULL")


_CHECKS = ["l_orderkey AS doc", "l_linenumber AS id", "CASE l_linenumber WHEN 1 THEN 'passport_number' WHEN 2 THEN 'name' WHEN 3 THEN 'date_of_birth' WHEN 4 THEN 'visa_number' END AS field", "CASE l_returnflag WHEN 'A' THEN 'invalid' WHEN 'N' THEN 'missing' ELSE 'valid' END AS status", "CASE WHEN l_suppkey % 2 = 0 THEN 'not as it should be' END AS message"]


@query("g4_folded_checks", f"""WITH c AS (SELECT {', '.join(_CHECKS)}, coalesce(field IN ('id_number', 'passport_number', 'license_number', 'visa_number', 'permit_number', 'name', 'full_name'), false) AS main FROM lineitem),
    f AS (SELECT DISTINCT doc, 0 AS step, 0 AS id, '' AS k, 'AI_REGULATORY_VALIDATION_FAILURE' AS rule, 'CRITICAL' AS severity, 35 AS impact, 'Document failed official regulatory standards and format rules for PASSPORT.' AS description FROM c WHERE doc % 3 = 0 AND doc % 4 <> 0
        UNION ALL SELECT doc, 1, id, status || coalesce('~' || message, ''), 'AI_VALIDATION_' || coalesce(upper(field), 'RULE'), CASE WHEN main THEN 'CRITICAL' ELSE 'MEDIUM' END, CASE WHEN main THEN 25 ELSE 0 END, coalesce(message, 'Validation check failed for ' || coalesce(field, 'undefined') || '.') FROM c WHERE status = 'invalid'
        UNION ALL SELECT doc, 1, id, status || coalesce('~' || message, ''), 'AI_MISSING_' || upper(field), 'CRITICAL', 30, coalesce(message, 'Required field ' || field || ' is missing or unreadable.') FROM c WHERE status = 'missing' AND main
        UNION ALL SELECT DISTINCT doc, 2, 0, '', 'AI_VALIDATION_ERROR', 'HIGH', 20, 'bad seal' FROM c WHERE doc % 5 = 0 AND doc % 4 <> 0)
    SELECT d.doc, coalesce(string_agg(rule, ',' ORDER BY step, id, k), '') AS rules, coalesce(string_agg(description, '|' ORDER BY step, id, k), '') AS descriptions, CAST(least(40, coalesce(sum(impact), 0)) AS INT) AS impact, coalesce(bool_and(severity NOT IN ('CRITICAL', 'HIGH')), true) AS valid FROM (SELECT DISTINCT doc FROM c) AS d LEFT JOIN f ON d.doc = f.doc GROUP BY d.doc""")
def folded_checks(t):
    """Checks from outside as findings; every third document is rejected, every fourth is well formed, every fifth has an error."""
    rows = t("lineitem").selectExpr(*_CHECKS).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "field", "status", "message", F.lit(0.5).alias("confidence")))).alias("checks"))
    errors = F.when(F.col("doc") % 5 == 0, F.array(F.lit("bad seal")))
    found = rows.withColumn("f", N.folded_checks(F.col("checks"), F.col("doc") % 3 != 0, errors, F.col("doc") % 4 == 0, F.lit("PASSPORT")))
    text = lambda name, sep: F.array_join(F.transform("f", lambda f: f[name]), sep)
    return found.select("doc", text("rule", ",").alias("rules"), text("description", "|").alias("descriptions"), N.total_impact(F.col("f")).alias("impact"), N.passes(F.col("f")).alias("valid"))


@query("f47_plain_fields", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 <> 0 THEN 'balance=' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, 'name=' || c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment=' || c_mktsegment END) AS fields FROM customer")
def plain_fields(t):
    """Extracted fields without those that have no value."""
    value = lambda c: F.struct(c.alias("value"), F.lit(0.9).alias("confidence"))
    fields = F.create_map(F.lit("balance"), value(F.when(F.col("c_custkey") % 3 != 0, F.floor("c_acctbal").cast("string"))), F.lit("name"), value(F.col("c_name")), F.lit("segment"), value(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))))
    entries = F.transform(F.map_entries(N.plain_fields(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t("customer").select("c_custkey", F.array_join(F.array_sort(entries), ",").alias("fields"))


_FILES = ["o_orderkey AS id", "CASE o_orderkey % 7 WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'VISA' WHEN 2 THEN 'PERMIT' WHEN 3 THEN 'DRIVING_LICENSE' WHEN 4 THEN 'NATIONAL_ID' WHEN 5 THEN 'OTHER' END AS kind", "CASE o_custkey % 8 WHEN 0 THEN 'Scan_Passport.png' WHEN 1 THEN 'my-VISA.pdf' WHEN 2 THEN 'Transit 4.pdf' WHEN 3 THEN 'ID_CARD.jpg' WHEN 4 THEN 'clearance.png' WHEN 5 THEN 'national-license.gif' WHEN 6 THEN 'scan.png' END AS filename"]


@query("f31_parser", f"""SELECT id, CASE WHEN kind = 'PASSPORT' OR regexp_matches(lower(filename), 'passport') THEN 'PASSPORT' WHEN kind = 'VISA' OR regexp_matches(lower(filename), 'visa') THEN 'VISA'
    WHEN kind = 'PERMIT' OR regexp_matches(lower(filename), 'permit|transit|clearance') THEN 'PERMIT' WHEN kind IN ('NATIONAL_ID', 'DRIVING_LICENSE') OR regexp_matches(lower(filename), 'license|id_card|national') THEN 'ID'
    WHEN id % 11 = 0 THEN 'PASSPORT' WHEN id % 5 = 0 THEN 'VISA' WHEN id % 4 = 0 THEN 'PERMIT' ELSE 'PASSPORT' END AS parser FROM (SELECT {', '.join(_FILES)} FROM orders)""")
def parser(t):
    rows = t("orders").selectExpr(*_FILES)
    return rows.select("id", N.parser(F.col("kind"), F.col("filename"), F.col("id") % 11 == 0, F.col("id") % 5 == 0, F.col("id") % 4 == 0).alias("parser"))


@query("f32_supported", f"""WITH f AS (SELECT {', '.join(_FILES)} FROM orders), d AS (SELECT *, CASE WHEN id % 2 = 0 AND kind IS NOT NULL THEN kind WHEN id % 3 <> 0 AND id % 13 <> 0 THEN 'VISA' ELSE 'UNKNOWN' END AS detected FROM f)
    SELECT id, detected, detected <> 'UNKNOWN' AND lower(detected) = 'visa' AS supported FROM d""")
def supported(t):
    """The type a stage takes a document for, and whether that is the declared one (a visa)."""
    rows = t("orders").selectExpr(*_FILES)
    classified = F.when((F.col("id") % 2 == 0) & F.col("kind").isNotNull(), F.col("kind")).otherwise("UNKNOWN")
    missing = F.when(F.col("id") % 3 == 0, F.array(F.lit("name"), F.lit("visa_number"))).otherwise(F.array(F.lit("name")))
    detected = N.detected_type(classified, F.when(F.col("id") % 13 != 0, F.lit("visa")), missing)
    return rows.select("id", detected.alias("detected"), N.supported(detected, F.lit("VISA")).alias("supported"))


_TEXTS = ["o_orderkey AS id", "CASE o_orderkey % 8 WHEN 0 THEN concat('No. K', lpad(CAST(o_orderkey % 10000000 AS {t}), 7, '0')) WHEN 1 THEN concat('number AB', lpad(CAST(o_orderkey % 1000000 AS {t}), 6, '0'), ' x') WHEN 2 THEN 'Country  Code IND' WHEN 3 THEN 'Date of issue 1 Date of expiry 2' WHEN 4 THEN 'Type : P code' WHEN 5 THEN 'Nationality: Indian Sex M' WHEN 6 THEN concat('plain ', CAST(o_custkey AS {t})) END AS text", "concat('P<IND', CAST(o_custkey AS {t})) AS line1", "concat('Z1234567<8IND8501019M3001019', CASE WHEN o_custkey % 3 = 0 THEN lpad(CAST(o_orderkey AS {t}), 12, '3') ELSE '<<<<<<<<<<<<' END, '<<04') AS line2"]


@query("f21_passport_layout", f"""WITH f AS (SELECT {', '.join(_TEXTS).format(t='VARCHAR')} FROM orders), u AS (SELECT *, upper(coalesce(text, '')) AS t, regexp_extract(upper(coalesce(text, '')), '\\b([A-Z]{{1,2}}[0-9]{{6,7}})\\b', 1) AS n, replace(substring(line2, 29, 14), '<', '') AS tail FROM f)
    SELECT id, CASE WHEN regexp_full_match(n, '[A-Z][0-9]{{7}}') THEN 'OLD_FORMAT' WHEN regexp_full_match(n, '[A-Z]{{2}}[0-9]{{6,7}}') THEN 'NEW_FORMAT'
    WHEN regexp_matches(t, '\\bCOUNTRY\\s*CODE\\b|CODE\\s*DU\\s*PAYS|NATIONALITY\\s*[:/]*\\s*INDIAN\\s*(SEX|DATE)|DATE\\s*OF\\s*ISSUE.*DATE\\s*OF\\s*EXPIRY') THEN 'OLD_FORMAT' WHEN regexp_matches(t, '\\bCODE\\s*:\\s*IND\\b|TYPE\\s*:\\s*P\\s*CODE') THEN 'NEW_FORMAT'
    WHEN regexp_full_match(tail, '[0-9]{{10,14}}') THEN 'NEW_FORMAT' ELSE 'OLD_FORMAT' END AS layout FROM u""")
def passport_layout(t):
    rows = t("orders").selectExpr(*[x.format(t="STRING") for x in _TEXTS])
    return rows.select("id", N.passport_layout(F.col("text"), F.col("line1"), F.col("line2")).alias("layout"))


@query("f10_shown_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '9' || strftime(o_orderdate, '%m') || 'x' ELSE strftime(o_orderdate, '%d/%m/') || CASE WHEN CAST(strftime(o_orderdate, '%y') AS INT) <= 51 THEN '20' ELSE '19' END || strftime(o_orderdate, '%y') END AS shown FROM orders")
def shown_date(t):
    """Zone dates as people read them, as seen in 2026; every ninth is misread."""
    digits = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("9"), F.date_format("o_orderdate", "MM"), F.lit("x"))).otherwise(F.date_format("o_orderdate", "yyMMdd"))
    return t("orders").select("o_orderkey", N.shown_date(digits, 2026).alias("shown"))
