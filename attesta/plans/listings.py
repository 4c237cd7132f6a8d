"""Listings, lookups, searches and joins of the relational layer, over the star-schema stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import relational as R
from attesta.operators.neighbours import containing, ratio_pairs
from attesta.plans import query

#: Order priorities as severities.
_SEVERITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN 'LOW' ELSE 'INFO' END"
#: A watchlist built from suppliers: tenant is the nation, every seventh entry global, every eleventh inactive.
_WATCH_SQL = "SELECT s_suppkey AS id, concat(' p', lpad(cast(s_suppkey AS {text}), 7, '0'), ' ') AS document_number, s_name AS full_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS tenant, s_suppkey % 11 <> 0 AS is_active FROM supplier"


def _severe(t):
    return t("orders").withColumn("severity", F.expr(_SEVERITY_SQL))


def _watchlist(t):
    rows = t("supplier")
    return rows.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit(" p"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"), F.lit(" ")).alias("document_number"),
        F.col("s_name").alias("full_name"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("tenant"),
        (F.col("s_suppkey") % 11 != 0).alias("is_active"),
    )


@query(
    "s5_health",
    "SELECT 1 AS ok",
)
def health(t):
    return t("region").limit(1).select(F.lit(1).alias("ok"))


@query("s6_point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return t("customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_nationkey")


@query("s7_secondary_lookup", "SELECT c_custkey, lower(trim(c_name)) AS email FROM customer WHERE lower(trim(c_name)) = 'customer#000000007'")
def secondary_lookup(t):
    email = F.lower(F.trim("c_name"))
    return t("customer").where(email == "customer#000000007").select("c_custkey", email.alias("email"))


DOCUMENT_OVERVIEW = """
    WITH versions AS (SELECT l_orderkey, max(l_linenumber) AS current_version FROM lineitem GROUP BY l_orderkey),
    newest AS (SELECT c_custkey AS owner, max(o_orderdate) AS at FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
    SELECT o.o_orderkey AS document_id, c.c_name AS uploader, n.n_name AS organization, o.o_orderstatus AS status,
        CAST(coalesce(v.current_version, 0) AS BIGINT) AS current_version, CAST(coalesce(l.l_quantity, 0) AS DOUBLE) AS file_size,
        o.o_orderdate = newest.at AS is_latest
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN versions v ON v.l_orderkey = o.o_orderkey
    LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = v.current_version
    LEFT JOIN newest ON newest.owner = c.c_custkey
    WHERE o.o_orderstatus <> 'F' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 200"""


@query("document_overview", DOCUMENT_OVERVIEW)
def document_overview(t):
    """Documents with uploader, organisation and current version, deleted ones left out: the first page, newest first."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    current = R.latest_one(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity"])
    live = orders.where("o_orderstatus <> 'F'")
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = live.join(people, F.col("o_custkey") == F.col("c_custkey")).join(current, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(newest, "o_custkey", "left")
    listed = rows.select(
        F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("uploader"), F.col("n_name").alias("organization"), F.col("o_orderstatus").alias("status"), "o_orderdate",
        F.coalesce("l_linenumber", F.lit(0)).cast("long").alias("current_version"), F.coalesce("l_quantity", F.lit(0)).cast("double").alias("file_size"), (F.col("o_orderdate") == F.col("at")).alias("is_latest"),
    )
    return R.page(listed, [F.col("o_orderdate").desc(), F.col("document_id")], 1, 200).drop("o_orderdate")


@query("j3_latest_ties", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def latest_ties(t):
    return R.latest_ties(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("w2_latest_one", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_one(t):
    return R.latest_one(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


_BY_TIME = "(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {0})"
_SIGNALS = (("tampering", 0, "l_discount"), ("face", 1, "l_tax"), ("ai", 2, "l_quantity"), ("ocr", 3, "l_extendedprice"))


@query(
    "j17_four_signals",
    "WITH base AS (SELECT DISTINCT l_orderkey FROM lineitem), "
    + ", ".join(f"{n} AS (SELECT l_orderkey, arg_max({c}, {_BY_TIME.format(c)}) AS {n} FROM lineitem WHERE l_linenumber % 4 = {k} GROUP BY 1)" for n, k, c in _SIGNALS)
    + " SELECT base.l_orderkey AS document_id, " + ", ".join(f"CAST({n}.{n} AS DOUBLE) AS {n}" for n, _, _ in _SIGNALS)
    + " FROM base " + " ".join(f"LEFT JOIN {n} USING (l_orderkey)" for n, _, _ in _SIGNALS),
)
def four_signals(t):
    """The latest of four child signals per document by time, in one pass over the children rather than four joins."""
    latest = lambda k, c: F.max(F.when(F.col("l_linenumber") % 4 == k, F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col(c).alias("value"))))["value"]
    return t("lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(*[latest(k, c).cast("double").alias(n) for n, k, c in _SIGNALS])


@query("p5_dynamic_filters", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000")
def dynamic_filters(t):
    status, least, person = "O", 100000, None
    given = [F.col("o_orderstatus") == status if status else None, F.col("o_totalprice") >= least if least else None, F.col("o_custkey") == person if person else None]
    return R.where_all(t("orders"), given).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("p6_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def search(t):
    """One term over two columns, ORed."""
    return t("part").where(R.contains_any("AN", "p_name", "p_type")).select("p_partkey", "p_name", "p_type")


@query("p7_time_range", "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00'")
def time_range(t):
    return t("events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-06 12:00:00'").select("event_id", "user_id", "ts")


@query("p8_tenant_or_global", f"SELECT id, full_name, tenant FROM ({_WATCH_SQL.format(text='VARCHAR')}) WHERE tenant IS NULL OR tenant = 3")
def tenant_or_global(t):
    return _watchlist(t).where(R.tenant_or_global("tenant", 3)).select("id", "full_name", "tenant")


@query("p8_global_only", f"SELECT id, full_name, tenant FROM ({_WATCH_SQL.format(text='VARCHAR')}) WHERE tenant IS NULL")
def global_only(t):
    return _watchlist(t).where(R.tenant_or_global("tenant", None)).select("id", "full_name", "tenant")


@query("p9_pending_tokens", "SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-25 00:00:00' AND event_id % 3 <> 0")
def pending_tokens(t):
    """Neither accepted (every third) nor revoked (purchases), and not expired seven days after issue, as of a given time."""
    accepted, revoked = F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_type") == "purchase", F.col("ts"))
    return t("events").where(accepted.isNull() & revoked.isNull() & F.expr("ts + INTERVAL 7 DAYS > TIMESTAMP_NTZ '2024-01-25 00:00:00'")).select("event_id", "user_id")


@query("p14_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(t):
    """Tolerant decoding: what isn't JSON gives null."""
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("p16_rule_code", "SELECT DISTINCT regexp_extract(title, '\\[([A-Z_]+)\\]', 1) AS rule FROM (SELECT 'Validation: [' || upper(event_type) || '_RULE] found' AS title FROM events)")
def rule_code(t):
    title = F.concat(F.lit("Validation: ["), F.upper("event_type"), F.lit("_RULE] found"))
    return t("events").select(F.regexp_extract(title, r"\[([A-Z_]+)\]", 1).alias("rule")).distinct()


@query(
    "p18_strip_secrets",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'event,user' ELSE 'event' END AS kept FROM events",
)
def strip_secrets(t):
    """Secret keys go from audit metadata."""
    metadata = F.create_map(F.lit("password"), F.lit("x"), F.lit("event"), F.col("event_type"), F.lit("token"), F.lit("y"))
    metadata = F.when(F.col("event_id") % 2 == 0, F.map_concat(metadata, F.create_map(F.lit("user"), F.col("user_id").cast("string")))).otherwise(metadata)
    safe = F.map_filter(metadata, lambda k, _: ~k.isin("password", "token", "secret", "refreshToken", "passwordHash"))
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(safe)), ",").alias("kept"))


@query("p19_mask", "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked FROM customer")
def mask(t):
    return t("customer").select("c_custkey", F.concat(F.repeat(F.lit("*"), F.length("c_name") - 4), F.right("c_name", F.lit(4))).alias("masked"))


@query("p20_quality_reject", "SELECT p_partkey, CASE WHEN length(p_name) < 12 THEN 'NAME_LENGTH' WHEN p_size > 40 THEN 'SIZE_RANGE' WHEN NOT regexp_matches(p_type, '^[A-Z ]+$') THEN 'TYPE_PATTERN' END AS reject FROM part")
def quality_reject(t):
    """The first input rule a row breaks, or null."""
    rule = F.when(F.length("p_name") < 12, "NAME_LENGTH").when(F.col("p_size") > 40, "SIZE_RANGE").when(~F.col("p_type").rlike("^[A-Z ]+$"), "TYPE_PATTERN")
    return t("part").select("p_partkey", rule.alias("reject"))


@query("j1_dimensions", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimensions(t):
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j4_actor_left_join", "SELECT event_id, c_name AS actor FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 <> 0")
def actor_left_join(t):
    """Audit rows keep their place when the actor is gone."""
    return t("events").join(t("customer").where("c_custkey % 3 <> 0"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_name").alias("actor"))


@query("j5_star_top10", "SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def star_top10(t):
    """The ten rows are found first and joined afterwards."""
    top = t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)
    joined = top.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("j7_rbac_permissions", "SELECT DISTINCT c_custkey, p_type AS permission FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def rbac_permissions(t):
    """Member to roles to permissions, distinct, for every member."""
    return _permissions(t, t("customer"))


def _permissions(t, members):
    roles = members.join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")
    grants = roles.join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return grants.join(t("part").select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey")).select("c_custkey", F.col("p_type").alias("permission")).distinct()


#: Subjects: every third is named by a fragment inside a listed word, the others by all of one or more than is listed.
_SUBJECTS = "SELECT c_custkey AS subject, concat('P', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS number, CASE c_custkey % 3 WHEN 0 THEN concat('PLIER#', lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0')) WHEN 1 THEN lpad(CAST(c_custkey % 300 AS VARCHAR), 5, '0') ELSE concat('supplier#', lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0')) END AS name, c_nationkey AS tenant FROM customer"


def _subjects(t):
    key = F.col("c_custkey")
    padded = lambda n: F.lpad((key % 300).cast("string"), n, "0")
    name = F.when(key % 3 == 0, F.concat(F.lit("PLIER#"), padded(9))).when(key % 3 == 1, padded(5)).otherwise(F.concat(F.lit("supplier#"), padded(9)))
    return t("customer").select(key.alias("subject"), F.concat(F.lit("P"), F.lpad(key.cast("string"), 7, "0")).alias("number"), name.alias("name"), F.col("c_nationkey").alias("tenant"))


@query(
    "j10_j11_watchlist",
    f"""WITH w AS ({_WATCH_SQL.format(text='VARCHAR')}), s AS ({_SUBJECTS}),
    exact AS (SELECT subject, w.id, 'NUMBER' AS matched_by FROM s JOIN w ON upper(trim(w.document_number)) = upper(trim(s.number)) AND w.is_active AND (w.tenant IS NULL OR w.tenant = s.tenant)),
    named AS (SELECT subject, w.id, 'NAME' AS matched_by FROM s JOIN w ON contains(lower(w.full_name), lower(s.name)) AND w.is_active AND (w.tenant IS NULL OR w.tenant = s.tenant) WHERE subject NOT IN (SELECT subject FROM exact))
    SELECT * FROM exact UNION ALL SELECT * FROM named""",
)
def watchlist(t):
    """Listed numbers by equality; only subjects without one are held against listed names.

    A name match (the listed name contains the subject's) is a theta join. Here names meet through a
    common run of three letters: see ``neighbours.containing``.
    """
    w, s = _watchlist(t).where("is_active").withColumnRenamed("tenant", "listed_for"), _subjects(t)
    ours = F.col("listed_for").isNull() | (F.col("listed_for") == F.col("tenant"))
    number = lambda c: F.upper(F.trim(c))
    exact = s.join(w, number(F.col("document_number")) == number(F.col("number"))).where(ours).select("subject", "id", F.lit("NUMBER").alias("matched_by"))
    rest = s.join(exact.select("subject").distinct(), "subject", "left_anti")
    named = containing(rest.select("subject", "name", "tenant"), "name", w.select("id", "full_name", "listed_for"), "full_name")
    return exact.unionByName(named.where(ours).select("subject", "id", F.lit("NAME").alias("matched_by")))


@query("j16_children", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS children FROM lineitem GROUP BY l_orderkey")
def children(t):
    """Every parent with its ordered child list."""
    return _children(t("lineitem"))


def _children(rows):
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("children"))


@query("j18_knn_ratio", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d QUALIFY r <= 2)
    SELECT x.a, x.b, round(x.d, 6) AS distance FROM k x JOIN k y ON x.a = y.a AND x.r = 1 AND y.r = 2 WHERE x.a < x.b AND x.d < 0.74 * y.d""")
def descriptor_pairs(t):
    """Every descriptor against all others: pairs whose distance passes the ratio to the second nearest, each once."""
    return ratio_pairs(t("embeddings")).select("a", "b", F.round("distance", 6).alias("distance"))


@query("t2_severity_order", f"SELECT o_orderkey, severity FROM (SELECT *, {_SEVERITY_SQL} AS severity FROM orders) ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 WHEN 'INFO' THEN 5 ELSE 6 END, o_orderdate, o_orderkey LIMIT 50")
def severity_order(t):
    """The first page over all orders."""
    return _severest(_severe(t))


def _severest(rows):
    return rows.orderBy(R.severity_rank("severity"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "severity")


@query("t3_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(t):
    return R.page(t("orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3, 25)


@query("a3_page_counts", "SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 25) AS BIGINT), 1) AS total_pages FROM orders WHERE o_orderstatus <> 'F'")
def page_counts(t):
    return R.page_counts(t("orders").where("o_orderstatus <> 'F'"), 25)


@query("t6_default_role", "SELECT min(n_nationkey) AS role_id FROM nation WHERE n_regionkey = 2")
def default_role(t):
    return t("nation").where("n_regionkey = 2").agg(F.min("n_nationkey").alias("role_id"))


@query("u1_factor_union", "SELECT 'ORDER' AS source, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'LINE', count(*) FROM lineitem UNION ALL SELECT 'EVENT', count(*) FROM events UNION ALL SELECT 'PART', count(*) FROM part")
def factor_union(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "n") for s, n in (("ORDER", "orders"), ("LINE", "lineitem"), ("EVENT", "events"), ("PART", "part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("u4_not_applied", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 20)")
def not_applied(t):
    return t("nation").join(t("customer").where("c_custkey < 20"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("n_nationkey")


@query("u6_unordered_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def unordered_pairs(t):
    return t("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("d1_partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'RENAMED' ELSE c_name END AS c_name, c_nationkey FROM customer")
def partial_update(t):
    base = t("customer").select("c_custkey", "c_name", "c_nationkey")
    patch = base.where("c_custkey % 5 = 0").select("c_custkey", F.lit("RENAMED").alias("c_name"), F.lit(None).cast("long").alias("c_nationkey"))
    return R.patched(base, patch, ["c_custkey"])


@query("d2_soft_delete", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'logout' AND event_type <> 'purchase'")
def soft_delete(t):
    """Current state of an append-only log where logouts and purchases stand for deletions."""
    log = t("events").select("user_id", "event_id", "ts", F.col("event_type").isin("logout", "purchase").alias("deleted"))
    return R.replaced_by_latest(log, ["user_id"], ["ts", "event_id"], "deleted").select("user_id", "event_id")


@query("d3_hard_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def hard_delete(t):
    return t("orders").join(t("customer").where("c_nationkey = 4"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("d4_revoke_family", "SELECT event_id, user_id, CASE WHEN user_id % 10 = 3 AND event_type <> 'login' THEN TIMESTAMP '2024-02-01 00:00:00' WHEN event_type = 'login' THEN ts END AS revoked_at FROM events")
def revoke_family(t):
    """Tokens of a family that aren't revoked yet get the time; logins are revoked already."""
    revoked = F.when(F.col("event_type") == "login", F.col("ts"))
    now = F.when((F.col("user_id") % 10 == 3) & revoked.isNull(), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return t("events").select("event_id", "user_id", F.coalesce(revoked, now).alias("revoked_at"))


@query("d6_job_states", """SELECT o_orderkey AS job, CAST(count(l_linenumber) AS BIGINT) AS attempts, CASE WHEN max(l_linenumber) >= 5 THEN 'COMPLETED' WHEN max(l_linenumber) >= 3 THEN 'FAILED' WHEN count(l_linenumber) > 0 THEN 'PROCESSING' ELSE 'PENDING' END AS status
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10 GROUP BY o_orderkey""")
def job_states(t):
    """Job status as a fold of its events, not an update in place."""
    runs = t("lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    jobs = t("orders").select("o_orderkey").join(runs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return jobs.select(F.col("o_orderkey").alias("job"), n.alias("attempts"), F.when(F.col("last") >= 5, "COMPLETED").when(F.col("last") >= 3, "FAILED").when(n > 0, "PROCESSING").otherwise("PENDING").alias("status"))
