"""Batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.plans import query
from attesta.streaming.liveness import judge

#: Seconds of the clip by which a session has to be over.
UNTIL = 1e9


def frames(events):
    """Frames from events: a user is a session, the hour the second of its clip; every third user holds a picture into the camera."""
    order = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    value = F.col("value")
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_id"), (order / 300_000).alias("at"),
        F.when(F.col("event_id") % 97 == 0, 2).when(F.col("event_id") % 11 == 0, 0).otherwise(1).alias("faces"),
        (F.pmod(value, F.lit(40.0)) - 20).alias("yaw"), (F.pmod(value, F.lit(24.0)) - 12).alias("pitch"), (0.7 + F.pmod(value, F.lit(7.0)) / 10).alias("nose"),
        F.when(F.col("user_id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.pmod(value, F.lit(1.0)))).alias("landmarks"),
    )


_FRAMES = """SELECT user_id AS s, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6::DOUBLE / 300000 AS at, CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS faces,
    value - floor(value / 40) * 40 - 20 AS yaw, value - floor(value / 24) * 24 - 12 AS pitch, 0.7::DOUBLE + (value - floor(value / 7) * 7) / 10 AS nose,
    CASE WHEN user_id % 3 = 0 THEN 0.5::DOUBLE ELSE value - floor(value) END AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL"""


@query(
    "k1_liveness",
    f"""WITH RECURSIVE f AS (SELECT * FROM ({_FRAMES}) WHERE n <= 301),
    r AS (
        SELECT DISTINCT s, 0::BIGINT AS n, 0 AS stage, 0 AS hold, 0 AS faceless, NULL::DOUBLE AS start, NULL::DOUBLE AS last, NULL::VARCHAR AS failed, []::DOUBLE[] AS yaws, []::DOUBLE[] AS tilts, []::DOUBLE[] AS marks FROM f
        UNION ALL
        SELECT s, n, CASE WHEN up THEN stage + 1 ELSE stage END, CASE WHEN up THEN 0 WHEN plain THEN h ELSE hold END, faceless, start, last,
            CASE WHEN up AND stage = 2 AND len(marks) >= 15 AND list_var_pop(list_concat(marks, list_transform(marks, lambda v: 0.5::DOUBLE))) < 1e-7 THEN 'STATIC_SPOOF' ELSE failed END, yaws, tilts, marks
        FROM (SELECT *, plain AND h >= 3 AS up FROM (SELECT *, CASE WHEN met THEN hold + 1 ELSE greatest(0, hold - 1) END AS h FROM (
            SELECT *, CASE stage WHEN 0 THEN abs(list_sum(yaws) / len(yaws)) < 10 AND abs(list_sum(tilts) / len(tilts)) < 18 WHEN 1 THEN list_sum(yaws) / len(yaws) <= -10 OR nose < 0.78 ELSE list_sum(yaws) / len(yaws) >= 10 OR nose > 1.28 END AS met
            FROM (SELECT s, n, stage, hold, start, last, failed, nose, plain, CASE WHEN plain THEN 0 WHEN failed IS NULL OR failed = 'NO_FACE' THEN faceless ELSE was END AS faceless,
                CASE WHEN plain THEN list_slice(list_append(yaws, yaw), -4, -1) ELSE yaws END AS yaws, CASE WHEN plain THEN list_slice(list_append(tilts, pitch), -4, -1) ELSE tilts END AS tilts, CASE WHEN plain THEN list_slice(list_append(marks, mark), -30, -1) ELSE marks END AS marks
                FROM (SELECT *, failed IS NULL AND faces = 1 AS plain FROM (
                    SELECT r.s, f.n, stage, hold, r.faceless AS was, r.faceless + CASE WHEN f.faces = 0 THEN 1 ELSE 0 END AS faceless, coalesce(start, f.at) AS start, f.at AS last, f.faces, f.yaw, f.pitch, f.nose, f.mark, yaws, tilts, marks,
                        CASE WHEN f.at - coalesce(start, f.at) > 10 THEN 'TIMEOUT' WHEN f.n > 300 THEN 'TOO_MANY_FRAMES' WHEN f.faces = 0 AND r.faceless >= 15 THEN 'NO_FACE' WHEN f.faces > 1 THEN 'MULTIPLE_FACES' END AS failed
                    FROM r JOIN f ON f.s = r.s AND f.n = r.n + 1 WHERE r.failed IS NULL AND r.stage < 3)))))
        )
    ),
    l AS (SELECT s, arg_max(stage, n) AS stage, max(n) AS frames, arg_max(start, n) AS start, arg_max(last, n) AS last, arg_max(coalesce(failed, ''), n) AS failed, arg_max(marks, n) AS marks FROM r GROUP BY s),
    w AS (SELECT *, CASE WHEN failed <> '' THEN failed WHEN stage < 3 AND start + 10 < 1e9 THEN 'TIMEOUT' WHEN stage < 3 THEN 'INCOMPLETE' END AS reason FROM l)
    SELECT s AS session_id, CASE WHEN reason = 'STATIC_SPOOF' THEN 'FAILED' ELSE CASE stage WHEN 0 THEN 'CENTER' WHEN 1 THEN 'TURN_LEFT' WHEN 2 THEN 'TURN_RIGHT' ELSE 'PASSED' END END AS stage, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, reason,
        frames, round(last - start, 6) AS elapsed, round(CASE WHEN reason IS NULL THEN 0.92::DOUBLE + least(0.06::DOUBLE, CASE WHEN len(marks) >= 5 THEN list_var_pop(list_concat(marks, list_transform(marks, lambda v: 0.5::DOUBLE))) ELSE 0 END * 50) WHEN reason = 'NO_FACE' THEN 0.10 WHEN reason IN ('MULTIPLE_FACES', 'STATIC_SPOOF') THEN 0.15 ELSE 0.20 END, 2) AS confidence FROM w""",
)
def liveness(t):
    return judge(frames(t("events")), UNTIL).withColumn("elapsed", F.round("elapsed", 6))
