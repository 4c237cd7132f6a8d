"""Streams give their batch twins' results."""

from pyspark.sql import functions as F

from attesta.plans.streams import frames
from attesta.streaming.audit import append_log, request_rates
from attesta.streaming.liveness import Challenge, judge, judge_stream
from tests.oracle import DATA


def test_challenge_paths():
    def run(*poses, faces=1):
        c = Challenge()
        for i, (yaw, nose) in enumerate(poses):
            c.step(i / 10, faces, yaw, 0.0, nose)
        return c.result(1)

    full = [(0, 1.0)] * 3 + [(-30, 1.0)] * 6 + [(30, 1.0)] * 8
    assert run(*full)["status"] == "PASS"
    assert run(*full[:5])["reason"] == "INCOMPLETE"
    assert run(*full, faces=2)["reason"] == "MULTIPLE_FACES"
    assert run(*[(0, 1.0)] * 20, faces=0)["reason"] == "NO_FACE"
    assert run(*[(50, 1.0)] * 150)["reason"] == "TIMEOUT"


def _streamed(spark, tmp_path, parts, name, **options):
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = judge_stream(stream, **options).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect(), left


def test_liveness_stream_equals_batch(spark, tmp_path):
    every = frames(spark.read.parquet(f"{DATA}/events.parquet")).orderBy("at", "frame_id")
    cut = every.approxQuantile("at", [0.5], 0.0)[0]
    rows, _ = _streamed(spark, tmp_path, (every.where(F.col("at") <= cut), every.where(F.col("at") > cut)), "live", late_seconds=1_000_000)
    last = {r.session_id: r for r in sorted(rows, key=lambda r: r.frames)}
    want = {r.session_id: r for r in judge(every).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}


FRAMES = "session_id long, frame_id long, at double, faces int, yaw double, pitch double, nose double, landmarks array<double>"


def _clip(session, begin, poses, still=False):
    return [(session, i, begin + i / 10, 1, float(yaw), 0.0, 1.0, [0.5, 0.5] if still else [0.5, 0.5 + (i % 7) / 100]) for i, yaw in enumerate(poses)]


PASSING = [0] * 3 + [-30] * 8 + [30] * 12


def test_a_silent_session_times_out(spark, tmp_path):
    """Session 1 stops in the middle, 2 passes, 3 goes on so that event time moves on; the timer ends 1, and in the end no state of 1 or 2 is left."""
    first = _clip(1, 1000.0, PASSING[:5]) + _clip(2, 1000.0, PASSING)
    later = [[(k, 0, 1000.0 + 30.0 * (k - 2), 1, 0.0, 0.0, 1.0, None)] for k in range(3, 9)]
    parts = [spark.createDataFrame(rows, FRAMES) for rows in (first, *later)]
    rows, left = _streamed(spark, tmp_path, parts, "silent", keep_seconds=60.0)
    told = {k: [(r.status, r.reason, r.frames) for r in rows if r.session_id == k] for k in (1, 2, 3)}
    assert told == {1: [("FAIL", "INCOMPLETE", 5), ("FAIL", "TIMEOUT", 5)], 2: [("PASS", None, 16)], 3: [("FAIL", "INCOMPLETE", 1), ("FAIL", "TIMEOUT", 1)]}
    twin = {r.session_id: r.reason for r in judge(parts[0], until=1100.0).collect()}
    assert twin == {1: "TIMEOUT", 2: None}
    assert left < 8 - 2  # 1 and 2 are gone


def test_a_picture_is_vetoed(spark):
    """Motion decides at the frame that would pass."""
    rows = _clip(1, 0.0, PASSING) + _clip(2, 0.0, PASSING, still=True)
    got = {r.session_id: (r.status, r.reason, r.stage, r.confidence) for r in judge(spark.createDataFrame(rows, FRAMES)).collect()}
    assert got[1][0] == "PASS" and 0.92 < got[1][3] <= 0.98
    assert got[2] == ("FAIL", "STATIC_SPOOF", "FAILED", 0.15)
    c = Challenge()
    for r in rows:
        if r[0] == 2:
            c.step(*r[2:])
    assert c.result(2)["reason"] == "STATIC_SPOOF" and len(c.counts) <= 30


def test_frames_of_a_session_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [r for s in range(40) for r in _clip(s, s, PASSING[: s + 1] if s % 3 else [50] * 150)]
        got = {r.session_id: r.asDict() for r in judge(spark.createDataFrame(rows, FRAMES).repartition(6)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in range(40):
        c = Challenge()
        for r in rows:
            if r[0] == s:
                c.step(*r[2:])
        want[s] = c.result(s)
    assert got == want and judge(spark.createDataFrame([], FRAMES)).count() == 0


def test_hot_session_hands_on_first_frames_only(spark, monkeypatch):
    from attesta.streaming import liveness

    rows = [(s, i, i / 1000, 1, 0.0, 0.0, 1.0) for s, n in ((1, 3000), (2, 301), (3, 300)) for i in range(n)]
    every = spark.createDataFrame(rows, "session_id long, frame_id long, at double, faces int, yaw double, pitch double, nose double").repartition(5)
    want = {}
    for s in (1, 2, 3):
        c = Challenge()
        for r in rows:
            if r[0] == s:
                c.step(*r[2:])
        want[s] = c.result(s)
    assert {r.session_id: r.asDict() for r in judge(every).collect()} == want

    def counted(until):
        import pyarrow as pa

        return lambda batches: (pa.RecordBatch.from_pydict({"session_id": [0], "stage": [""], "status": [""], "reason": [""], "frames": [b.num_rows], "elapsed": [0.0], "confidence": [0.0]}) for b in batches)

    monkeypatch.setattr(liveness, "_folded", counted)
    assert sum(r.frames for r in judge(every).collect()) == 301 + 301 + 300


def test_audit_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        append_log(source(), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == events.count()
    q = request_rates(source(), 1).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM rates").first().n == events.count()


def test_means_on_a_limit_go_as_in_sql():
    """Added up one by one these four give 9.999999999999998 degrees, which is no turn; with what rounding loses they would give 10."""
    c = Challenge(stage=2, hold=2, yaws=[3.72, 19.85, 17.2])
    c.step(0.0, 1, -0.77, 0.0, 1.0)
    assert (c.stage, c.hold) == (2, 1)
