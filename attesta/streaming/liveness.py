"""Head-turn liveness challenge: CENTER, then LEFT, then RIGHT, as a fold over a session's frames.

The same transition runs over a batch (frames of a session in order) and in a stream
(one state per session, with a timer in event time), so both give the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Limits of the challenge: degrees, nose ratios, frames and seconds.
YAW, PITCH, NOSE_LEFT, NOSE_RIGHT = 10.0, 18.0, 0.78, 1.28
HOLD, SMOOTH, MAX_SECONDS, MAX_FRAMES, MAX_FACELESS = 3, 4, 10.0, 300, 15
#: A pass is revoked where the landmarks of the last SNAPSHOTS frames, LEAST_SNAPSHOTS at least, vary by less than STILL.
SNAPSHOTS, LEAST_SNAPSHOTS, STILL = 30, 15, 1e-7
#: Confidence of each end; of a pass the base, what motion adds per variance and at most, and the frames from which motion counts.
CONFIDENCE = {"TIMEOUT": 0.20, "TOO_MANY_FRAMES": 0.20, "NO_FACE": 0.10, "MULTIPLE_FACES": 0.15, "STATIC_SPOOF": 0.15, "INCOMPLETE": 0.20}
BASE, MOTION, MOST_MOTION, LEAST_MOTION = 0.92, 50.0, 0.06, 5
STAGES = ("CENTER", "TURN_LEFT", "TURN_RIGHT", "PASSED")
RESULT = "session_id long, stage string, status string, reason string, frames long, elapsed double, confidence double"
STATE = "stage int, hold int, frames long, faceless int, start double, last double, failed string, variance double, yaws array<double>, pitches array<double>, counts array<double>, sums array<double>, squares array<double>"
_FRAME = ("at", "faces", "yaw", "pitch", "nose", "landmarks")


def _mean(values: list[float]) -> float:
    """Mean of a few numbers added up one after the other, as numpy and SQL do; Python's sum() carries what rounding loses, so means on a limit would go the other way."""
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


@dataclass
class Challenge:
    """State of one session; ``failed`` holds the reason. Of the last snapshots of landmarks it keeps how many numbers they have, their sums and sums of squares."""

    stage: int = 0
    hold: int = 0
    frames: int = 0
    faceless: int = 0
    start: float | None = None
    last: float | None = None
    failed: str | None = None
    variance: float = 0.0
    yaws: list[float] = field(default_factory=list)
    pitches: list[float] = field(default_factory=list)
    counts: list[float] = field(default_factory=list)
    sums: list[float] = field(default_factory=list)
    squares: list[float] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return STAGES[self.stage] == "PASSED" and not self.failed

    @property
    def finished(self) -> bool:
        return self.passed or bool(self.failed)

    def step(self, at: float, faces: int, yaw: float | None, pitch: float | None, nose: float | None, landmarks=None) -> None:
        """One frame. A finished challenge stays as it is; a frame without a pose has no face."""
        if self.finished:
            return
        self.start = at if self.start is None else self.start
        self.last, self.frames = at, self.frames + 1
        if at - self.start > MAX_SECONDS:
            self.failed = "TIMEOUT"
        elif self.frames > MAX_FRAMES:
            self.failed = "TOO_MANY_FRAMES"
        elif faces == 0 or yaw is None or pitch is None:
            self.faceless += 1
            if self.faceless > MAX_FACELESS:
                self.failed = "NO_FACE"
        elif faces > 1:
            self.failed = "MULTIPLE_FACES"
        else:
            self.faceless = 0
            self._remember(landmarks)
            self.yaws, self.pitches = [*self.yaws, yaw][-SMOOTH:], [*self.pitches, pitch][-SMOOTH:]
            mean, tilt = _mean(self.yaws), _mean(self.pitches)
            left, right = (False, False) if nose is None else (nose < NOSE_LEFT, nose > NOSE_RIGHT)
            met = (abs(mean) < YAW and abs(tilt) < PITCH, mean <= -YAW or left, mean >= YAW or right)[self.stage]
            self.hold = self.hold + 1 if met else max(0, self.hold - 1)
            if self.hold >= HOLD:
                self.stage, self.hold = self.stage + 1, 0
                if STAGES[self.stage] == "PASSED":
                    self._veto()

    def _remember(self, landmarks) -> None:
        values = [float(x) for x in landmarks if x is not None] if landmarks is not None else []
        if values:
            for ring, x in ((self.counts, float(len(values))), (self.sums, sum(values)), (self.squares, sum(x * x for x in values))):
                ring.append(x)
                del ring[:-SNAPSHOTS]

    def _veto(self) -> None:
        """The last check of a frame that passes: all snapshots' numbers together must vary."""
        if len(self.counts) >= LEAST_MOTION:
            n = sum(self.counts)
            self.variance = max(0.0, sum(self.squares) / n - (sum(self.sums) / n) ** 2)
        if len(self.counts) >= LEAST_SNAPSHOTS and self.variance < STILL:
            self.failed = "STATIC_SPOOF"

    def expire(self) -> None:
        """No frame came in time."""
        if not self.finished:
            self.failed = "TIMEOUT"

    def result(self, session: int) -> dict:
        reason = None if self.passed else self.failed or "INCOMPLETE"
        confidence = round(BASE + min(MOST_MOTION, self.variance * MOTION), 2) if self.passed else CONFIDENCE[reason]
        return {"session_id": session, "stage": "FAILED" if self.failed == "STATIC_SPOOF" else STAGES[self.stage], "status": "PASS" if self.passed else "FAIL", "reason": reason, "frames": self.frames, "elapsed": (self.last or 0.0) - (self.start or 0.0), "confidence": confidence}


def _folded(until: float | None):
    """Sessions' verdicts from frames that come by session, in order; a session's frames may go over several batches."""

    def told(session: int, state: Challenge) -> dict:
        if until is not None and state.start is not None and state.start + MAX_SECONDS < until:
            state.expire()
        return state.result(session)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, done = None, None, []
        schema = pa.schema([("session_id", pa.int64()), ("stage", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("frames", pa.int64()), ("elapsed", pa.float64()), ("confidence", pa.float64())])
        for batch in batches:
            for key, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != session:
                    if state is not None:
                        done.append(told(session, state))
                    session, state = key, Challenge()
                state.step(*frame)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([told(session, state)], schema)

    return run


def _with_landmarks(frames: DataFrame) -> DataFrame:
    return frames if "landmarks" in frames.columns else frames.withColumn("landmarks", F.lit(None).cast("array<double>"))


def judge(frames: DataFrame, until: float | None = None) -> DataFrame:
    """Verdict per session of a batch of frames (session_id, frame_id, at in seconds, faces, yaw, pitch, nose and, if there, landmarks: the numbers of the first landmarks).

    A challenge is finished by the frame after MAX_FRAMES at the latest and stays as it is then, so no
    more frames of a session are handed on; they stream through a task in order, and a task holds one session's state. With ``until`` (in seconds) a session that
    isn't finished by then although its time was up before is a TIMEOUT without another frame. Frames without session or time take no part.
    """
    order = Window.partitionBy("session_id").orderBy("at", F.col("frame_id").asc_nulls_last())
    known = _with_landmarks(frames).where("session_id IS NOT NULL AND at IS NOT NULL")
    first = known.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= MAX_FRAMES + 1)
    ordered = first.sortWithinPartitions("session_id", "__place")  # as the window leaves them
    return ordered.select(F.col("session_id").cast("long"), F.col("at").cast("double"), F.coalesce(F.col("faces"), F.lit(0)).cast("int"), *(F.col(c).cast("double") for c in _FRAME[2:5]), F.col("landmarks").cast("array<double>")).mapInArrow(_folded(until), RESULT)


def judge_stream(frames: DataFrame, late_seconds: int = 5, keep_seconds: float = 60.0) -> DataFrame:
    """The same over a stream: a session's verdict so far with every batch that has frames of it, and its TIMEOUT when its time is up in event time.

    Frames of a session come in order of time over batches; later than ``late_seconds`` after the newest frame of all sessions they are dropped. A timer
    ends a silent session without another frame, once the watermark has passed its MAX_SECONDS. A session's state goes ``keep_seconds`` after that; until
    then it tells further frames that the challenge is over.
    """
    names = [f.name for f in fields(Challenge)]

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = Challenge(**{n: list(v) if isinstance(v, (list, tuple)) else v for n, v in zip(names, group.get, strict=True)}) if group.exists else Challenge()
        before = state.finished
        if group.hasTimedOut:
            if before:
                group.remove()
                return
            state.expire()
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "frame_id"])
            for frame in zip(*(rows[c].tolist() for c in _FRAME), strict=True):
                state.step(*(None if isinstance(x, float) and x != x else x for x in frame))
        group.update(tuple(asdict(state).values()))
        # Whole milliseconds after the time is up, or after what is kept of a finished session; not before the watermark, which Spark forbids.
        ends = int(((state.start or 0.0) + MAX_SECONDS + (keep_seconds if state.finished else 0.0)) * 1000) + 1
        group.setTimeoutTimestamp(max(ends, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([state.result(key[0])])

    timed = _with_landmarks(frames).where("session_id IS NOT NULL AND at IS NOT NULL").withColumn("seen", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return timed.withWatermark("seen", f"{late_seconds} seconds").groupBy("session_id").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
