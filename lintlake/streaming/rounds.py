"""Fix/scan rounds on a stream: a few numbers a file, closed by its outcome or by a timer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.times import with_event_time
from lintlake.sources.config import DEFAULT_MAX_ITERATIONS

RESULT = "project_hash string, path string, stop_round int, errors_left long, outcome string"
# Files share a state by a hash of their names, so that a task is called once a bucket and not once a file.
BUCKETS = 512
# files: per file [project_hash, path, rounds, closed, touched, due, most] as JSON; rounds: errors by round of the rounds
# seen; closed: the outcome is out; touched: the last event; due: when the file's own timer runs out; both in ms.
_STATE = "files string"


def outcome_of(rounds: dict[int, int], most: int, complete: bool) -> tuple[int, int, str] | None:
    """(stop round, errors left, outcome) of the rounds seen, by the rules of ``fix_convergence``.

    Unless the run is ``complete``, only rounds that follow each other from the first one are judged,
    since a missing one may still come, and a run that has not stopped has no outcome.
    """
    before, last = None, None
    for position, number in enumerate(sorted(r for r in rounds if r <= most)):
        if not complete and number != position + 1:
            return None
        last = (number, rounds[number])
        if last[1] == 0:
            return *last, "clean"
        if before is not None and last[1] >= before:
            return *last, "stalled"
        if number >= most:
            return *last, "exhausted"
        before = last[1]
    return (*last, "open") if complete and last else None


def _follow(idle_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        files = {(f[0], f[1]): ({int(r): n for r, n in f[2].items()}, *f[3:]) for f in json.loads(state.get[0])} if state.exists else {}
        results: list[tuple] = []
        events: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for project, path, *row in zip(*(frame[c].tolist() for c in ("project_hash", "path", "at", "round", "n_errors", "most")), strict=True):
                    events.setdefault((project, path), []).append(tuple(row))
        now = state.getCurrentWatermarkMs()

        for file, rows in events.items():
            rounds, closed, touched, _, most = files.get(file, ({}, False, 0, 0, DEFAULT_MAX_ITERATIONS))
            for at, number, n_errors, limit in sorted(rows):
                if touched and at > touched + idle_ms:  # a pause: the timer was only not heard yet
                    found = None if closed else outcome_of(rounds, most, complete=True)
                    if found:
                        results.append((*file, *found))
                    rounds, closed = {}, False
                touched, most = max(touched, int(at)), int(limit)
                if not closed and number <= most:
                    rounds.setdefault(int(number), int(n_errors))  # delivered twice, counted once
                    found = outcome_of(rounds, most, complete=False)
                    if found:
                        results.append((*file, *found))
                        closed = True
            files[file] = ({} if closed else rounds, closed, touched, max(touched + idle_ms, now + 1), most)
        for file in [f for f, known in files.items() if known[3] < now and f not in events]:
            rounds, closed, _, _, most = files.pop(file)
            found = None if closed else outcome_of(rounds, most, complete=True)
            if found:
                results.append((*file, *found))

        if files:
            state.update((json.dumps([(*file, *known) for file, known in files.items()], separators=(",", ":")),))
            state.setTimeoutTimestamp(max(min(known[3] for known in files.values()), now))
        elif state.exists:
            state.remove()
        if results:
            yield pd.DataFrame(results, columns=["project_hash", "path", "stop_round", "errors_left", "outcome"])

    return run


def stream_convergence(rounds: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes", time: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """(project_hash, path, stop_round, errors_left, outcome), one row a run, as soon as it is known.

    ``rounds`` is a stream of (project_hash, path, round, n_errors, <time>[, max_iterations]), one
    row a scan of a file; rounds count from 1 and may come late, in any order and more than once.
    A run is what happens to a path of a project without a pause of ``idle``.  It ends at once when its rounds, one
    after the other, meet a stop rule of ``fix_convergence``; what else comes for it is ignored.  A
    timer closes the run ``idle`` after its last event: one that has not stopped is judged by the rounds seen, and its
    state is dropped.  State is bounded by max_iterations small numbers a file that is being edited; files of one of
    ``buckets`` hash values share a state and the nearest of their timers.
    """
    spark = rounds.sparkSession
    idle_ms = spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00 UTC' + INTERVAL {idle}) AS ms").first().ms
    most = F.coalesce("max_iterations", F.lit(DEFAULT_MAX_ITERATIONS)) if "max_iterations" in rounds.columns else F.lit(DEFAULT_MAX_ITERATIONS)
    timed = with_event_time(rounds, time, "event_time").withWatermark("event_time", delay)
    bucket = F.pmod(F.xxhash64("project_hash", "path"), F.lit(buckets)).cast("int")
    rows = timed.select(
        bucket.alias("bucket"), "project_hash", "path", F.col("round").cast("int").alias("round"), F.col("n_errors").cast("long").alias("n_errors"),
        most.cast("int").alias("most"), F.unix_millis("event_time").alias("at"), "event_time",
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        _follow(idle_ms), outputStructType=RESULT, stateStructType=_STATE, outputMode="append", timeoutConf="EventTimeTimeout"
    )
