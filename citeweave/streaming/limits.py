"""Request limits, one-time tokens and leases, as batch windows and as streams.

Batch forms take any DataFrame; stream forms take a streaming one and keep their state in the
state store. A request counts against several subjects; in the batch form each subject is
judged alone, in the stream form ``allow_all`` judges the subjects of one group together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_id(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def window_counts(events: DataFrame, subject: str, ts: str, seconds: int) -> DataFrame:
    """subject, window_id, n: requests in fixed windows (batch or, behind a watermark, streaming)."""
    return events.groupBy(subject, window_id(F.col(ts), seconds).alias("window_id")).agg(F.count(F.lit(1)).alias("n"))


def allow(events: DataFrame, subject: str, ts: str, order: str, seconds: int, most: int) -> DataFrame:
    """Adds request_no and allowed: the first ``most`` requests of a subject's window pass; refused ones do not count."""
    w = Window.partitionBy(subject, window_id(F.col(ts), seconds)).orderBy(ts, order)
    return events.withColumn("request_no", F.row_number().over(w)).withColumn("allowed", F.col("request_no") <= most)


def soft_limit(counts: DataFrame, most: int, ratio: float) -> DataFrame:
    """Adds challenge: a window has reached the share ``ratio`` of its limit."""
    return counts.withColumn("challenge", F.lit(True) if ratio <= 0 else F.lit(False) if ratio > 1 else F.col("n") >= max(1, int(most * ratio)))


def prune(state: DataFrame, now: Column, retention_seconds: int, updated: str = "updated_at") -> DataFrame:
    """Windows that were touched within the retention."""
    return state.where(F.unix_timestamp(F.col(updated)) >= F.unix_timestamp(now) - retention_seconds)


def consume_once(events: DataFrame, key: str, ts: str, order: str, ttl_seconds: int) -> DataFrame:
    """Adds consumed: a token passes once until it expires ``ttl_seconds`` after it was taken (batch).

    A token may pass again after it has expired, so which uses pass depends on those before:
    a fold over each token's times in order.
    """
    times = F.sort_array(F.collect_list(F.struct(F.unix_timestamp(ts).alias("t"), F.col(order).alias("o"))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{events.schema[order].dataType.simpleString()}>").alias("passed"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["last"].isNull() | (x["t"] > acc["last"] + ttl_seconds)
        return F.when(fresh, F.struct(x["t"].alias("last"), F.concat(acc["passed"], F.array(x["o"])).alias("passed"))).otherwise(acc)

    passed = events.groupBy(key).agg(F.aggregate(times, start, step, lambda a: a["passed"]).alias("passed"))
    return events.join(passed, key).withColumn("consumed", F.array_contains("passed", F.col(order))).drop("passed")


def consume_stream(events: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """The first use of each token, as a stream; state is kept for the token's life."""
    return events.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


def _until(state: GroupState, seconds: float) -> None:
    """Let the state be dropped once the watermark has passed ``seconds``."""
    state.setTimeoutTimestamp(max(int(seconds * 1000), state.getCurrentWatermarkMs() + 1))


def _watched(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds")


def allow_stream(events: DataFrame, subject: str, ts: str, order: str, seconds: int, most: int) -> DataFrame:
    """``allow`` as a stream: subject, order, window_id, allowed of each request.

    A subject's state is dropped when the watermark, which lags by one window, has passed its
    window; requests that come later than that are not answered, as for any watermark.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{subject} {kinds[subject]}, {order} {kinds[order]}, window_id long, allowed boolean"

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values([ts, order])
        result = []
        for r in rows.itertuples(index=False):
            w = int(getattr(r, ts).timestamp() // seconds)
            if w > current:
                current, n = w, 0
            passes = w == current and n < most
            n += passes
            result.append((key[0], getattr(r, order), w, passes))
        state.update((current, n))
        _until(state, (current + 1) * seconds)
        yield pd.DataFrame(result, columns=[subject, order, "window_id", "allowed"])

    return _watched(events, ts, seconds).groupBy(subject).applyInPandasWithState(decide, out, "current long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def allow_all(requests: DataFrame, limits: dict[str, tuple[int, int]], group: str, ts: str, order: str) -> DataFrame:
    """A request passes only if every one of its subjects is under its limit, and then counts for all of them (stream).

    ``limits`` maps subject columns to (seconds, most). Requests that share subjects must
    share ``group``, whose requests are decided one after another. Subjects whose window is
    over are forgotten with each decision, and a group when the watermark has passed them all.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    out = f"{order} {kinds[order]}, allowed boolean"
    longest = max(s for s, _ in limits.values())

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, windows, counts, ends = state.get if state.exists else ([], [], [], [])
        held = {n: (w, c, e) for n, w, c, e in zip(names, windows, counts, ends, strict=True)}
        result = []
        for r in pd.concat(list(batches)).sort_values([ts, order]).itertuples(index=False):
            now = getattr(r, ts).timestamp()
            subjects = {f"{c}={getattr(r, c)}": (int(now // s), most, int(now // s + 1) * s) for c, (s, most) in limits.items()}
            used = {k: held[k][1] if k in held and held[k][0] == w else 0 for k, (w, _, _) in subjects.items()}
            passes = all(used[k] < most for k, (_, most, _) in subjects.items())
            if passes:
                held |= {k: (w, used[k] + 1, e) for k, (w, _, e) in subjects.items()}
            result.append((getattr(r, order), passes))
        over = state.getCurrentWatermarkMs() / 1000
        held = {k: v for k, v in held.items() if v[2] > over}
        state.update((list(held), [w for w, _, _ in held.values()], [c for _, c, _ in held.values()], [e for _, _, e in held.values()]))
        _until(state, max((e for _, _, e in held.values()), default=0))
        yield pd.DataFrame(result, columns=[order, "allowed"])

    kept = "names array<string>, windows array<long>, counts array<long>, ends array<long>"
    return _watched(requests, ts, longest).groupBy(group).applyInPandasWithState(decide, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def leases(events: DataFrame, pool: str, most: int, lease_seconds: int) -> DataFrame:
    """Slots of a pool: events (pool, job_id, action acquire or release, ts) to (job_id, ts, granted) (stream).

    A lease ends by release or after ``lease_seconds``; a job that holds one is refused another.
    A pool without leases has no state, and its state ends with its last lease.
    """
    kind = events.schema[pool].dataType.simpleString()

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        jobs, since = state.get if state.exists else ([], [])
        held = dict(zip(jobs, since, strict=True))
        result = []
        for r in pd.concat(list(batches)).sort_values(["ts", "job_id"]).itertuples(index=False):
            now = r.ts.timestamp()
            held = {j: t for j, t in held.items() if t >= now - lease_seconds}
            if r.action == "release":
                held.pop(r.job_id, None)
                continue
            granted = r.job_id not in held and len(held) < most
            if granted:
                held[r.job_id] = now
            result.append((key[0], r.job_id, r.ts, granted))
        if held:
            state.update((list(held), list(held.values())))
            _until(state, max(held.values()) + lease_seconds + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(result, columns=[pool, "job_id", "ts", "granted"])

    return _watched(events, "ts", lease_seconds).groupBy(pool).applyInPandasWithState(decide, f"{pool} {kind}, job_id string, ts timestamp, granted boolean", "jobs array<string>, since array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """job_id, owner, status, updated_at: the last legal state of each job; completed and failed ones are gone after their time.

    Legal moves are queued to running, and running to completed or failed.
    """
    steps = F.sort_array(F.collect_list(F.struct("ts", "status")))
    begin = F.struct(F.lit("none").alias("status"), F.lit(None).cast("timestamp").alias("ts"))

    def step(acc: Column, e: Column) -> Column:
        legal = ((acc["status"] == "none") & (e["status"] == "queued")) | ((acc["status"] == "queued") & (e["status"] == "running")) | ((acc["status"] == "running") & e["status"].isin("completed", "failed"))
        return F.when(legal, F.struct(e["status"].alias("status"), e["ts"].alias("ts"))).otherwise(acc)

    rows = events.groupBy("job_id").agg(F.min_by("owner", "ts").alias("owner"), F.aggregate(steps, begin, step).alias("s"))
    old = F.col("s.status").isin("completed", "failed") & (F.unix_timestamp(now) - F.unix_timestamp("s.ts") > ttl_seconds)
    return rows.select("job_id", "owner", F.when(old, "gone").otherwise(F.col("s.status")).alias("status"), F.col("s.ts").alias("updated_at"))


def pressure(queued: DataFrame, most: int) -> DataFrame:
    """queue_depth, pressure (at most 1), accepts."""
    return queued.agg(F.count(F.lit(1)).alias("queue_depth")).select("queue_depth", F.least(F.lit(1.0), F.col("queue_depth") / most).alias("pressure"), (F.col("queue_depth") < most).alias("accepts"))
