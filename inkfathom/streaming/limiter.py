"""Stateful request limits and stream surfaces (R1-R3, and windowed rates as an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.operators.runs import map_runs

# At most six requests in a minute and sixty in an hour.
PER_MINUTE, PER_HOUR, MINUTE, HOUR = 6, 60, 60, 3600


def admit(times: list[float], now: float) -> tuple[bool, list[float]]:
    """Whether a request at ``now`` is admitted, and the hits to keep. A refused request leaves no trace; hits of an
    hour ago or older are forgotten (R3)."""
    kept = [t for t in times if now - t < HOUR]
    if len(kept) >= PER_HOUR or sum(now - t < MINUTE for t in kept) >= PER_MINUTE:
        return False, kept
    return True, [*kept, now]


def _replay(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    hits: list[float] = []
    out = []
    for now in part["ts"] / 1e6:
        ok, hits = admit(hits, now)
        out.append(ok)
    return {"event_id": part["event_id"], "user_id": part["user_id"], "admitted": np.array(out)}


def rate_limit(events: DataFrame) -> DataFrame:
    """R1 in batch: (event_id, user_id, admitted). A state machine per user: refusals are not counted, so a range window
    is not equivalent. Rows without a time or user are refused by leaving them out."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", "ts")
    return map_runs(rows, "user_id", ["ts", "event_id"], _replay, "event_id bigint, user_id bigint, admitted boolean")


def rate_limit_stream(events: DataFrame) -> DataFrame:
    """R1 as a stream: state per user is the list of admitted times, dropped an hour after the last."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        for part in parts:
            part = part.sort_values(["ts", "event_id"])
            out = []
            for ts in part["ts"]:
                ok, hits = admit(hits, pd.Timestamp(ts).timestamp())
                out.append(ok)
            yield pd.DataFrame({"event_id": part["event_id"], "user_id": part["user_id"], "admitted": out})
        state.update((hits,))
        if hits:
            state.setTimeoutTimestamp(max(int((hits[-1] + HOUR) * 1000), state.getCurrentWatermarkMs() + 1))

    rows = events.where("user_id IS NOT NULL").select("event_id", "user_id", "ts").withWatermark("ts", "10 minutes")
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, admitted boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_budget(events: DataFrame, budget: float = 7000.0) -> DataFrame:
    """R2: (event_id, day, spent_before, admitted): spending of a UTC day before each event, admitted while within budget.

    Every event's cost counts here, as reserved; days are the partitions, and a day's running sum is a window.
    """
    day = F.date_trunc("day", "ts")
    w = W.partitionBy("day").orderBy("ts", "event_id")
    d = events.withColumn("day", day).withColumn("cost", F.coalesce(F.col("value"), F.lit(0.0)))
    d = d.withColumn("spent_before", F.sum("cost").over(w) - F.col("cost"))
    return d.select("event_id", "day", "spent_before", (F.col("spent_before") + F.col("cost") <= budget).alias("admitted"))


def _settle(budget: float):
    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        spent, admitted, before = 0.0, [], []
        for est, actual in zip(part["est"], part["settled"], strict=True):
            before.append(spent)
            ok = spent + est <= budget
            admitted.append(ok)
            if ok:  # reserved, then settled
                spent = max(0.0, spent + est - est + actual)
        return {"event_id": part["event_id"], "day": part["day"], "admitted": np.array(admitted), "spent_before": np.array(before)}

    return run


def settled_budget(calls: DataFrame, budget: float = 7000.0) -> DataFrame:
    """(event_id, day, admitted, spent_before) of calls (event_id, ts, est, actual, outcome) in order of time.

    A call is refused if what the UTC day has spent and its estimate exceed the budget; a refused call spends nothing.
    An admitted call's estimate is reserved and then settled to its actual cost; it is refunded if the call failed before
    it went out (``failed_before``) and kept if the observer failed (``failed_after``). What was spent depends on every
    decision before, so a day is one sequence (a day's calls, a bounded number under any budget, in one task).
    """
    settled = F.when(F.col("outcome") == "failed_before", 0.0).when(F.col("outcome") == "failed_after", F.col("est")).otherwise(F.col("actual"))
    rows = calls.select("event_id", F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), "ts", "est", settled.alias("settled"))
    return map_runs(rows, "day", ["ts", "event_id"], _settle(budget), "event_id bigint, day string, admitted boolean, spent_before double")


def windowed_rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: events and mean value by type in tumbling or sliding windows; on a stream late rows are dropped after ``late``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: (user_id, start, end, n): runs of a user's events without a longer gap."""
    w = F.session_window("ts", gap)
    return events.where("user_id IS NOT NULL").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


