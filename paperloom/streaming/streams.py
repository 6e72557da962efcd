"""Structured Streaming forms (R1, R2, R4, R5, R7, R8; R3: budget.py, K4: facts.py); each also runs on a batch of the same rows where that makes sense."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, COOLDOWN = 3, 60  # fixed values: failures that open a breaker, and seconds until it is half open


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def log_tail(logs: DataFrame, since: int, level: str | None = None, text: str | None = None, most: int = 100) -> DataFrame:
    """The last entries behind an id, in order."""
    rows = logs.where(F.col("id") > since)
    rows = rows if level is None else rows.where(F.col("level") == level)
    rows = rows if text is None else rows.where(F.col("msg").ilike(f"%{text}%"))
    return rows.orderBy(F.desc("id")).limit(most).orderBy("id")


def rate_windows(events: DataFrame, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events (ts, user_id) a window and user; on a stream, windows close ``late`` behind the newest event."""
    windows = F.window("ts", width, slide)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(windows.alias("w"), "user_id").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "calls")


def breaches(windows: DataFrame, most: int) -> DataFrame:
    """Windows with more calls than allowed."""
    return windows.where(F.col("calls") > most)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a pause of ``gap`` are one session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "calls")


def first_of_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One active row a user within the watermark; in a batch the first by ts, of equal ones the least in its other
    columns."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])
    first = F.min(F.struct("ts", *(c for c in events.columns if c not in ("ts", "user_id")))).alias("f")
    return events.groupBy("user_id").agg(first).select(*(F.col("f")[c].alias(c) if c != "user_id" else F.col(c) for c in events.columns))


STATE = "provider string, at double, success boolean, allowed boolean, state string, failures int"


def _step(state: str, failures: int, opened: float, at: float, success: bool) -> tuple[str, int, float, bool]:
    """The breaker's state behind a call at a time: (state, failures, opened, allowed)."""
    if state == "OPEN":
        if at - opened < COOLDOWN:
            return state, failures, opened, False
        state = "HALF_OPEN"
    if success:
        return "CLOSED", 0, opened, True
    failures += 1
    if state == "HALF_OPEN" or failures >= FAILURES:
        return "OPEN", failures, at, True
    return state, failures, opened, True


def _traced(calls: pd.DataFrame, state: tuple[str, int, float]) -> tuple[pd.DataFrame, tuple[str, int, float]]:
    rows = []
    name, failures, opened = state
    for c in calls.sort_values(["at", "seq"]).itertuples():
        name, failures, opened, allowed = _step(name, failures, opened, c.at, bool(c.success))
        rows.append((c.provider, c.at, bool(c.success), allowed, name, failures))
    return pd.DataFrame(rows, columns=["provider", "at", "success", "allowed", "state", "failures"]), (name, failures, opened)


def breaker_trace(calls: DataFrame) -> DataFrame:
    """R2 on a batch: calls (provider, at in seconds, seq, success). As each call depends on the one before, a provider's
    calls follow each other in one task, which keeps only the breaker's state."""

    def trace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, state = None, None
        for part in parts:
            rows = []
            for c in part.itertuples():
                if state is None or c.provider != provider:
                    provider, state = c.provider, ("CLOSED", 0, 0.0)
                *now, allowed = _step(*state, c.at, bool(c.success))
                state = tuple(now)
                rows.append((c.provider, c.at, bool(c.success), allowed, state[0], state[1]))
            yield pd.DataFrame(rows, columns=["provider", "at", "success", "allowed", "state", "failures"])

    rows = calls.select("provider", "at", "seq", "success").repartition("provider")
    return rows.sortWithinPartitions("provider", F.asc_nulls_last("at"), F.asc_nulls_last("seq")).mapInPandas(trace, STATE)


def breaker_stream(calls: DataFrame) -> DataFrame:
    """R2 on a stream: the state of each provider is kept between batches."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("CLOSED", 0, 0.0)
        out, now = _traced(pd.concat(list(frames)), now)
        state.update(now)
        yield out

    return calls.groupBy("provider").applyInPandasWithState(step, STATE, "name string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def not_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not completed yet."""
    return rows.join(done.select(*keys).distinct(), [*keys], "left_anti")
