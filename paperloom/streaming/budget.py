"""A running budget for each run of calls, as a stream and as a batch.

A run's calls are added up in the order of (at, seq). A call whose cost takes the total over the limit is still counted, and
marks the run ``exceeded``; later calls are ``blocked``. External costs count, but don't block by themselves. A token total over
its limit is only marked. A pause of ``idle`` or more ends the run: the next call of that run_id begins a new one at zero.

In the stream, calls wait in the state until the watermark has passed them, so those that arrive late, but within ``late``, take
their place, and each call is given once. Timers do both: they release calls, and clear the state of runs that have ended. Costs
are integers (millionths), so both forms give the same rows.

Defined results: calls without run_id are a run; a null cost or token number counts as zero; calls without a time are left
out of both forms, as the stream drops what is behind its watermark; calls of equal (at, seq) go by cost, tokens, external.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GUARDED = "run_id string, at timestamp, seq long, cost_total long, tokens_total long, remaining long, status string, over_tokens boolean"
HELD = "at timestamp, seq long, cost long, tokens long, external boolean"
TOTALS = "cost long, tokens long, blocked boolean, last timestamp"
ORDER = ["at", "seq", "cost", "tokens", "external"]


def calls(rows: DataFrame) -> DataFrame:
    """(run_id, at, seq, cost, tokens, external), complete."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return rows.where("at is not null").select(F.coalesce("run_id", F.lit("")).alias("run_id"), "at", number("seq"), number("cost"), number("tokens"), F.coalesce("external", F.lit(False)).alias("external"))


def guarded(rows: DataFrame, cost_limit: int, token_limit: int, idle: str = "1 hour") -> DataFrame:
    """The batch form: running sums over each run's calls."""
    run, order = Window.partitionBy("run_id").orderBy(*ORDER), Window.partitionBy("run_id", "_part").orderBy(*ORDER)
    before = F.lag("at").over(run)
    parts = calls(rows).withColumn("_new", F.when(F.col("at") >= before + F.expr(f"interval {idle}"), 1).otherwise(0))
    parts = parts.withColumn("_part", F.sum("_new").over(run))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({"cost_total": F.sum("cost").over(so_far), "tokens_total": F.sum("tokens").over(so_far)})
    breach = (F.col("cost_total") > cost_limit) & ~F.col("external")
    earlier = F.coalesce(F.max(breach).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    status = F.when(earlier, "blocked").when(breach, "exceeded").otherwise("ok")
    return out.select("run_id", "at", "seq", "cost_total", "tokens_total", F.greatest(F.lit(0).cast("long"), cost_limit - F.col("cost_total")).alias("remaining"), status.alias("status"), (F.col("tokens_total") > token_limit).alias("over_tokens"))


class Guard(StatefulProcessor):
    """One run: the calls that the watermark hasn't passed, and the totals of those that it has."""

    def __init__(self, cost_limit: int, token_limit: int, idle_seconds: float):
        self.cost_limit, self.token_limit, self.idle = cost_limit, token_limit, pd.Timedelta(seconds=idle_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for r in frame[ORDER].itertuples(index=False):
                self.held.appendValue((r.at.to_pydatetime(), int(r.seq), int(r.cost), int(r.tokens), bool(r.external)))
                first = r.at if first is None else min(first, r.at)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = sorted((pd.Timestamp(r[0]), *r[1:]) for r in self.held.get())
        due, left = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        cost, tokens, blocked, last = self.totals.get() if self.totals.exists() else (0, 0, False, None)
        out = []
        for at, seq, own_cost, own_tokens, external in due:
            if last is not None and at >= pd.Timestamp(last) + self.idle:
                cost, tokens, blocked = 0, 0, False
            cost, tokens, last = cost + own_cost, tokens + own_tokens, at
            exceeded = cost > self.cost_limit and not external
            status = "blocked" if blocked else "exceeded" if exceeded else "ok"
            blocked = blocked or exceeded
            out.append((key[0], at, seq, cost, tokens, max(0, self.cost_limit - cost), status, tokens > self.token_limit))
        if due:
            self.held.put([(at.to_pydatetime(), *r) for at, *r in left]) if left else self.held.clear()
            self.totals.update((cost, tokens, blocked, last.to_pydatetime()))
        if left:
            self._wake(left[0][0])
        elif last is not None and pd.Timestamp(last) + self.idle > passed:
            self._wake(pd.Timestamp(last) + self.idle)
        elif not left:
            self.totals.clear()
        names = ["run_id", "at", "seq", "cost_total", "tokens_total", "remaining", "status", "over_tokens"]
        yield pd.DataFrame(out, columns=names) if out else pd.DataFrame()

    def _wake(self, at: pd.Timestamp) -> None:
        self.handle.registerTimer(int(at.timestamp() * 1000) + 1)  # behind the call, not with it

    def close(self) -> None:
        pass


def guarded_stream(rows: DataFrame, cost_limit: int, token_limit: int, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The stream form, in append mode; it needs the RocksDB state store. idle: as for the batch form."""
    seconds = pd.Timedelta(idle).total_seconds()
    given = calls(rows).withWatermark("at", late)
    return given.groupBy("run_id").transformWithStateInPandas(Guard(cost_limit, token_limit, seconds), GUARDED, "append", "EventTime")
