"""Daily counts and rate limits, in batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boardfoot.plans.shared import materialize


def stream_daily_counts(events: DataFrame, when: str, late: str = "1 day") -> DataFrame:
    """Events a calendar day and kind; those later than `late` behind the newest are dropped."""
    return events.withWatermark(when, late).groupBy(F.window(when, "1 day"), "action").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "action", "n")


def decide(times: list[float], at: float, failed: bool, most: int = 5, window: float = 300.0) -> tuple[bool, int, list[float]]:
    """Whether an attempt at `at` is allowed, the wait, and the recorded attempts after it. Only failed, allowed attempts are recorded."""
    recent = [t for t in times if at - t < window]
    if len(recent) >= most:
        return False, max(1, int(window - (at - recent[0]))), recent
    return True, 0, [*recent, at] if failed else recent


def _replay(key, rows: pd.DataFrame, times: list[float]) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["t", "id"])
    out = []
    for i, t, failed in zip(rows["id"], rows["t"], rows["failed"]):
        allowed, wait, times = decide(times, t, bool(failed))
        out.append((i, key, int(allowed), wait))
    return pd.DataFrame(out, columns=["id", "ip", "allowed", "wait"]), times


SCHEMA = "id long, ip string, allowed int, wait int"


def quiet_stretches(attempts: DataFrame, window: float = 300.0) -> DataFrame:
    """`attempts` with `since`, the time of the last attempt before which no attempt of the ip had failed for `window` seconds.

    At such an attempt nothing recorded is left, whatever came before, so what lies between two of them can be judged by itself.
    Times are cut into pieces as long as the window. Only failures of the same and of the piece before can be near enough, so a
    row looks at its own piece and at one number of the piece before; which stretch a piece begins in is carried from piece to
    piece by one number each. No task sees all attempts of an ip.
    """
    rows = attempts.withColumn("piece", F.floor(F.col("t") / window))
    rows = materialize(rows.select("id", "ip", "t", "failed", "piece"), "attempts")
    within = Window.partitionBy("ip", "piece").orderBy("t", "id")
    failed_at = F.when(F.col("failed") == 1, F.col("t"))
    ends = rows.groupBy("ip", "piece").agg(F.max(failed_at).alias("last")).where("last is not null")
    before = ends.select("ip", (F.col("piece") + 1).alias("piece"), F.col("last").alias("piece_before"))
    same = (F.col("a.ip").eqNullSafe(F.col("b.ip"))) & (F.col("a.piece") == F.col("b.piece"))
    rows = rows.alias("a").join(before.alias("b"), same, "left").select("a.*", "piece_before")
    last = F.coalesce(F.max(failed_at).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("piece_before"))
    start = F.when(last.isNull() | (F.col("t") - last >= window), F.col("t"))
    rows = materialize(rows.withColumn("start", start).withColumn("own", F.max("start").over(within.rowsBetween(Window.unboundedPreceding, 0))), "starts")
    by_piece = rows.groupBy("ip", "piece").agg(F.max("start").alias("start"))
    carried = by_piece.select("ip", "piece", F.last("start", ignorenulls=True).over(Window.partitionBy("ip").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return rows.alias("a").join(carried.alias("b"), same).select("a.id", "a.ip", "a.t", "a.failed", F.coalesce("a.own", "b.carried").alias("since"))


def rate_limit(attempts: DataFrame) -> DataFrame:
    """Verdicts on attempts (id, ip, t in seconds, failed). Each depends on those before it from the same ip, back to where the ip
    has been quiet (`quiet_stretches`); a stretch passes one task in order, a batch at a time, and an ip is many tasks."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of some stretches, one after another in order of time; only recorded attempts go from row to row."""
        last, times = None, []
        for batch in batches:
            ips = batch["ip"].astype(object).where(batch["ip"].notna(), None)
            verdicts = []
            for ip, since, at, failed in zip(ips, batch["since"], batch["t"], batch["failed"]):
                if (ip, since) != last:
                    last, times = (ip, since), []
                allowed, wait, times = decide(times, at, bool(failed))
                verdicts.append((int(allowed), wait))
            allowed, wait = zip(*verdicts) if verdicts else ((), ())
            yield pd.DataFrame({"id": batch["id"], "ip": ips, "allowed": list(allowed), "wait": list(wait)})

    cut = quiet_stretches(attempts.select("id", "ip", F.col("t").cast("double").alias("t"), "failed"))
    return cut.repartition("ip", "since").sortWithinPartitions("ip", "since", "t", "id").mapInPandas(replay, SCHEMA)


def stream_rate_limit(attempts: DataFrame) -> DataFrame:
    """The same on a stream in order of time; an ip's state is its recorded attempts, and ends when it is quiet. Attempts over
    10 minutes behind the newest are dropped."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        arrived = pd.concat(frames)
        rows, times = _replay(key[0], arrived, times)
        state.update((times,))
        state.setTimeoutTimestamp(max(int(arrived["t"].max() * 1000), state.getCurrentWatermarkMs()) + 600_000)
        yield rows

    # Event time, not the clock, ends a quiet state: with the clock a query that takes what is there would never stop. A
    # millisecond is added because Spark drops what is not later than its first watermark, time 0.
    timed = attempts.withColumn("at", F.timestamp_millis((F.col("t") * 1000).cast("long") + 1)).withWatermark("at", "10 minutes")
    return timed.groupBy("ip").applyInPandasWithState(step, SCHEMA, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
