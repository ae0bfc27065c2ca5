"""S4: turn / branch numbering of a live chat event stream, idle sessions evicted.

A custom stateful operator (``applyInPandasWithState``).  Sessions are dealt to buckets by
a hash, and a call takes the events and states of a bucket: a call costs some milliseconds,
however few its events are, so there is one for each bucket and batch, not for each session.  It holds a
session's state only while the session is live: when the watermark passes ``idle``
after its last event, the state is given out as a row and removed.  A session that
returns later begins a new stretch without knowing what came before, so a
stretch is numbered relative to its unknown beginning: pairs and branches since then,
how far below the beginning the pairs left to undo have sunk (``low``), and which of
those sinkings were retries, as these made a branch only if a pair was left.  After a
``new`` everything is known.  The sink, which sees each micro-batch as a table, looks
up the stored final states of the sessions concerned, completes the numbers, and
stores the final states of evicted sessions completed likewise.

Input micro-batches must arrive in event-time order per session (files written in time
order, read one per trigger); the result equals the batch ``operators.turns.number_turns``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .batches import batch_names, written

STATE_SCHEMA = "known boolean, seq long, branch long, pairs long, low long, weak_from array<long>, weak_to array<long>, last_us long"
#: A stretch's numbers at an accepted pair (``event_id``), or its state when it is evicted.
ROW_SCHEMA = f"session long, evicted boolean, event_id long, {STATE_SCHEMA}"
ROW_COLUMNS = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
#: What is kept of a bucket: its live sessions and their states, column by column.
BUCKET_SCHEMA = "session array<long>, " + ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in STATE_SCHEMA.split(", ")))
BUCKETS = 1024
#: Rows that a call gives out at once.
OUT_ROWS = 10_000
FINAL_SCHEMA = "session long, seq long, branch long, pairs long, last_us long"
PAIR_COLUMNS = ["session", "event_id", "sequence_no", "branch"]


class Stretch:
    """State of a session since it was last taken up.  ``known``: since its last ``new``, so nothing depends on
    what came before.  Else ``pairs`` is the sum of steps since the beginning, ``low`` how far it has been below 0,
    and retries that sank to a new low are kept as runs of those lows (weak: from, to)."""

    def __init__(self, known=False, seq=0, branch=0, pairs=0, low=0, weak_from=(), weak_to=(), last_us=0):
        self.known, self.seq, self.branch, self.pairs, self.low = known, seq, branch, pairs, low
        self.weak_from, self.weak_to, self.last_us = list(weak_from), list(weak_to), last_us

    def row(self) -> tuple:
        return (self.known, self.seq, self.branch, self.pairs, self.low, list(self.weak_from), list(self.weak_to), self.last_us)

    def apply(self, action: str) -> bool:
        """One action; True if it accepts a pair, which takes the numbers before they advance."""
        if action == "new":
            self.__init__(known=True, last_us=self.last_us)
        elif action == "assistant":
            return True
        elif action in ("back", "retry"):
            left = self.pairs > (0 if self.known else -self.low)
            if left or action == "back":
                self.branch += 1
            elif not self.known:
                if self.weak_to and self.weak_to[-1] == self.low:
                    self.weak_to[-1] += 1
                else:
                    self.weak_from.append(self.low + 1)
                    self.weak_to.append(self.low + 1)
            if left or not self.known:
                self.pairs -= 1
            if not left and not self.known:
                self.low += 1
        return False

    def accept(self) -> None:
        self.seq += 2
        self.pairs += 1


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ROW_COLUMNS, dtype=object)  # else a null among ids makes them floats


def _advance(idle_ms: int):
    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {session: Stretch(*s) for session, *s in zip(*state.get)} if state.exists else {}
        met, out = set(), []
        if not state.hasTimedOut:
            events = pd.concat(list(batches)).sort_values(["us", "no_event", "event_id"])
            columns = [events[c].tolist() for c in ("session", "no_session", "event_id", "no_event", "us", "action")]
            for session, no_session, event, no_event, us, action in zip(*columns):
                session = None if no_session else session
                s = held.get(session)
                if s is None:
                    s = held[session] = Stretch()
                met.add(session)
                if us > s.last_us:  # not if there is none
                    s.last_us = int(us)
                if s.apply(action):
                    out.append((session, False, None if no_event else event, *s.row()))
                    s.accept()
                    if len(out) == OUT_ROWS:
                        yield _rows(out)
                        out = []
        now = state.getCurrentWatermarkMs()
        for session in [x for x, s in held.items() if x not in met and s.last_us // 1000 + idle_ms < now]:
            out.append((session, True, 0, *held.pop(session).row()))
        if held:
            state.update(tuple(map(list, zip(*((session, *s.row()) for session, s in held.items())))))
            state.setTimeoutTimestamp(max(min(s.last_us for s in held.values()) // 1000 + idle_ms, now + 1))
        else:
            state.remove()
        if out:
            yield _rows(out)

    return advance


def numbered_stretches(events: DataFrame, idle_seconds: int, delay: str, session: str = "session", buckets: int = BUCKETS) -> DataFrame:
    """``events(session, ts, event_id, action)`` stream -> rows of ``ROW_SCHEMA`` (append).

    ``buckets`` is fixed for a checkpoint, as its state is kept by bucket.
    """
    own, event = F.col(session).cast("long"), F.col("event_id").cast("long")
    timed = events.select(
        F.pmod(F.xxhash64(own), F.lit(buckets)).alias("bucket"), F.coalesce(own, F.lit(0)).alias("session"), own.isNull().alias("no_session"),
        F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.coalesce(event, F.lit(0)).alias("event_id"), event.isNull().alias("no_event"), "action")
    return timed.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(
        _advance(idle_seconds * 1000), ROW_SCHEMA, BUCKET_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _effective(left: Column) -> Column:
    """How many weak retries made a branch when ``left`` pairs were left at the stretch's beginning."""
    runs = F.zip_with("weak_from", "weak_to", lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(b, left) - a + 1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, n: total + n)


def completed(rows: DataFrame, before: DataFrame) -> DataFrame:
    """``rows`` of stretches with their final numbers, given the states ``before(session, seq, branch, pairs)`` them."""
    entry = before.select(F.col("session").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("seq", "branch", "pairs")])
    joined = rows.join(entry, F.col("session").eqNullSafe(F.col("_s")), "left")
    own = {c: F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long")) for c in ("seq", "branch", "pairs")}
    known = F.col("known")
    return joined.select(
        "session", "evicted", "event_id", F.when(known, F.col("seq")).otherwise(own["seq"] + F.col("seq")).alias("seq"),
        F.when(known, F.col("branch")).otherwise(own["branch"] + F.col("branch") + _effective(own["pairs"])).alias("branch"),
        F.when(known, F.col("pairs")).otherwise(F.greatest(own["pairs"] + F.col("pairs"), F.col("pairs") + F.col("low"))).alias("pairs"), "last_us")


def stored_states(spark: SparkSession, out_dir: str, but: str | None = None) -> DataFrame:
    """Final state of every evicted session as it was last stored; ``but``: not by that batch."""
    rows = written(spark, f"{out_dir.rstrip('/')}/sessions", f"{FINAL_SCHEMA}, batch_id string")
    if but is not None:
        rows = rows.where(F.col("batch_id") != but)
    return rows.groupBy("session").agg(F.max_by(F.struct("seq", "branch", "pairs"), "last_us").alias("s")).select("session", "s.*")


def start_numbering(events: DataFrame, out_dir: str, checkpoint: str, idle_seconds: int = 1800, delay: str = "10 minutes",
                    available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Accepted pairs of the ``events`` stream into ``<out_dir>/pairs``, final states of sessions idle for
    ``idle_seconds`` of event time into ``<out_dir>/sessions``.

    Both are written by batch, so a repeated batch leaves its rows once.  Events later than
    ``delay`` behind the newest one are dropped by the watermark.
    """
    spark, named, out = events.sparkSession, batch_names(events.sparkSession, checkpoint), out_dir.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        name = named(batch_id)
        batch = batch.persist()
        asked = batch.where("NOT known").select(F.col("session").alias("_asked")).distinct()
        stored = stored_states(spark, out, but=name)
        rows = completed(batch, stored.join(asked, F.col("session").eqNullSafe(F.col("_asked")), "left_semi")).persist()
        pairs = rows.where("NOT evicted").select("session", "event_id", F.col("seq").alias("sequence_no"), "branch")
        pairs.write.mode("overwrite").parquet(f"{out}/pairs/batch_id={name}")
        rows.where("evicted").drop("evicted", "event_id").write.mode("overwrite").parquet(f"{out}/sessions/batch_id={name}")
        rows.unpersist()
        batch.unpersist()

    q = numbered_stretches(events, idle_seconds, delay, buckets=buckets).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def numbered_pairs(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(session, event_id, sequence_no, branch)`` of all pairs written so far."""
    return written(spark, f"{out_dir.rstrip('/')}/pairs", "session long, event_id long, sequence_no long, branch long").select(*PAIR_COLUMNS)
