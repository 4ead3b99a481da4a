"""STR-2: one-time code matching on streams (JON-6 as a stream).

Codes and attempts arrive as one stream of events, dealt into ``TOKEN_BUCKETS``
buckets by a hash of (user, purpose). A state per bucket, not per user, since
each call to the state and each frame costs Python about as much as hundreds of
rows. Events wait in a typed list state, one element of columns per batch that
came in, until the watermark has passed them; then they are replayed with array
operations, per user and purpose in (time, kind, id) order, against the codes in
force (another typed list state: user, purpose, id, code, issue time, consumed
flag): an issue replaces the code in force (voiding the previous one), an attempt
is valid when its code equals the code in force within its lifetime (a code past
its lifetime is reported as none), and the first valid attempt consumes the code.
One event-time timer wakes a bucket when its next waiting event is due or a code's
lifetime is over; new events are appended, nothing is rewritten before it is due.
The batch twin is :func:`cartograph.operators.tokens.match_tokens`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cartograph.streaming.replay import LATENESS
from cartograph.streaming.windows import event_time

TTL_MINUTES = 15  # fixed value: lifetime of a one-time code
MATCH_OUT = ("attempt_id long, user_id long, purpose string, attempted_at timestamp_ntz, "
             "token_id long, valid boolean, matched boolean")
TOKEN_BUCKETS = 1024  # states; a state is replayed at once, so rows / buckets bounds what a call holds
WAITING = {"user_id": "long", "nobody": "boolean", "purpose": "string", "ts": "long", "kind": "int", "id": "long",
           "code": "string"}
IN_FORCE = {"user_id": "long", "nobody": "boolean", "purpose": "string", "ts": "long", "id": "long", "code": "string",
            "used": "boolean"}


def token_events(issued: DataFrame, attempts: DataFrame) -> DataFrame:
    """Issues (kind 0) and attempts (kind 1) stacked into one event shape."""
    i = issued.select("user_id", "purpose", F.col("issued_at").alias("ts"), F.lit(0).alias("kind"),
                      F.col("token_id").alias("id"), "code")
    a = attempts.select("user_id", "purpose", F.col("attempted_at").alias("ts"),
                        F.lit(1).alias("kind"), F.col("attempt_id").alias("id"), "code")
    return i.unionByName(a)


def match_tokens_stream(events: DataFrame, ttl_minutes: int = TTL_MINUTES, lateness: str = LATENESS,
                        buckets: int = TOKEN_BUCKETS) -> DataFrame:
    """Streaming matcher over :func:`token_events` rows (append mode). An
    attempt is answered once the watermark has passed it; a code leaves the
    state when its lifetime is over. Rows later than ``lateness`` are dropped
    by the watermark. ``buckets`` is part of the state: keep it with the
    checkpoint."""
    user = F.col("user_id")
    x = event_time(events).select(
        F.pmod(F.hash("user_id", "purpose"), F.lit(buckets)).alias("bucket"),
        F.coalesce(user, F.lit(0)).cast("bigint").alias("user_id"), user.isNull().alias("nobody"),
        "purpose", "ts", "kind", "id", "code").withWatermark("ts", lateness)
    return x.groupBy("bucket").transformWithStateInPandas(
        TokenMatcher(ttl_minutes * 60 * 1_000_000), MATCH_OUT, "append", "EventTime")


class TokenMatcher(StatefulProcessor):
    """Replay of one bucket of (user, purpose); times are microseconds."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{t}>" for c, t in WAITING.items()))
        self.force = handle.getListState("in_force", ", ".join(f"{c} array<{t}>" for c, t in IN_FORCE.items()))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            new = pd.DataFrame({c: pdf[c] for c in WAITING if c != "ts"})
            new["ts"] = pdf["ts"].values.astype("datetime64[us]").astype(np.int64)
            self.waiting.appendValue(_packed(new, WAITING))
            first = min(new["ts"].min(), first) if first is not None else new["ts"].min()
        if first is not None:
            self._wake(int(first) // 1000 + 1, timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter([out for out in [self._settle(timerValues)] if len(out)])

    def close(self) -> None:
        pass

    def _wake(self, at_ms: int, timer_values) -> None:
        """Wake the bucket at ``at_ms`` or, if that has passed, next time,
        unless it wakes before; a bucket has one timer."""
        now = timer_values.getCurrentWatermarkInMs()
        at_ms = max(at_ms, now + 1)
        set_for = [t for t in self.handle.listTimers() if t > now]
        if not any(t <= at_ms for t in set_for):
            for t in set_for:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def _settle(self, timer_values) -> pd.DataFrame:
        now = timer_values.getCurrentWatermarkInMs() * 1000
        rows, force = _unpacked(self.waiting, WAITING), _unpacked(self.force, IN_FORCE)
        later = rows["ts"] > now
        out, kept = replayed(rows[~later], force, self.ttl)
        kept = kept[kept["ts"] + self.ttl >= now]
        if not later.all():
            if later.any():
                self.waiting.put([_packed(rows[later], WAITING)])
            else:
                self.waiting.clear()
        if len(kept):
            self.force.put([_packed(kept, IN_FORCE)])
        elif len(force):
            self.force.clear()
        wake = ([int(rows["ts"][later].min()) // 1000 + 1] if later.any() else []) \
            + ([(int(kept["ts"].min()) + self.ttl) // 1000 + 1] if len(kept) else [])
        if wake:
            self._wake(min(wake), timer_values)
        return out


def _packed(rows: pd.DataFrame, columns: dict) -> tuple:
    """One list element: an array per column, nulls as None."""
    return tuple([None if v is None or v != v else v for v in rows[c].tolist()] if t == "string" else rows[c].tolist()
                 for c, t in columns.items())


def _unpacked(state, columns: dict) -> pd.DataFrame:
    """The elements of a list state as one frame."""
    arrays: list[list] = [[] for _ in columns]
    for element in state.get():
        for array, more in zip(arrays, element):
            array.extend(more)
    kinds = {"long": "int64", "int": "int32", "boolean": "bool", "string": "object"}
    return pd.DataFrame({c: pd.Series(a, dtype=kinds[t]) for (c, t), a in zip(columns.items(), arrays)})


def replayed(due: pd.DataFrame, force: pd.DataFrame, ttl_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Answers to the attempts among ``due``, and the last code of every (user,
    purpose), given the codes in ``force`` before."""
    x = pd.concat([force.assign(kind=-1), due.assign(used=False)], ignore_index=True)
    code = pd.factorize(x["code"], sort=True)[0]  # null: -1
    who = x.groupby(["nobody", "user_id", "purpose"], dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((code, x["id"], x["kind"], x["ts"], x["kind"] >= 0, who))
    x, code, who = x.iloc[order].reset_index(drop=True), code[order], who[order]
    ts, used, issue = x["ts"].to_numpy(), x["used"].to_numpy(dtype=bool), x["kind"].to_numpy() <= 0
    at = np.maximum.accumulate(np.where(issue, np.arange(len(x)), -1)) if len(x) else np.zeros(0, dtype=np.int64)
    has = at >= 0
    has[has] = who[at[has]] == who[has]
    at = np.where(has, at, 0)
    fresh = ~issue & has & (ts <= ts[at] + ttl_us)
    valid = fresh & (code >= 0) & (code == code[at])
    matched = np.zeros(len(x), dtype=bool)
    hits = np.flatnonzero(valid)
    first = hits[np.diff(at[hits], prepend=-1) != 0]  # hits of a code lie together
    matched[first] = ~used[at[first]]
    used[at[hits]] = True
    tried = ~issue
    out = pd.DataFrame({
        "attempt_id": x["id"][tried], "user_id": x["user_id"].astype("Int64").mask(x["nobody"])[tried],
        "purpose": x["purpose"][tried], "attempted_at": ts[tried].astype("datetime64[us]"),
        "token_id": x["id"].iloc[at].reset_index(drop=True).astype("Int64").where(fresh)[tried],
        "valid": valid[tried], "matched": matched[tried]})
    codes = np.flatnonzero(issue)
    last = codes[np.append(np.diff(who[codes]) != 0, True)] if len(codes) else codes
    return out, x.assign(used=used).iloc[last]


def replay_tokens(events: DataFrame, path: str, name: str = "token_matches") -> DataFrame:
    """Run the matcher over all that the stream of :func:`token_events` rows
    holds now, write the answers to ``path`` and return them. What the
    watermark has not passed stays in the state; a closing event of a later time
    (:func:`closing_event`) brings out the rest."""
    from cartograph.streaming.sources import checkpoint_location
    spark = events.sparkSession
    match_tokens_stream(events).writeStream.outputMode("append").format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint_location(spark, name)) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(MATCH_OUT).parquet(path)


def closing_event(events: DataFrame, path: str) -> DataFrame:
    """A stream of one attempt of nobody, a day after the last of ``events``
    (batch rows of :func:`token_events`), kept at ``path``."""
    spark = events.sparkSession
    late = events.agg((F.coalesce(F.max("ts"), F.lit("1970-01-01").cast("timestamp_ntz"))
                       + F.expr("INTERVAL 1 DAY")).alias("ts"))
    late.select(F.lit(-1).cast("bigint").alias("user_id"), F.lit("CLOSE").alias("purpose"), "ts",
                F.lit(1).alias("kind"), F.lit(-1).cast("bigint").alias("id"), F.lit(None).cast("string").alias("code")) \
        .write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
