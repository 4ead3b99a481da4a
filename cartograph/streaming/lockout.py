"""STR-1: login lockout, as a per-user sequential fold.

Rule (fixed values: 5 failures, 15 minutes): attempts while locked
(``locked_until`` after the attempt time), suspended or unverified are refused
before anything is counted; a success clears the counter and the lock; a
failure adds one to the counter and, at 5 or more, locks until
``attempt + 15 minutes``. An expired lock does not reset the counter, so the
next failure locks again at once.

The fold is order-dependent and not a window sum. Both forms run it over rows
sorted by (user, time, event id):

* batch twin :func:`lockouts_batch`: the attempts are cut into chunks by
  (user, time); each chunk is summed up as a map from the states it can be
  entered with to the states it leaves, the summaries are followed in order,
  and every chunk is folded from its real entry (:mod:`.lockout_chunks`). No
  task reads a whole history;
* stream :func:`lockouts`: keyed state per user, the counter and the end of
  the lock; rows wait for the watermark and are folded in time order
  (:mod:`.replay`).

A row with ``reset`` (a password reset) clears the counter and the lock.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.streaming.lockout_chunks import CHUNK, fold_in_chunks
from cartograph.streaming.replay import LATENESS, replay, times

# Fixed values from the reference: failures before a lock, lock length.
MAX_FAILURES = 5
LOCK_MINUTES = 15

ATTEMPT_OUT = ("event_id long, user_id long, ts timestamp_ntz, outcome string, "
               "failed_attempts int, locked_until timestamp_ntz")
def _attach_account(attempts: DataFrame, users: DataFrame) -> DataFrame:
    acct = users.select(F.col("id").alias("user_id"), "email_verified", "is_suspended")
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in attempts.columns else F.lit(False)
    return attempts.select("event_id", "user_id", "ts", F.coalesce("success", F.lit(False)).alias("success"),
                           reset.alias("reset")).join(acct, "user_id", "left") \
        .withColumn("email_verified", F.coalesce("email_verified", F.lit(False))) \
        .withColumn("is_suspended", F.coalesce("is_suspended", F.lit(False)))


def lockouts_batch(attempts: DataFrame, users: DataFrame, max_failures: int = MAX_FAILURES,
                   lock_minutes: int = LOCK_MINUTES, chunk: int = CHUNK) -> DataFrame:
    """Batch twin: one output row per attempt with its outcome and the state
    after it. ``attempts``: event_id, user_id, ts (neither null), success, and
    ``reset`` if it has password resets. Attempts on suspended or unverified
    accounts are never counted; all others are folded in chunks of about
    ``chunk`` rows (:mod:`.lockout_chunks`)."""
    x = _attach_account(attempts, users)
    counted = F.col("email_verified") & ~F.col("is_suspended")
    idle = x.where(~counted).select(
        "event_id", "user_id", "ts",
        F.when(F.col("reset"), F.lit("RESET")).when(F.col("is_suspended"), F.lit("SUSPENDED"))
        .otherwise(F.lit("UNVERIFIED")).alias("outcome"),
        F.lit(0).alias("failed_attempts"), F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    return fold_in_chunks(x.where(counted), max_failures, lock_minutes, chunk).unionByName(idle)


def lockouts(attempts: DataFrame, users: DataFrame, max_failures: int = MAX_FAILURES,
             lock_minutes: int = LOCK_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """Streaming form, output mode append. ``attempts`` is a streaming frame
    (event_id, user_id, ts, success, and ``reset`` if it has password resets);
    ``users`` a static frame. An attempt is decided once the watermark has
    passed it, in (time, event id) order; a user without counted failures has
    no state (:mod:`.replay`)."""
    lock_us = lock_minutes * 60 * 1_000_000

    def fold(key, state, rows, now):
        failed, until = state or (0, None)
        out = []
        for ts, event_id, success, reset, verified, suspended in rows:
            if reset:
                failed, until, outcome = 0, None, "RESET"
            elif until is not None and until > ts:
                outcome = "LOCKED"
            elif suspended or not verified:
                outcome = "SUSPENDED" if suspended else "UNVERIFIED"
            elif success:
                failed, until, outcome = 0, None, "OK"
            else:
                failed += 1
                locks = failed >= max_failures
                outcome = "LOCKED_NOW" if locks else "FAILED"
                until = ts + lock_us if locks else until
            out.append((event_id, key[0], ts, outcome, failed, until))
        cols = list(zip(*out)) or [[]] * 6
        frame = pd.DataFrame({"event_id": pd.Series(cols[0], dtype="int64"), "user_id": pd.Series(cols[1], dtype="int64"),
                              "ts": times(cols[2]), "outcome": pd.Series(cols[3], dtype="object"),
                              "failed_attempts": pd.Series(cols[4], dtype="int32"), "locked_until": times(cols[5])})
        return ((failed, until) if failed else None), None, frame

    x = _attach_account(attempts, users)
    return replay(x, ["user_id"], ["event_id", "success", "reset", "email_verified", "is_suspended"],
                  ATTEMPT_OUT, fold, lateness)
