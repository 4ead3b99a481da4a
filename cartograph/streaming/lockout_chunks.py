"""STR-1 in bulk: the lockout fold over chunks of the attempts, joined by
summaries of what each chunk does to any state it is entered with.

Attempts are range-partitioned by (user, time, event) and stored; a chunk is
one partition, a bounded run of rows whatever the users. Only a chunk's first
user can come with a history from the chunk before, so:

1. :func:`summary`, per chunk: maps every state the first user can enter with
   to the state it is left with, and folds the last user's rows from a fresh
   state. Entry states are the counts below the limit without a lock, and a
   lock that ends before some attempt of the chunk's first lock length; one
   pass from the last row to the first gives all of them.
2. :func:`entries`: streams the summaries of each user (one row per chunk that
   the user begins or ends) in order and looks up one state per row, which
   gives every chunk its real entry. Batches are bounded; nothing of a user
   is held but the current state.
3. :func:`outcomes`, per chunk: the fold of its rows from that entry.

Steps 1 and 3 run on all chunks at once, also on those of a user with a third
of all attempts. There is one path for all sizes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.operators.common import stash

#: Rows of a chunk, about.
CHUNK = 500_000
#: "No lock" in columns of microseconds.
NONE = -(2 ** 63)

SUMMARY = ("pid int, user_id long, size long, count_failed array<bigint>, count_until array<bigint>, times array<bigint>, "
           "lock_absolute array<boolean>, lock_failed array<bigint>, lock_until array<bigint>, reset_at long, "
           "reset_failed long, reset_until long")


def exits(t: np.ndarray, success: np.ndarray, reset: np.ndarray, most: int, lock: int):
    """What a run of one user's attempts makes of the states it is entered with.

    Returns ``(counts, locks, cleared)``: by count at the start, by the first
    attempt after a lock, and by first attempt after a cleared state. A state is
    ``(absolute, failed, until)``; where not absolute, ``failed`` is added to the
    count entered with."""
    k = len(t)
    decided = np.searchsorted(t, t + lock).tolist()  # first attempt after a lock set at each
    later = np.where(reset, np.arange(k), k)
    later = np.append(np.minimum.accumulate(later[::-1])[::-1], k)[1:].tolist()  # next reset after each
    until, clears, resets = (t + lock).tolist(), (success | reset).tolist(), reset.tolist()
    open_ = [(True, c, NONE) for c in range(most)]  # by count, before attempt i
    cleared, locks = [None] * k + [open_[0]], [None] * k

    def locked(i: int, absolute: bool, failed: int):
        if later[i] < min(decided[i], k):
            return cleared[later[i] + 1]
        if decided[i] == k:
            return absolute, failed, until[i]
        after = locks[decided[i]]
        return after if after[0] else (absolute, failed + after[1], after[2])

    for i in range(k - 1, -1, -1):
        if clears[i]:
            locks[i] = open_[0]
            open_ = [open_[0]] * most
        else:
            locks[i] = locked(i, False, 1)
            open_ = open_[1:] + [locked(i, True, most)]
        cleared[i] = open_[0]
    return open_, locks, cleared


def in_order(pdf: pd.DataFrame):
    """Columns of a chunk, sorted, as arrays."""
    pdf = pdf.sort_values(["user_id", "us", "event_id"], kind="stable")
    return [pdf[c].to_numpy() for c in ("user_id", "us", "event_id", "success", "reset")]


def summary(most: int, lock: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        user, t, _, success, reset = in_order(pdf)
        rows = []
        # the first user, by any entry; the last by a fresh one
        first, last = np.searchsorted(user, user[0], "right"), np.searchsorted(user, user[-1])
        for own, any_entry in [(slice(0, first), True)] + ([(slice(last, len(user)), False)] if last else []):
            at, resets = t[own], reset[own]
            counts, locks, cleared = exits(at, success[own], resets, most, lock)
            near = int(np.searchsorted(at, at[0] + lock)) + 1 if any_entry else 0
            at_reset = np.flatnonzero(resets[:near])
            after = cleared[at_reset[0] + 1] if len(at_reset) else (True, 0, NONE)
            counts, locks = counts if any_entry else counts[:1], locks[:near]
            rows.append((int(key[0]), int(user[own][0]), len(at), [c[1] for c in counts], [c[2] for c in counts], at[:near].tolist(),
                         [x[0] for x in locks], [x[1] for x in locks], [x[2] for x in locks],
                         int(at_reset[0]) if len(at_reset) else -1, after[1], after[2]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])
    return run


def entries(batches):
    """mapInPandas on summaries, in order of user and chunk: the state that each chunk is entered with."""
    user, failed, until = None, 0, NONE
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.user_id != user:
                user, failed, until = r.user_id, 0, NONE
            out.append((r.pid, user, failed, until))
            if until == NONE:
                failed, until = r.count_failed[failed], r.count_until[failed]
                continue
            i = bisect_left(r.times, until)
            if 0 <= r.reset_at < i:
                failed, until = r.reset_failed, r.reset_until
            elif i < r.size:
                failed, until = r.lock_failed[i] + (0 if r.lock_absolute[i] else failed), r.lock_until[i]
        yield pd.DataFrame(out, columns=["pid", "user_id", "failed", "until"])


def outcomes(most: int, lock: int):
    def run(key: tuple, rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"event_id": [], "user_id": [], "us": [], "outcome": [], "failed": [], "until": []})
        user, t, event, success, reset = in_order(rows)
        known = {u: (int(f), int(x)) for u, f, x in zip(entered["user_id"], entered["failed"], entered["until"])}
        got, before = [], None
        for u, at, ok, clear in zip(user.tolist(), t.tolist(), success.tolist(), reset.tolist()):
            if u != before:
                before, (failed, until) = u, known.get(u, (0, NONE))
            if clear:
                failed, until, outcome = 0, NONE, "RESET"
            elif until > at:
                outcome = "LOCKED"
            elif ok:
                failed, until, outcome = 0, NONE, "OK"
            else:
                failed += 1
                outcome = "LOCKED_NOW" if failed >= most else "FAILED"
                until = at + lock if failed >= most else until
            got.append((outcome, failed, until))
        outcome, failed, until = zip(*got)
        return pd.DataFrame({"event_id": event, "user_id": user, "us": t, "outcome": outcome, "failed": failed, "until": until})
    return run


def fold_in_chunks(x: DataFrame, max_failures: int, lock_minutes: int, chunk: int = CHUNK) -> DataFrame:
    """Outcomes for the attempts of ``x`` (user_id, event_id, ts, success,
    reset), none of them refused for the account's sake: ``(event_id, user_id,
    ts, outcome, failed_attempts, locked_until)``."""
    lock = lock_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    rows = x.select("user_id", micros.alias("us"), "event_id", "success", "reset")
    wide = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled, so the chunk of a row is fixed once, stored
    rows = stash(rows.repartitionByRange(max(wide, -(-x.count() // chunk)), "user_id", "us", "event_id")
                 .withColumn("pid", F.spark_partition_id()), "lock_chunks")
    parts = rows.groupBy("pid").applyInPandas(summary(max_failures, lock), SUMMARY)
    entered = parts.repartition("user_id").sortWithinPartitions("user_id", "pid") \
        .mapInPandas(entries, "pid int, user_id long, failed long, until long")
    entered = entered.select(*[F.col(c).alias(c) for c in entered.columns])
    found = rows.groupBy("pid").cogroup(entered.groupBy("pid")).applyInPandas(
        outcomes(max_failures, lock), "event_id long, user_id long, us long, outcome string, failed long, until long")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("event_id", "user_id", time(F.col("us")).alias("ts"), "outcome", F.col("failed").cast("int").alias("failed_attempts"),
                        time(F.when(F.col("until") != NONE, F.col("until"))).alias("locked_until"))
