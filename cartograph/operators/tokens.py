"""JON-6: one-time code matching as a bucketed as-of join.

A code is valid from its issue until ``issued_at + ttl`` (the end itself still
valid) or until the next code of the same user and purpose is issued (the
re-issue instant already belongs to the new code). So at any instant at most
one code per (user, purpose) is in force, and an attempt can only be matched
by the code in force at its time, and only if it was issued within ``ttl``.

Time is cut into slices of width ``ttl``. A code that can still validate an
attempt in slice ``b`` was issued in slice ``b`` (before the attempt) or is
the last code of slice ``b - 1``. Each (user, purpose, slice) is therefore
solved on its own: the last code of the previous slice (one grouped
``max_by``) is placed first, codes and attempts follow in time order, and the
code in force is carried forward with ``last(..., ignorenulls)``. A user with
a third of all events is spread over all their slices, and no attempt is
paired with more than one code. A code is consumed by its first valid
attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value from the reference: lifetime of a one-time code.
TOKEN_TTL_MINUTES = 15


def _slice(ts_col: str, width_us: int):
    return F.floor(F.unix_micros(F.col(ts_col).cast("timestamp_ltz")) / F.lit(width_us)).cast("long")


def code_in_force(issued: DataFrame, attempts: DataFrame,
                  ttl_minutes: int = TOKEN_TTL_MINUTES) -> DataFrame:
    """Each attempt with the code of its (user, purpose) in force at its time
    and issued within ``ttl`` (null columns when there is none)."""
    width = ttl_minutes * 60 * 1_000_000
    tok = F.struct(F.col("_ts").alias("issued_at"), F.col("_tid").alias("token_id"),
                   F.col("_code").alias("token_code"))
    codes = issued.select("user_id", "purpose", F.col("issued_at").alias("_ts"),
                          F.col("token_id").alias("_tid"), F.col("code").alias("_code")) \
        .withColumn("_b", _slice("_ts", width))
    last_of_slice = codes.groupBy("user_id", "purpose", "_b").agg(F.max(tok).alias("_t")) \
        .select("user_id", "purpose", (F.col("_b") + 1).alias("_b"), F.col("_t.issued_at").alias("_ts"),
                F.col("_t.token_id").alias("_tid"), F.col("_t.token_code").alias("_code"),
                F.lit(-1).alias("_kind"))
    start = F.timestamp_micros(F.col("_b") * F.lit(width)).cast("timestamp_ntz")
    carried = last_of_slice.select("user_id", "purpose", "_b", start.alias("_order_ts"), "_kind",
                                   "_ts", "_tid", "_code",
                                   F.lit(None).cast("bigint").alias("attempt_id"),
                                   F.lit(None).cast("string").alias("code"))
    own = codes.select("user_id", "purpose", "_b", F.col("_ts").alias("_order_ts"),
                       F.lit(0).alias("_kind"), "_ts", "_tid", "_code",
                       F.lit(None).cast("bigint").alias("attempt_id"),
                       F.lit(None).cast("string").alias("code"))
    tries = attempts.select("user_id", "purpose", _slice("attempted_at", width).alias("_b"),
                            F.col("attempted_at").alias("_order_ts"), F.lit(1).alias("_kind"),
                            F.lit(None).cast("timestamp_ntz").alias("_ts"),
                            F.lit(None).cast("bigint").alias("_tid"),
                            F.lit(None).cast("string").alias("_code"), "attempt_id", "code")
    w = Window.partitionBy("user_id", "purpose", "_b") \
        .orderBy("_order_ts", "_kind", "_tid", "attempt_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = carried.unionByName(own).unionByName(tries)
    carried_fwd = stacked.select(
        "*", F.last(F.when(F.col("_kind") <= 0, tok), ignorenulls=True).over(w).alias("_tok"))
    fresh = F.col("_order_ts") <= F.col("_tok.issued_at") + F.expr(f"INTERVAL {ttl_minutes} MINUTES")
    t = F.when(fresh, F.col("_tok"))
    return carried_fwd.where(F.col("_kind") == 1).select(
        "attempt_id", "user_id", "purpose", F.col("_order_ts").alias("attempted_at"), "code",
        t["token_id"].alias("token_id"), t["issued_at"].alias("issued_at"),
        t["token_code"].alias("token_code"))


def match_tokens(issued: DataFrame, attempts: DataFrame,
                 ttl_minutes: int = TOKEN_TTL_MINUTES) -> DataFrame:
    """Per attempt: the code in force (within its lifetime), whether the
    attempt is valid for it (same code), and ``matched`` for the first valid
    attempt of each code (the one that consumes it)."""
    x = code_in_force(issued, attempts, ttl_minutes)
    x = x.withColumn("valid", F.coalesce(F.col("token_id").isNotNull()
                                         & (F.col("code") == F.col("token_code")), F.lit(False)))
    first = x.where("valid").groupBy("token_id").agg(
        F.min(F.struct("attempted_at", "attempt_id")).alias("_first"))
    return x.join(first, "token_id", "left").select(
        "attempt_id", "user_id", "purpose", "attempted_at", "token_id", "valid",
        F.coalesce(F.col("valid") & (F.col("attempt_id") == F.col("_first.attempt_id")),
                   F.lit(False)).alias("matched"))
