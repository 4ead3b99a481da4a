"""Windowed rules on event streams (STR-3 rate audit, STR-5 trending).

Event time columns in the driver tables are ``timestamp_ntz``; watermarks
need ``timestamp``, so streams cast event time with the session zone (UTC)
first. One watermark per input stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions.text import trim
RATE_LIMIT = 10            # fixed value: auth requests per minute (declared in config)
RATE_WINDOW = "1 minute"


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Event time as ``timestamp_ltz`` (session zone UTC), as watermarks need
    (plain ``timestamp`` means NTZ under the session rules)."""
    return df.withColumn(col, F.col(col).cast("timestamp_ltz"))


def rate_violations_batch(requests: DataFrame, limit: int = RATE_LIMIT,
                          window: str = RATE_WINDOW) -> DataFrame:
    """STR-3 batch twin: users with more than ``limit`` requests in a
    tumbling ``window``."""
    w = F.window(F.col("ts").cast("timestamp_ltz"), window)
    return requests.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("requests")) \
        .where(F.col("requests") > limit) \
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests")


def rate_violations(requests: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW,
                    lateness: str = "2 minutes") -> DataFrame:
    """STR-3 stream: the same count per tumbling window, emitted once the
    watermark passes the window end (append mode bounds the state)."""
    x = event_time(requests).withWatermark("ts", lateness)
    return x.groupBy("user_id", F.window("ts", window).alias("w")) \
        .agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > limit) \
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests")


TREND_WINDOW = "1 hour"
TREND_SLIDE = "10 minutes"
TREND_K = 8


def trending_windows_batch(searches: DataFrame, window: str = TREND_WINDOW,
                           slide: str = TREND_SLIDE, k: int = TREND_K) -> DataFrame:
    """STR-5 batch twin: per sliding window, the ``k`` terms searched by the
    most distinct users (ties by term). Distinct (window, term, user) triples
    are formed first, so a hot term is counted with map-side partial counts;
    the per-window top-k uses a ranked window (Spark plans a partial
    ``WindowGroupLimit`` before the shuffle)."""
    terms = searches.select(F.lower(trim("query")).alias("term"), "user_id",
                            F.col("searched_at").cast("timestamp_ltz").alias("ts")) \
        .where(F.col("term") != "")
    per = terms.groupBy(F.window("ts", window, slide).alias("w"), "term") \
        .agg(F.countDistinct("user_id").alias("users"))
    return _top_k(per, k)


def _top_k(per: DataFrame, k: int) -> DataFrame:
    rw = Window.partitionBy("w").orderBy(F.col("users").desc(), F.col("term"))
    return per.withColumn("rank", F.row_number().over(rw)).where(F.col("rank") <= k) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "term",
                "users", F.col("rank").cast("bigint").alias("rank"))


def trending_pairs(searches: DataFrame, window: str = TREND_WINDOW, slide: str = TREND_SLIDE,
                   lateness: str = "10 minutes") -> DataFrame:
    """STR-5 stream, stateful part: distinct (window, term, user) triples,
    emitted when the watermark closes the window (append mode)."""
    x = searches.select(F.lower(trim("query")).alias("term"), "user_id",
                        F.col("searched_at").cast("timestamp_ltz").alias("ts")) \
        .where(F.col("term") != "").withWatermark("ts", lateness)
    return x.groupBy(F.window("ts", window, slide).alias("w"), "term", "user_id").count()


def trending_top_k(pairs: DataFrame, k: int = TREND_K) -> DataFrame:
    """STR-5 stream, per micro-batch (``foreachBatch``): a closed window's
    triples all arrive in the same batch, so counting users per (window,
    term) and ranking is complete for every window in the batch."""
    per = pairs.groupBy("w", "term").agg(F.count(F.lit(1)).alias("users"))
    return _top_k(per, k)


SKETCH_LG_K = 12  # 4,096 buckets: a standard error of 1.04 / 64, about 1.6 %


def trending_sketches(searches: DataFrame, window: str = TREND_WINDOW, slide: str = TREND_SLIDE,
                      lateness: str | None = None, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """STR-5 over panes: users per sliding window and term, estimated. One
    distinct-count sketch per pane of ``slide`` and term, merged into the windows
    that cover the pane, instead of a row per (window, term, user). ``slide``
    must divide ``window``. On a stream (give ``lateness``) the state holds one
    sketch per (pane, term) and per (window, term), whatever the number of users;
    both go once the watermark has passed them."""
    x = searches.select(F.lower(trim("query")).alias("term"), "user_id",
                        F.col("searched_at").cast("timestamp_ltz").alias("ts")).where(F.col("term") != "")
    if lateness:
        x = x.withWatermark("ts", lateness)
    panes = x.groupBy(F.window("ts", slide).alias("pane"), "term") \
        .agg(F.hll_sketch_agg("user_id", lg_k).alias("_users"))
    return panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), "term") \
        .agg(F.hll_sketch_estimate(F.hll_union_agg("_users")).alias("users"))


def trending_panes_batch(searches: DataFrame, window: str = TREND_WINDOW, slide: str = TREND_SLIDE,
                         k: int = TREND_K) -> DataFrame:
    """STR-5 batch twin over panes: the top ``k`` terms by estimated users."""
    return _top_k(trending_sketches(searches, window, slide), k)


def trending_top_estimates(counted: DataFrame, k: int = TREND_K) -> DataFrame:
    """STR-5 over panes, per micro-batch: a closed window's terms all arrive in
    the same batch."""
    return _top_k(counted, k)
