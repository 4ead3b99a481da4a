"""STR-4: order status feed, and the stream runners with idempotent sinks.

``foreachBatch`` applies each micro-batch of status updates to two tables:
the history (every valid update, appended) and the current status per order
(the highest ``seq`` wins; a late update with an older ``seq`` reaches the
history but never the current table). The history overwrites only its batch's
partition. The current table is a base and deltas
(:mod:`cartograph.operators.deltas`): a batch appends the latest row of the
orders it touches, so its cost does not grow with the table, and
:func:`compact_current` folds the deltas now and then. A micro-batch replayed
after a failure rewrites the same files instead of counting twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartograph.functions.money import ORDER_STATUSES
from cartograph.operators.changes import parse_enum
from cartograph.operators.deltas import DeltaTable
from cartograph.streaming.sources import checkpoint_location
from cartograph.streaming.windows import trending_pairs, trending_sketches, trending_top_estimates, trending_top_k

def status_history(updates: DataFrame) -> DataFrame:
    """Valid updates (status upper-cased and in the domain) as history rows."""
    ok, _ = parse_enum(updates, "status", ORDER_STATUSES)
    return ok.select("order_id", "status", "seq", "changed_at", "changed_by")


def merge_current(current: DataFrame, history_rows: DataFrame) -> DataFrame:
    """Current status per order: the row with the highest ``seq`` among the
    stored one and the new ones."""
    cols = ["order_id", "status", "seq", "changed_at"]
    return latest(current.select(*cols).unionByName(history_rows.select(*cols)))


def latest(rows: DataFrame) -> DataFrame:
    """Per order the row with the highest ``seq``."""
    return rows.groupBy("order_id").agg(
        F.max_by(F.struct("status", "seq", "changed_at"), F.struct("seq", "changed_at", "status")).alias("_r")) \
        .select("order_id", "_r.status", "_r.seq", "_r.changed_at")


def current_table(spark: SparkSession, path: str) -> DeltaTable:
    """The current status per order at ``path``; :meth:`~DeltaTable.current` reads it."""
    return DeltaTable(spark, path, "order_id long, status string, seq long, changed_at timestamp_ntz", latest)


def compact_current(spark: SparkSession, path: str) -> None:
    """Fold the deltas of the current table into its base; run it between batches."""
    current_table(spark, path).compact()


def _write_batch(spark: SparkSession, batch: DataFrame, batch_id: int, history_path: str, current_path: str) -> None:
    rows = status_history(batch).withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("batch_id").parquet(history_path)
    current_table(spark, current_path).append(batch_id, rows)


def order_status_feed(updates: DataFrame, history_path: str, current_path: str,
                      name: str = "order_status_feed", trigger_once: bool = False) -> StreamingQuery:
    """Start the feed over a streaming frame of updates
    (request_id, order_id, status, seq, changed_at, changed_by)."""
    spark = updates.sparkSession
    w = updates.writeStream.foreachBatch(
        lambda df, bid: _write_batch(spark, df, bid, history_path, current_path)) \
        .option("checkpointLocation", checkpoint_location(spark, name)).queryName(name)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def trending_stream(searches: DataFrame, out_path: str, k: int = 8, name: str = "trending",
                    trigger_once: bool = False, sketches: bool = False) -> StreamingQuery:
    """STR-5: sliding-window trending terms written per micro-batch
    (partitioned by batch id, idempotent on replay). Users are counted exactly,
    or with ``sketches`` estimated from one sketch per pane and term."""
    spark = searches.sparkSession
    pairs = trending_sketches(searches, lateness="10 minutes") if sketches else trending_pairs(searches)
    top = trending_top_estimates if sketches else trending_top_k

    def sink(df, bid):
        top(df, k).withColumn("batch_id", F.lit(bid)) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(out_path)

    w = pairs.writeStream.outputMode("append").foreachBatch(sink) \
        .option("checkpointLocation", checkpoint_location(spark, name)).queryName(name)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
