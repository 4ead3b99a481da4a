"""Helpers shared by the corpus operators: stored intermediate tables, input
sizing, distributed running sums and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.session import checkpoint_dir, temporary

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


class Scratch:
    """Intermediate tables of one run, stored as Parquet in the folder that
    ``spark.checkpoint.dir`` names. Storing cuts the lineage: after the loss
    of an executor the rows are read again instead of computed again. The
    tables go with :meth:`close`, or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = temporary(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete all tables of the run."""
        self.drop("")

    def drop(self, name: str) -> None:
        """Delete a stored table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def parts_for(df: DataFrame, size: Column, target: int = 64 << 20) -> int:
    """Number of partitions for rows of ``size`` bytes each, so that one holds
    about ``target`` bytes; never under the session's shuffle partitions."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // target))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` of long ids.

    Returns ``(node, label)`` with the smallest id of the component, for every
    node that is not itself that smallest id. Alternating large-star and
    small-star rounds: each is a min per node and a join, its output is never
    longer than twice its input, and each round is stored. A component that
    holds a third of all nodes becomes a star, whose join AQE may split.
    Rounds end when the edges no longer change; they grow with the logarithm
    of the longest chain.
    """
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")))
    cur = scratch.save(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                       .where("hi != lo").distinct(), "edges-0")
    seen, i = cur.agg(mark).first()[0], 0
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .unionByName(least.select("hi", F.col("m").alias("lo")))
        nxt = scratch.save(small.distinct(), f"edges-{i + 1}")
        now = nxt.agg(mark).first()[0]
        scratch.drop(f"edges-{i}")
        cur, i = nxt, i + 1
        if now == seen:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        seen = now


#: Ranges whose totals one window of :func:`running_sum` adds up.
BLOCK = 1000


def running_sum(df: DataFrame, value: str, out: str, keys: list[str], slot: str, order: list) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` (columns without nulls),
    in the order of ``slot`` and then ``order``, without one task per key:
    ``slot`` is a whole number that cuts a key's order into consecutive ranges.
    The window runs inside a (keys, slot) and adds the totals of the slots
    before it, which are themselves summed in blocks of ``BLOCK`` slots."""
    zero = F.lit(0).cast("long")
    slots = df.groupBy(*keys, slot).agg(F.sum(value).alias("_sum")) \
        .withColumn("_block", F.floor(F.col(slot) / BLOCK).cast("long"))

    def before(frame, by, at):
        w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("_before", F.coalesce(F.sum("_sum").over(w), zero))

    blocks = before(slots.groupBy(*keys, "_block").agg(F.sum("_sum").alias("_sum")), keys or [F.lit(0)], "_block") \
        .select(*keys, "_block", F.col("_before").alias("_blocks"))
    offsets = before(slots, [*keys, "_block"], slot).join(blocks, [*keys, "_block"]) \
        .select(*keys, slot, (F.col("_blocks") + F.col("_before")).alias("_before"))
    inside = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, [*keys, slot]).withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")
