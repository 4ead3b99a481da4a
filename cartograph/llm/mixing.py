"""Mixing sources to target weights by weighted fair queueing.

Every source has a target number of words. Its documents, shuffled by a hash
of their id, form a queue; a source whose target is above its size queues its
documents again, up to ``REPEATS`` times. A queued copy's virtual finish time
is the cumulative words of its source up to and including it, divided by the
source's target. All copies are sorted by finish time and taken while the sum
of the words taken stays within the budget.

Both running sums are exact and distributed: a source's shuffled queue is cut
into ranges of the hash, the common queue into ranges of the finish time, and
only the totals of the ranges are added up over all of them
(:func:`cartograph.llm.common.running_sum`). Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.common import WORD, Scratch, fresh, running_sum, word_count

REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Documents in one range of a running sum, on average.
RANGE_DOCS = 500


def targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_no, source_size, target)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``repeats`` times its source's
    size and the excess is shared again by weight among the others: with the
    sources in order of cap by weight, the first one that needs no cap sets
    the share for itself and all after it. The table has one row per source.
    """
    whole = Window.partitionBy(F.lit(0))
    by_source = whole.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("source_no", F.row_number().over(by_source)) \
        .withColumn("weight", weight.cast("long")) \
        .withColumn("cap", F.col("source_size") * F.lit(repeats).cast("long"))
    x = x.withColumn("place", F.row_number().over(whole.orderBy(F.col("cap").cast("double") / F.col("weight"), "source_no")))
    by_place = whole.orderBy("place")
    x = x.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(
            F.sum("cap").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("weights", F.sum("weight").over(by_place.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    wide, narrow = "decimal(38,0)", "decimal(19,0)"
    is_open = F.col("cap").cast(wide) * F.col("weights").cast(narrow) >= F.col("weight").cast(wide) * F.col("rest").cast(narrow)
    x = x.withColumn("first", F.min(F.when(is_open, F.struct("place", "rest", "weights"))).over(whole))
    share = F.col("weight").cast("double") * F.col("first.rest").cast("double") / F.col("first.weights").cast("double")
    return x.select("source", "source_no", "source_size",
                    F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(share)
                    .alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        repeats: int = REPEATS, weights: tuple = WEIGHTS, row_col: str | None = None,
        scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``(<id>, size, source_size, target, taken)`` and
    ``row_col`` if given.

    ``taken`` counts the words the mix takes from the document, repeats
    included: 0 to ``repeats`` times its size. A null text has size 0; a
    document of size 0 is never queued, and a source without words has target
    0. Rows with a null id or source and repeated rows are documents like any
    other; ties in the shuffle are broken by size, so rows that differ in none
    of id, size and source are interchangeable. An empty table gives no rows.
    """
    extra = [F.col(row_col).alias("row")] if row_col else []
    x = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                    F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")).alias("shuffle"),
                    *extra)
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    x = scratch.save(x, "sizes")  # the texts are read once
    per_source = x.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n, budget = per_source.agg(F.sum("n"), F.sum("source_size")).first()
    ranges = -(-(n or 0) // RANGE_DOCS) or 1
    share = targets(per_source.select("source", "source_size"), repeats, weights)
    x = x.withColumnRenamed("source", "own")
    x = x.join(share, x.own.eqNullSafe(share.source)).drop("own", "source")
    head = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    queued = x.withColumn("slot", F.floor(head * F.lit(ranges).cast("long") / F.lit(float(1 << 32))).cast("long"))
    queued = running_sum(queued, "size", "done", ["source_no"], "slot",
                         ["shuffle", F.col("id").asc_nulls_last(), "size"])
    queued = scratch.save(queued, "queued")
    copies = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))) \
        .withColumn("finish", (F.col("epoch").cast("long") * F.col("source_size") + F.col("done")).cast("double")
                    / F.col("target")) \
        .withColumn("turn", F.floor(F.col("finish") * F.lit(float(ranges))).cast("long"))
    copies = running_sum(copies, "size", "total", [], "turn", ["finish", "source_no", "shuffle", F.col("id").asc_nulls_last()])
    out = ["row"] if row_col else ["id", "source_no", "shuffle", "done"]
    took = copies.where(F.col("total") <= F.lit(budget or 0)).groupBy(*out).agg(F.sum("size").alias("taken"))
    joined = queued.alias("q").join(took.alias("t"), [F.col(f"q.{c}").eqNullSafe(F.col(f"t.{c}")) for c in out], "left")
    return joined.select(F.col("q.id").alias(id_col), *([F.col("q.row").alias(row_col)] if row_col else []),
                         "q.size", "q.source_size", "q.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, scratch: Scratch | None = None, **names) -> DataFrame:
    """``docs`` with each document as often as the mix takes it (0 to
    ``repeats`` times), in the columns of ``docs``. Arguments as :func:`mix`."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    row, times = fresh(docs, "row"), fresh(docs, "times")
    # stored, so that a row number is the same wherever it is read
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    took = mix(rows, row_col=row, scratch=scratch, **names).where("taken > 0") \
        .select(row, F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).alias(times))
    return rows.join(took, row).select(*docs.columns)


def oracle(repeats: int = REPEATS, weights: tuple = WEIGHTS, docs: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`mix` over table ``docs``."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS shuffle FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(source_size * {repeats} AS BIGINT) AS cap,
             CAST(CASE (source_no - 1) % {len(weights)} {cases} END AS BIGINT) AS weight
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s)),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source_no) AS place FROM w),
r AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN
               UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM p),
f AS (SELECT place AS at, CAST(rest AS DOUBLE) AS rest, CAST(weights AS DOUBLE) AS weights FROM r
      WHERE CAST(cap AS HUGEINT) * weights >= CAST(weight AS HUGEINT) * rest ORDER BY place LIMIT 1),
t AS (SELECT source, source_no, source_size,
             CASE WHEN place < f.at THEN CAST(cap AS DOUBLE)
                  ELSE CAST(weight AS DOUBLE) * f.rest / f.weights END AS target FROM r, f),
q AS (SELECT doc_id, size, source_no, source_size, target, shuffle, sum(size) OVER (PARTITION BY source_no
               ORDER BY shuffle, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, CAST(epoch * source_size + done AS DOUBLE) / target AS finish
      FROM q, (SELECT unnest(range({repeats})) AS epoch) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, source_no, shuffle, doc_id NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
n AS (SELECT doc_id, source_no, shuffle, done, sum(size) AS taken FROM k
      WHERE total <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source_no = n.source_no
  AND q.shuffle = n.shuffle AND q.done = n.done"""
