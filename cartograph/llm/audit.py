"""Interaction of filters: what each would remove in every order of them.

A filter's verdict on a document does not depend on the other filters, so a
document is a set of failed filters and a part of the corpus is a count for
every set. The states of the audit are the sets of filters already applied, a
lattice of ``2^k`` states; an edge applies one more filter and removes the
documents that fail it and passed all before it. Documents are counted at the
edges once, however many orders there are.

Forward-backward path counting: ``reach`` is the number of orders that arrive
at a state (the sum over the edges into it), ``leave`` the number that go on
from it to the last one (the sum over the edges out of it). An edge lies on
``reach * leave`` orders, so a filter's total over all orders, its Shapley sum,
is its edges' removals weighted by that. A single order's steps are read from
the same edges: step i of an order is the edge out of the state of its first
i - 1 filters.

Only the lattice (80 edges and 600 steps for five filters) is made on the
driver; it depends on the filters alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.llm.common import WORD, Scratch

LEAST_WORDS = 200
#: Percent.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SYMBOLS = r"[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions on a text (without nulls); true: it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n["n"] < LEAST_WORDS, "B": n["distinct"] * 100 < n["n"] * LEAST_DISTINCT,
            "C": capitals * 100 > F.length(text) * MOST_CAPITALS, "D": text.rlike(SYMBOLS)}


def lattice(spark: SparkSession, filters: str) -> tuple[DataFrame, DataFrame]:
    """``edges(state, filter, paths, failed, removes)``: every edge, the orders
    through it and every set of failed filters that reaches it, and whether the
    edge removes it; ``steps(filter_order, step, state, filter)``. States and
    sets have bit i for the i-th filter."""
    k = len(filters)
    states = range(1 << k)
    reach, leave = [1] * (1 << k), [1] * (1 << k)
    for s in states[1:]:
        reach[s] = sum(reach[s ^ 1 << f] for f in range(k) if s >> f & 1)
    for s in reversed(states[:-1]):
        leave[s] = sum(leave[s | 1 << f] for f in range(k) if not s >> f & 1)
    edges = [(s, f, reach[s] * leave[s | 1 << f], m, bool(m >> f & 1))
             for s in states for f in range(k) if not s >> f & 1 for m in states if not m & s]
    steps = [("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i])
             for order in permutations(range(k)) for i in range(k)]
    return (spark.createDataFrame(edges, "state int, filter int, paths long, failed int, removes boolean").coalesce(1),
            spark.createDataFrame(steps, "filter_order string, step int, state int, filter int").coalesce(1))


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """Every step of every order of ``filters`` (one character each), per part.

    ``cells(part, failed, n, <counts>)``: documents of a part, by the set of
    filters they fail (bit i: the i-th), and any further counts of them.
    Returns ``(part, filter_order, step, kept, removed, redundant,
    unique_fails, <counts>_lost, shapley)``. Parts need no row for each set; an
    empty table gives no rows.
    """
    spark = cells.sparkSession
    edges, steps = lattice(spark, filters)
    counts = [c for c in cells.columns if c not in ("part", "failed", "n")]
    # a part whose documents all fail something still has every edge
    none = cells.select("part").distinct().select("part", F.lit(0).alias("failed"), F.lit(0).cast("long").alias("n"),
                                                  *[F.lit(0).cast("long").alias(c) for c in counts])
    reached = cells.unionByName(none).join(F.broadcast(edges), "failed")  # fixed size, see lattice()
    gone = lambda c: F.sum(F.when(F.col("removes"), F.col(c)).otherwise(0))
    at = reached.groupBy("part", "state", "filter", "paths").agg(
        F.sum(F.when(F.col("removes"), 0).otherwise(F.col("n"))).alias("kept"), gone("n").alias("removed"),
        *[gone(c).alias(f"{c}_lost") for c in counts])
    # at most 2^(k-1) edges of a part apply one filter
    own = Window.partitionBy("part", "filter")
    first, last = F.col("state") == 0, F.col("state") == F.lit((1 << len(filters)) - 1).bitwiseXOR(F.expr("shiftleft(1, filter)"))
    at = at.withColumns({"redundant": F.sum(F.when(first, F.col("removed"))).over(own) - F.col("removed"),
                         "unique_fails": F.sum(F.when(last, F.col("removed"))).over(own),
                         "shapley": F.sum(F.col("paths") * F.col("removed")).over(own)})
    return at.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in counts], "shapley")


def document_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """``(part, failed, n, good, toxic)`` of documents under the filters A to E
    (:func:`failures`; E: the text is that of a document of smaller id).

    The part is the source, ``""`` for null; a null text counts as empty. A row
    without id never repeats another, and none repeats it; rows of equal id do
    not repeat each other. Labels of an id that is labelled twice count if any
    of them is 1. An empty table gives no rows. Other columns are not read.

    Texts are compared by their SHA-256. Rows are counted per id and text
    before they are dealt by id and then by text, so an id or a text that a
    third of all rows share is combined first; which row of a text is the first
    is a least id per text, and the first rows are met on text and id.
    """
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = None
    for i, fails in enumerate(failures(F.col("text")).values()):
        bit = F.when(fails, F.lit(1 << i)).otherwise(0)
        bits = bit if bits is None else bits + bit
    # stored, so that texts are read and measured once
    rows = scratch.save(x.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), bits.alias("failed"))
                        .groupBy("id", "key", "part", "failed").agg(F.count(F.lit(1)).alias("n")), "rows")
    marks = labels.groupBy(F.col(id_col).alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, F.col("id") == F.col("label_id"), "left")
    cells = ("part", "failed")
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    every = marked.groupBy(*cells).agg(*sums)
    least = rows.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("least"))
    first = marked.join(least, (F.col("key") == F.col("k")) & (F.col("id") == F.col("least"))).groupBy(*cells).agg(*sums)
    first = first.unionByName(marked.where("id IS NULL").groupBy(*cells).agg(*sums))
    # rows that are not the first of their text fail E as well
    signed = lambda df, sign, bit: df.select("part", (F.col("failed") + bit).alias("failed"),
                                             *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
    repeat = 1 << 4
    return signed(first, 1, 0).unionByName(signed(every, 1, repeat)).unionByName(signed(first, -1, repeat)) \
        .groupBy(*cells).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source") -> DataFrame:
    """:func:`audit` of :func:`document_cells` under the filters ``ABCDE``."""
    scratch = Scratch(docs.sparkSession, "audit")
    cells = scratch.save(document_cells(docs, labels, id_col, text_col, source_col, scratch), "cells")
    return audit(cells, "ABCDE")


def oracle(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the rows of :func:`filter_audit`: every order is walked."""
    words = f"regexp_extract_all(t, '{WORD}')"
    return f"""
WITH RECURSIVE x AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM {docs}),
m AS (SELECT doc_id AS id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM {labels} GROUP BY 1),
f AS (SELECT t, min(doc_id) AS least FROM x GROUP BY 1),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (CASE WHEN len({words}) < {LEAST_WORDS} THEN 'A' ELSE '' END)
          || (CASE WHEN 100 * len(list_distinct({words})) < {LEAST_DISTINCT} * len({words}) THEN 'B' ELSE '' END)
          || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END)
          || (CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END)
          || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
      FROM x JOIN f USING (t) LEFT JOIN m ON m.id = doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || l FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l)
                    WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS fl, substr(filter_order, 1, step - 1) AS done
      FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
w AS (SELECT part, filter_order, CAST(step AS INT) AS step, fl,
             sum(CASE WHEN before OR now THEN 0 ELSE n END) AS kept, sum(CASE WHEN now AND NOT before THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN now AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = fl THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN now AND NOT before THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
      FROM (SELECT c.*, s.*, contains(fails, fl) AS now, length(translate(fails, done, '')) < length(fails) AS before FROM c, s)
      GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, fl) AS BIGINT) AS shapley
FROM w"""
