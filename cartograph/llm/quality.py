"""Quality rules with adaptive thresholds.

Counts are taken from whole texts with array functions. Each text then has a
few rates (symbols a word, capitals a character, ...), and a text is rejected
when a rate lies far above what is usual for its language and source.

What is usual comes from mergeable quantile sketches: a rate is a whole number,
its bucket keeps the eight leading bits, and a sketch is the number of texts in
every bucket. Sketches merge by adding counts, so they are a grouped count that
Spark combines before the shuffle, they do not depend on the order of rows, and
the sketch of a language is the sum of those of its sources. A quantile is exact
up to the bucket (below 256: exact, above: within 1/128).

The threshold of a rate is ``median + SPREADS * max(median - 10th percentile,
least)``; half of a source's texts may be junk before it moves. A group of n
texts uses the mean of its own threshold, with weight n, and that of the
sketch merged over its language, with weight ``PRIOR``; a language's is
blended likewise with that of all texts. So a small group follows its language
and a large one itself, with no size at which verdicts jump.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.common import WORD, WORD_CHAR, Scratch, fresh

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
#: Percent of words in repeated windows above which a text fails.
MOST_REPEATED = 30
SPREADS = 6
#: Texts that a wider group's threshold counts for in a narrower one's.
PRIOR = 50
#: rate -> least spread: symbols, capitals, repeated lines and words equal to
#: the one before a thousand, and word characters a hundred words.
RATES = {"symbols": 30, "capitals": 20, "dup_lines": 60, "stutter": 30, "word_length": 20}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word run found twice or more in the
    text. Runs are compared by a 64-bit hash of the words' hashes; only texts
    with equal ones sort them."""
    def covered(w: Column) -> Column:
        def repeats(s: Column) -> Column:
            return F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))

        def total(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("long"))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(F.sort_array(F.transform(let(ordered, repeats), lambda e: e["i"])), total)

    def runs(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    none = F.lit(0).cast("long")
    of_runs = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, none).otherwise(let(hashes, lambda h: let(runs(h), of_runs)))


def measures(text: Column) -> Column:
    """Struct of a text's counts (long); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))

    def counts(words: Column) -> Column:
        stutter = F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w))
        return F.struct(*[c.cast("long").alias(n) for n, c in {
            "n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", "")),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeated_words(words), "n_lines": F.size(lines), "n_stutter": stutter,
            "n_capitals": F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", "")),
        }.items()])
    return let(F.regexp_extract_all(text, F.lit(WORD), 0), counts)


def rates(m: str) -> dict[str, Column]:
    """Rates as whole numbers, of the struct column ``m``."""
    per = lambda k, a, b: F.floor(F.lit(k) * F.col(f"{m}.{a}") / F.greatest(F.col(f"{m}.{b}"), F.lit(1))).cast("long")
    return {"symbols": per(1000, "n_symbols", "n_words"), "capitals": per(1000, "n_capitals", "word_chars"),
            "dup_lines": per(1000, "n_dup_lines", "n_lines"), "stutter": per(1000, "n_stutter", "n_words"),
            "word_length": per(100, "word_chars", "n_words")}


def sketches(rows: DataFrame, m: str) -> DataFrame:
    """``(lang, source, rate, bucket, n)`` of rows with ``lang, source`` and counts ``m``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in rates(m).items()]))
    x = rows.select("lang", "source", each.alias("e")).select("lang", "source", "e.rate", "e.value")
    low = "greatest(length(bin(value)) - 8, 0)"  # bits that the bucket leaves out
    return x.withColumn("bucket", F.expr(f"shiftleft(shiftright(value, {low}), {low})")) \
        .groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(level, lang, source, n, <rate>...)``: texts and threshold of every
    rate, for each language and source (level 0), language (1) and over all (2;
    null where a level has no such column). The sketches of the three levels
    are merged in one pass."""
    keys = ["level", "lang", "source"]
    x = F.col("rate"), F.col("bucket")
    merged = sketch.groupingSets([["lang", "source", *x], ["lang", *x], list(x)], "lang", "source", *x).agg(
        F.shiftright(F.grouping_id(), 2).alias("bits"), F.sum("n").alias("n"))
    # grouping bits of (lang, source): 0, 1 or 3
    merged = merged.withColumn("level", F.least(F.col("bits"), F.lit(2))).drop("bits")
    w = Window.partitionBy(*keys, "rate")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))
    q = counted.groupBy(*keys, "rate").agg(F.max("all").alias("all"),
                                           F.min(F.when(F.col("upto") * 10 >= F.col("all"), F.col("bucket"))).alias("low"),
                                           F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bucket"))).alias("mid"))
    cols = [F.max(F.when(F.col("rate") == k, F.col("mid") + SPREADS * F.greatest(F.col("mid") - F.col("low"), F.lit(v))))
            .alias(k) for k, v in RATES.items()]
    return q.groupBy(*keys).agg(F.max("all").alias("n"), *cols)


def blended(own: str, wider: str) -> Column:
    """Struct of thresholds: those of ``own`` (with ``n``), shrunk towards ``wider``'s."""
    limits = [F.expr(f"({own}.n * {own}.{k} + {PRIOR} * {wider}.{k}) div ({own}.n + {PRIOR})").alias(k) for k in RATES]
    return F.struct(F.col(f"{own}.n").alias("n"), *limits)


def judged(rows: DataFrame, m: str, lang: str, source: str, scratch: Scratch) -> DataFrame:
    """``rows`` with booleans ``base_failed`` and ``kept`` (as columns ``m``_base, ``m``_kept)."""
    sketch = sketches(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), m), m)
    levels = scratch.save(thresholds(sketch), "levels")
    level = lambda i, name: levels.where(F.col("level") == i).select("lang", "source", F.struct("n", *RATES).alias(name))
    whole = level(2, "l2").select("l2").scalar()
    by_lang = level(1, "l1").withColumn("l2", whole).select(F.col("lang").alias("lang1"), blended("l1", "l2").alias("l1"))
    by = level(0, "l0").join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")))
    by = by.select(F.struct("lang", "source").alias("g"), blended("l0", "l1").alias("limit"))
    limit, g = f"{m}_limit", f"{m}_group"
    # stored, so that the planner knows how small the table of thresholds is
    by = scratch.save(by.select(F.col("g").alias(g), F.col("limit").alias(limit)), "thresholds")
    base = (F.col(f"{m}.n_words") < LEAST_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MOST_REPEATED)
    fine = None
    for k, v in rates(m).items():
        fine = (v <= F.col(limit)[k]) if fine is None else fine & (v <= F.col(limit)[k])
    joined = rows.join(by, (F.col(lang).eqNullSafe(F.col(g)["lang"])) & (F.col(source).eqNullSafe(F.col(g)["source"])))
    return joined.withColumn(f"{m}_base", base).withColumn(f"{m}_kept", ~base & fine)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """One row per document: ``(<id>, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept)``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated
    8-word windows. ``kept``: not so, and no rate above its threshold. Null and
    empty texts have no words and fail. Null languages or sources form groups
    of their own. Repeated rows and null ids are rows like any other; an empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                                    measures(F.col(text_col)).alias("m")), "measures")
    return judged(rows, "m", "lang", "source", scratch).select(
        F.col("id").alias(id_col), "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        F.col("m_base").alias("base_failed"), F.col("m_kept").alias("kept"))


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            scratch: Scratch | None = None) -> DataFrame:
    """The documents of ``docs`` that :func:`rules` keeps, in its columns."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    m = fresh(docs, "m")
    rows = scratch.save(docs.withColumn(m, measures(F.col(text_col))), "rows")
    return judged(rows, m, lang_col, source_col, scratch).where(F.col(f"{m}_kept")).select(*[rows[c] for c in docs.columns])


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`rules` over table ``docs``."""
    words = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
    per = lambda k, a, b: f"{k} * {a} // greatest({b}, 1)"
    rate = {"symbols": per(1000, "n_symbols", "n_words"), "capitals": per(1000, "n_capitals", "word_chars"),
            "dup_lines": per(1000, "n_dup_lines", "n_lines"), "stutter": per(1000, "n_stutter", "n_words"),
            "word_length": per(100, "word_chars", "n_words")}
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v} AS value FROM c" for k, v in rate.items())

    def level(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        cols = ", ".join(f"max(CASE WHEN rate = '{r}' THEN mid + {SPREADS} * greatest(mid - low, {v}) END) AS {r}"
                         for r, v in RATES.items())
        group = f"GROUP BY {keys}" if keys else ""
        return f"""{name} AS (SELECT {k}max(total) AS n, {cols} FROM (
  SELECT {k}rate, max(total) AS total, min(CASE WHEN upto * 10 >= total THEN bucket END) AS low,
         min(CASE WHEN upto * 2 >= total THEN bucket END) AS mid
  FROM (SELECT *, sum(n) OVER (PARTITION BY {k}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}rate) AS total
        FROM (SELECT {k}rate, bucket, sum(n) AS n FROM sk GROUP BY {k}rate, bucket)) GROUP BY {k}rate) {group})"""

    wide = {r: f"((l.n * l.{r} + {PRIOR} * a.{r}) // (l.n + {PRIOR}))" for r in RATES}
    limits = {r: f"((g.n * g.{r} + {PRIOR} * {wide[r]}) // (g.n + {PRIOR}))" for r in RATES}
    fine = " AND ".join(f"({rate[r]}) <= {limits[r]}" for r in RATES)
    base = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {words} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_CHAR}')) AS li
           FROM {docs}),
v AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS run FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM v) WHERE n > 1),
y AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM t) GROUP BY r),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(li) - len(list_distinct(li)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(li) AS BIGINT) AS n_lines,
             CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter,
             CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
      FROM d LEFT JOIN y USING (r)),
sk AS (SELECT lang, source, rate, (value >> greatest(length(bin(value)) - 8, 0)) << greatest(length(bin(value)) - 8, 0) AS bucket,
              count(*) AS n FROM ({each}) GROUP BY ALL),
{level("g", "lang, source")}, {level("l", "lang")}, {level("a", "")}
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
       NOT {base} AND {fine} AS kept
FROM c JOIN g ON c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source
JOIN l ON c.lang IS NOT DISTINCT FROM l.lang, a"""
