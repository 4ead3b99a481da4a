"""Full-text search: inverted index and all-terms matching (FTS-1, FTS-2).

The reference keeps a generated ``tsvector`` column with a GIN index and asks
``vector @@ plainto_tsquery(q)``: every non-stop query lexeme must occur. Here
the vector is the :func:`cartograph.functions.text.lexemes` array, the index
is a ``(term, doc_id)`` postings frame, and many queries are answered at once
by joining query terms to postings and counting matched terms per
(query, document). Lexemes follow PostgreSQL's English configuration:
tokenise, lower-case, stop words, Porter2 stemming (see the README for how
tokens differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions.text import lexemes


def document_text(*cols: str):
    """Text columns joined by a space, nulls as empty text (as the
    reference's ``coalesce(name,'') || ' ' || coalesce(description,'')``)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def build_postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """FTS-1: one ``(term, doc_id)`` row per distinct lexeme of each document.
    Map-only (no shuffle): every document is tokenised where it lies."""
    vec = lexemes(document_text(*text_cols))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(vec).alias("term"))


def write_postings(postings: DataFrame, path: str) -> None:
    """Persist postings sorted by term inside each file, so parquet min/max
    statistics let a term lookup skip row groups; no shuffle is added."""
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def match_all_terms(postings: DataFrame, queries: DataFrame, id_col: str = "query_id",
                    text_col: str = "text") -> DataFrame:
    """FTS-2: (query_id, doc_id) for every document holding all lexemes of the
    query; a query without lexemes (only stop words) matches nothing.

    * Queries with the same lexeme set are answered once and joined back at
      the end, so repeated searches cost one match.
    * Each set starts from its rarest lexeme (document frequency from one
      partial-aggregated pass over the postings): only documents holding that
      lexeme are candidates, and only candidates are checked for the other
      lexemes with a semi join on ``(term, doc_id)``. Common words never fan
      out against every set that contains them.
    """
    keyed = queries.select(F.col(id_col).alias("query_id"),
                           F.array_sort(lexemes(F.col(text_col))).alias("qset")) \
        .where(F.size("qset") > 0)
    sets = keyed.select("qset").distinct()
    terms = sets.select("qset", F.size("qset").alias("n_terms"), F.explode("qset").alias("term"))
    # only postings of terms that some query holds
    postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms.join(freq, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = ranked.groupBy("qset", "n_terms").agg(
        F.min(F.struct("df", "term")).alias("_r")) \
        .where(F.col("_r.df") > 0) \
        .select("qset", "n_terms", F.col("_r.term").alias("term"))
    candidates = postings.join(rarest, "term").select("qset", "n_terms", "doc_id")
    single = candidates.where(F.col("n_terms") == 1).select("qset", "doc_id")
    multi = candidates.where(F.col("n_terms") > 1)
    to_check = multi.join(terms.select("qset", "term"), "qset")
    present = to_check.join(postings.select("term", "doc_id"), ["term", "doc_id"], "left_semi")
    verified = present.groupBy("qset", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("_m")) \
        .where(F.col("_m") == F.col("n_terms")).select("qset", "doc_id")
    return keyed.join(single.unionByName(verified), "qset").select("query_id", "doc_id")


def _grams(text: str, n: int) -> Column:
    """The different pieces of ``n`` characters of a text column."""
    at = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
    pieces = F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def names_containing(products: DataFrame, patterns: DataFrame, pattern_col: str = "query",
                     name_col: str = "name") -> DataFrame:
    """FTS-3 for many patterns at once: every product with the (different)
    patterns its name contains, upper and lower case alike; ``%`` and ``_``
    stay wildcards, a backslash stands for itself, an empty pattern matches
    every name. A null pattern or name matches nothing.

    Wildcards cut a pattern into literal runs. A name that matches holds every
    piece of three characters of every run, so the pattern meets only the names
    with the rarest of them, and those are verified with LIKE. Where no run has
    three characters, pieces of two or of one take their place; a pattern of
    wildcards alone meets every name. All lengths go through the same join, so
    no pattern is left out. Names are matched once per different lower-case
    name; counts of names per piece are pre-aggregated and only for pieces that
    some pattern holds.
    """
    asked = patterns.select(pattern_col).distinct().where(F.col(pattern_col).isNotNull()) \
        .withColumn("_p", F.lower(pattern_col))
    runs = F.split("_p", "[%_]+")
    longest = F.array_max(F.transform(runs, F.char_length))
    wanted = asked.select("_p").distinct().withColumn("_n", F.least(longest, F.lit(3)))
    pieces = F.flatten(F.transform(runs, lambda run: F.when(
        (F.char_length(run) >= F.col("_n")) & (F.col("_n") > 0),
        F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - F.col("_n") + 1, F.lit(1))),
                    lambda i: F.substring(run, i, F.col("_n")))).otherwise(F.array().cast("array<string>"))))
    held = wanted.select("_p", F.explode(F.when(F.col("_n") == 0, F.array(F.lit("")))
                                         .otherwise(F.array_distinct(pieces))).alias("_g"))
    names = products.where(F.col(name_col).isNotNull()).select(F.lower(name_col).alias("_name")).distinct()
    grams = F.concat(F.array(F.lit("")), _grams("_name", 1), _grams("_name", 2), _grams("_name", 3))
    postings = names.select("_name", F.explode(grams).alias("_g")) \
        .join(held.select("_g").distinct(), "_g", "left_semi")
    freq = postings.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    # a piece that no name holds counts 0 and its pattern meets nothing
    rarest = held.join(freq, "_g", "left").groupBy("_p") \
        .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_g")).alias("_r")) \
        .where("_r._df > 0").select("_p", F.col("_r._g").alias("_g"))
    like = F.concat(F.lit("%"), F.replace("_p", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    plain = ~F.col("_p").rlike("[%_]")
    hits = postings.join(rarest, "_g") \
        .where(F.when(plain, F.contains("_name", "_p")).otherwise(F.like(F.col("_name"), like))) \
        .select("_name", "_p")
    texts = hits.join(asked, "_p").select("_name", pattern_col)
    return products.withColumn("_name", F.lower(name_col)).join(texts, "_name").drop("_name")
