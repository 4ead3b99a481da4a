"""Rollup columns that stay right as rows change (AGG-5, AGG-6, AGG-9, AGG-10).

A change is the rows before and after it; it becomes signed contributions, the
old ones taken back and the new ones added, per key of the rollup. They are
appended to a :class:`~cartograph.operators.deltas.DeltaTable` under the number
of the batch, so an hour of hidden reviews costs an hour's rows and not the
table, and a batch applied twice counts once. Contributions of a hot product
are combined before the shuffle, like any sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators.analytics import rounded_mean_cents
from cartograph.operators.deltas import DeltaTable


def signed(before: DataFrame | None, after: DataFrame | None, contribution) -> DataFrame:
    """Contributions of a change: ``contribution(rows, sign)`` of both sides."""
    parts = [contribution(df, sign) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _summed(key: list[str]):
    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in df.columns if c not in key])
    return merge


def ratings_table(spark: SparkSession, path: str, key: str = "product_id") -> DeltaTable:
    """Stars and number of visible reviews per ``key``."""
    return DeltaTable(spark, path, f"{key} long, stars long, reviews long", _summed([key]))


def rating_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """AGG-5: what a change of reviews (new, edited, hidden, shown, deleted)
    adds to their products. Hidden reviews count nothing."""
    return signed(before, after, lambda df, sign: df.where(~F.col("is_hidden")).select(
        "product_id", (F.col("rating") * sign).cast("long").alias("stars"), F.lit(sign).cast("long").alias("reviews")))


def seller_rating_changes(changes: DataFrame, products: DataFrame) -> DataFrame:
    """AGG-6: :func:`rating_changes` by the products' sellers."""
    own = products.select(F.col("id").alias("product_id"), "seller_id")
    per_product = _summed(["product_id"])(changes)  # few rows meet the products
    return per_product.join(own, "product_id").select("seller_id", "stars", "reviews")


def rating_columns(owners: DataFrame, table: DeltaTable, key: str = "product_id") -> DataFrame:
    """``(key, rating_avg, review_count)`` of every owner (column ``id``), 0 without reviews."""
    x = owners.select(F.col("id").alias(key)).join(table.current().where("reviews > 0"), key, "left")
    mean = (rounded_mean_cents(F.col("stars"), F.col("reviews")) / 100).cast("decimal(3,2)")
    return x.select(key, F.coalesce(mean, F.lit(0).cast("decimal(3,2)")).alias("rating_avg"),
                    F.coalesce("reviews", F.lit(0)).cast("long").alias("review_count"))


def votes_table(spark: SparkSession, path: str) -> DeltaTable:
    """AGG-9: how often each (review, user) pair is held."""
    return DeltaTable(spark, path, "review_id long, user_id long, n long", _summed(["review_id", "user_id"]))


def vote_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    return signed(before, after, lambda df, sign: df.select("review_id", "user_id", F.lit(sign).cast("long").alias("n")))


def vote_counts(table: DeltaTable) -> DataFrame:
    """Distinct voters per review."""
    return table.current().where("n > 0").groupBy("review_id").agg(F.count(F.lit(1)).alias("helpful_votes"))


def uses_table(spark: SparkSession, path: str) -> DeltaTable:
    """AGG-10: orders per promo code."""
    return DeltaTable(spark, path, "promo_id long, uses_count long", _summed(["promo_id"]))


def use_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    return signed(before, after, lambda df, sign: df.where(F.col("promo_id").isNotNull()).select(
        "promo_id", F.lit(sign).cast("long").alias("uses_count")))


def with_uses(promos: DataFrame, uses: DataFrame) -> DataFrame:
    """Promo codes with their real ``uses_count`` (as PRC-3 reads it)."""
    n = uses.select(F.col("promo_id").alias("id"), F.col("uses_count").alias("_uses"))
    return promos.join(n, "id", "left").withColumn("uses_count", F.coalesce("_uses", F.lit(0))).select(*promos.columns)
