"""Grouped analytics and access joins (AGG-1..10, AGG-12, JON-1, JON-2, JON-4, JON-5).

Pattern used throughout: aggregate the big side on its own key first (Spark
adds a partial, map-side aggregate before the shuffle), then join the small
per-key result to the dimension. Joins between per-user results share the
same hash partitioning, so stacking them costs no extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions.json import first_image_url
from cartograph.operators.common import ts_lit


def rounded_mean_cents(total: Column, count: Column) -> Column:
    """round(total / count, 2) half-up, as integer cents, exactly:
    ``floor((200 * total + count) / (2 * count))``."""
    return F.floor((total * 200 + count) / (count * 2))


# ------------------------------------------------------------------- totals --
def platform_totals(users: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """AGG-1: one row with the number of users, orders and products.
    Three pruned scans stacked and summed (no cross join)."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    parts = [users.select(one.alias("users"), zero.alias("orders"), zero.alias("products")),
             orders.select(zero.alias("users"), one.alias("orders"), zero.alias("products")),
             products.select(zero.alias("users"), zero.alias("orders"), one.alias("products"))]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
                         for c in ("users", "orders", "products")])


def platform_revenue(orders: DataFrame) -> DataFrame:
    """AGG-2 (our definition; the reference shows a placeholder): sum of
    order totals, cancelled orders excluded."""
    return orders.where(F.col("status") != "CANCELLED") \
        .agg(F.coalesce(F.sum("total"), F.lit(0)).alias("revenue"))


def _line_revenue(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines of orders that are not cancelled, with their order date."""
    live = orders.where(F.col("status") != "CANCELLED") \
        .select(F.col("id").alias("order_id"), F.col("created_at").alias("ordered_at"))
    return items.join(live, "order_id") \
        .withColumn("amount", F.col("quantity") * F.col("unit_price"))


def seller_dashboard(sellers: DataFrame, products: DataFrame, orders: DataFrame,
                     items: DataFrame) -> DataFrame:
    """AGG-3 for every seller at once: store, stored rating and review count,
    number of products (any status), revenue (sum of quantity x unit price
    over lines of orders that are not cancelled; the reference shows 0.0),
    verified flag."""
    per_product = _line_revenue(items, orders).groupBy("product_id") \
        .agg(F.sum("amount").alias("revenue"))
    owner = products.select(F.col("id").alias("product_id"), "seller_id")
    per_seller_rev = per_product.join(owner, "product_id") \
        .groupBy("seller_id").agg(F.sum("revenue").alias("revenue"))
    counts = products.groupBy("seller_id").agg(F.count(F.lit(1)).alias("product_count"))
    s = sellers.select(F.col("id").alias("seller_id"), "store_name", "rating_avg",
                       "review_count", "is_verified")
    return s.join(counts, "seller_id", "left").join(per_seller_rev, "seller_id", "left") \
        .select("seller_id", "store_name", "rating_avg", "review_count",
                F.coalesce("product_count", F.lit(0)).alias("product_count"),
                F.coalesce("revenue", F.lit(0)).alias("revenue"), "is_verified")


def seller_analytics(sellers: DataFrame, products: DataFrame, orders: DataFrame,
                     items: DataFrame, views: DataFrame, as_of, days: int = 30,
                     views_as_of=None) -> DataFrame:
    """AGG-4 (our definition; the reference returns zeros): per seller, over
    ``[as_of - days, as_of)``: revenue and distinct orders of lines of orders
    that are not cancelled, and product views (window ending at
    ``views_as_of``, default ``as_of``)."""
    end = ts_lit(as_of)
    start = end - F.expr(f"INTERVAL {int(days)} DAYS")
    vend = ts_lit(views_as_of if views_as_of is not None else as_of)
    vstart = vend - F.expr(f"INTERVAL {int(days)} DAYS")
    owner = products.select(F.col("id").alias("product_id"), "seller_id")
    lines = _line_revenue(items, orders) \
        .where((F.col("ordered_at") >= start) & (F.col("ordered_at") < end))
    # distinct orders need (seller, order) pairs; pre-aggregate per (product, order)
    per_po = lines.groupBy("product_id", "order_id").agg(F.sum("amount").alias("amount"))
    sales = per_po.join(owner, "product_id").groupBy("seller_id") \
        .agg(F.sum("amount").alias("revenue_30d"), F.countDistinct("order_id").alias("orders_30d"))
    seen = views.where((F.col("ts") >= vstart) & (F.col("ts") < vend)) \
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("n")) \
        .join(owner, "product_id").groupBy("seller_id").agg(F.sum("n").alias("views_30d"))
    return sellers.select(F.col("id").alias("seller_id")) \
        .join(sales, "seller_id", "left").join(seen, "seller_id", "left") \
        .select("seller_id",
                F.coalesce("revenue_30d", F.lit(0)).alias("revenue_30d"),
                F.coalesce("orders_30d", F.lit(0)).cast("bigint").alias("orders_30d"),
                F.coalesce("views_30d", F.lit(0)).cast("bigint").alias("views_30d"))


def product_ratings(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """AGG-5: per product, mean (2 decimals, half-up) and count of reviews
    that are not hidden; products without reviews get 0.00 and 0."""
    agg = reviews.where(~F.col("is_hidden")).groupBy("product_id") \
        .agg(F.sum("rating").alias("_s"), F.count(F.lit(1)).alias("review_count"))
    agg = agg.select("product_id", "review_count",
                     (rounded_mean_cents(F.col("_s"), F.col("review_count")) / 100)
                     .cast("decimal(3,2)").alias("rating_avg"))
    return products.select(F.col("id").alias("product_id")).join(agg, "product_id", "left") \
        .select("product_id",
                F.coalesce("rating_avg", F.lit(0).cast("decimal(3,2)")).alias("rating_avg"),
                F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"))


def seller_ratings(sellers: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """AGG-6: AGG-5 at seller level, every review weighing the same."""
    per_product = reviews.where(~F.col("is_hidden")).groupBy("product_id") \
        .agg(F.sum("rating").alias("_s"), F.count(F.lit(1)).alias("_n"))
    owner = products.select(F.col("id").alias("product_id"), "seller_id")
    per_seller = per_product.join(owner, "product_id").groupBy("seller_id") \
        .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    per_seller = per_seller.select(
        "seller_id", F.col("_n").alias("review_count"),
        (rounded_mean_cents(F.col("_s"), F.col("_n")) / 100).cast("decimal(3,2)").alias("rating_avg"))
    return sellers.select(F.col("id").alias("seller_id")).join(per_seller, "seller_id", "left") \
        .select("seller_id",
                F.coalesce("rating_avg", F.lit(0).cast("decimal(3,2)")).alias("rating_avg"),
                F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"))


def cart_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """JON-1: cart line with product name, current price, first image URL and
    quantity (lines whose product is gone drop out, as in an inner join)."""
    p = products.select(F.col("id").alias("product_id"), "name",
                        F.col("price").alias("current_price"),
                        first_image_url("images").alias("image_url"))
    return items.join(p, "product_id") \
        .select("cart_id", "product_id", "name", "current_price", "image_url", "quantity")


def cart_totals(items: DataFrame, products: DataFrame) -> DataFrame:
    """AGG-7: per cart, item count = sum of quantities, subtotal = sum of
    current price x quantity (the order job uses the snapshot price)."""
    lines = cart_lines(items, products)
    return lines.groupBy("cart_id").agg(
        F.sum("quantity").cast("bigint").alias("item_count"),
        F.sum(F.col("current_price") * F.col("quantity")).alias("subtotal"))


def account_counters(users: DataFrame, orders: DataFrame, wishlists: DataFrame,
                     reviews: DataFrame) -> DataFrame:
    """AGG-8: orders, wishlist entries and reviews per user, 0 when none."""
    def per_user(df, name):
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    out = users.select(F.col("id").alias("user_id"))
    for df, name in ((orders, "orders_count"), (wishlists, "wishlist_count"),
                     (reviews, "reviews_count")):
        out = out.join(per_user(df, name), "user_id", "left")
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                   for c in ("orders_count", "wishlist_count", "reviews_count")])


def helpful_votes(votes: DataFrame) -> DataFrame:
    """AGG-9: distinct voters per review ((user, review) is the key)."""
    return votes.groupBy("review_id").agg(F.countDistinct("user_id").alias("helpful_votes"))


def promo_uses(orders: DataFrame) -> DataFrame:
    """AGG-10: orders per promo code."""
    return orders.where(F.col("promo_id").isNotNull()).groupBy("promo_id") \
        .agg(F.count(F.lit(1)).alias("uses_count"))


def decrement_stock(products: DataFrame, lines: DataFrame) -> DataFrame:
    """AGG-12: stock after the lines are sold: ``max(0, stock - sum(qty))``.
    Quantities are positive, so this equals the reference's per-line
    ``max(0, stock - qty)`` sequence in any order."""
    sold = lines.groupBy("product_id").agg(F.sum("quantity").alias("_sold"))
    return products.join(sold, products["id"] == sold["product_id"], "left") \
        .withColumn("stock_qty", F.greatest(F.lit(0), F.col("stock_qty") -
                                            F.coalesce(F.col("_sold"), F.lit(0))).cast("int")) \
        .drop("_sold", "product_id")


# ------------------------------------------------------------ access joins --
def authorise_review_deletes(requests: DataFrame, reviews: DataFrame, products: DataFrame,
                             sellers: DataFrame, users: DataFrame) -> DataFrame:
    """JON-2: a caller may delete a review when admin, its author, or a user
    with the role SELLER who owns the reviewed product. ``reason`` says which (first match
    in that order); ``allowed`` is false otherwise or when the review is
    missing (``reason = 'not_found'``)."""
    r = reviews.select(F.col("id").alias("review_id"), F.col("user_id").alias("author_id"),
                       "product_id")
    owner = products.select(F.col("id").alias("product_id"), "seller_id") \
        .join(sellers.select(F.col("id").alias("seller_id"), F.col("user_id").alias("owner_id")),
              "seller_id")
    callers = users.select(F.col("id").alias("caller_id"), F.col("role").alias("caller_role"))
    x = requests.join(r, "review_id", "left") \
        .join(owner.select("product_id", "owner_id"), "product_id", "left") \
        .join(callers, "caller_id", "left")
    reason = (F.when(F.col("author_id").isNull(), F.lit("not_found"))
               .when(F.col("caller_role") == "ADMIN", F.lit("admin"))
               .when(F.col("author_id") == F.col("caller_id"), F.lit("author"))
               .when((F.col("caller_role") == "SELLER") & (F.col("owner_id") == F.col("caller_id")), F.lit("seller")))
    return x.select("request_id", "review_id", "caller_id", reason.alias("reason")) \
        .withColumn("allowed", F.col("reason").isin("admin", "author", "seller")
                    & F.col("reason").isNotNull())


def authorise_order_access(requests: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """JON-4: a caller may see an order when they own it or are admin;
    a missing order is not allowed (``found = false``)."""
    o = orders.select(F.col("id").alias("order_id"), F.col("user_id").alias("owner_id"))
    callers = users.select(F.col("id").alias("caller_id"), F.col("role").alias("caller_role"))
    x = requests.join(o, "order_id", "left").join(callers, "caller_id", "left")
    allowed = F.col("owner_id").isNotNull() & (
        (F.col("owner_id") == F.col("caller_id")) | (F.coalesce(F.col("caller_role"), F.lit("")) == "ADMIN"))
    return x.select("request_id", "order_id", "caller_id",
                    F.col("owner_id").isNotNull().alias("found"), allowed.alias("allowed"))


def existing(keys: DataFrame, table: DataFrame, on: str, table_on: str | None = None) -> DataFrame:
    """JON-5: key rows whose key is already taken in ``table`` (semi join)."""
    t = table.select(F.col(table_on or on).alias("_k"))
    return keys.join(t, keys[on] == t["_k"], "left_semi")


def missing(keys: DataFrame, table: DataFrame, on: str, table_on: str | None = None) -> DataFrame:
    """JON-5: key rows whose key is free (anti join; a null key is free)."""
    t = table.select(F.col(table_on or on).alias("_k"))
    return keys.join(t, keys[on] == t["_k"], "left_anti")
