"""Catalogue queries: listing, filters, search by name, suggestions, ordering.

Each query reads the whole shop views; money leaves as double on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartograph.functions.json import first_image_url
from cartograph.operators import catalog as C
from cartograph.operators.common import deep_page, first_n, page, stack_rows
from cartograph.operators.search import names_containing
from cartograph.plans.registry import register
from cartograph.sources.shop import Shop
from cartograph.sources.tables import load_table

AS_OF_EVENTS = "2024-01-31 00:00:00"


def _dbl(c):
    return F.col(c).cast("double").alias(c)


PRODUCT_OUT = ["id", "name", "price", "stock_qty", "rating_avg"]


def _product_out(df):
    return df.select("id", "name", _dbl("price"), "stock_qty", _dbl("rating_avg"))


PRODUCT_OUT_SQL = ("id, name, CAST(price AS DOUBLE) AS price, stock_qty, "
                   "CAST(rating_avg AS DOUBLE) AS rating_avg")


# Flagship (§7.1 step 1): FIL-1, FIL-3, FIL-5, FIL-6, FTS-3, SRT-2, SRT-1.
CATALOG_ARGS = dict(q="ring", sort="price_asc", min_price=900, max_price=1400, stock=True)


def catalog_search_frame(shop: Shop):
    a = CATALOG_ARGS
    hits = C.optional_filters(C.name_contains(C.live_products(shop.products), a["q"]),
                              min_price=a["min_price"], max_price=a["max_price"], stock=a["stock"])
    return hits


@register("catalog_search", bench=True, oracle=f"""
    SELECT {PRODUCT_OUT_SQL} FROM shop_products
    WHERE is_active AND status = 'LIVE' AND lower(name) LIKE '%ring%'
      AND price >= 900 AND price <= 1400 AND stock_qty > 0
    ORDER BY price ASC, rating_avg DESC, id ASC LIMIT 20""")
def catalog_search(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return _product_out(page(catalog_search_frame(shop), C.search_order("price_asc"), 0, 20))


@register("fil_1_live_products", oracle="""
    SELECT id, name, created_at FROM shop_products WHERE is_active AND status = 'LIVE'""")
def fil_1(spark, sf_dir):
    return C.live_products(Shop(spark, sf_dir).products).select("id", "name", "created_at")


@register("fil_2_featured_products", oracle="""
    SELECT id, name FROM shop_products WHERE is_active AND status = 'LIVE' AND is_featured""")
def fil_2(spark, sf_dir):
    return C.featured_products(Shop(spark, sf_dir).products).select("id", "name")


@register("fil_3_optional_filters", oracle=f"""
    SELECT {PRODUCT_OUT_SQL} FROM shop_products WHERE price >= 990 AND stock_qty > 0""")
def fil_3(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return _product_out(C.optional_filters(shop.products, shop.categories, category=None,
                                           min_price=990, max_price=None, stock=True))


@register("fil_3_category_and_price", oracle=f"""
    SELECT {PRODUCT_OUT_SQL} FROM shop_products
    WHERE category_id = (SELECT id FROM shop_categories WHERE slug = 'economy') AND price <= 1100""")
def fil_3_category(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return _product_out(C.optional_filters(shop.products, shop.categories, category="economy", max_price=1100))


@register("fil_4_in_category", oracle="""
    SELECT id, name, category_id FROM shop_products
    WHERE category_id = (SELECT id FROM shop_categories WHERE slug = 'promo')""")
def fil_4(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.in_category(shop.products, shop.categories, "promo").select("id", "name", "category_id")


@register("fil_5_price_between", oracle=f"""
    SELECT {PRODUCT_OUT_SQL} FROM shop_products WHERE price >= 950 AND price <= 1050.5""")
def fil_5(spark, sf_dir):
    return _product_out(C.price_between(Shop(spark, sf_dir).products, 950, "1050.5"))


@register("fil_6_in_stock", oracle="""
    SELECT id, stock_qty FROM shop_products WHERE stock_qty > 0""")
def fil_6(spark, sf_dir):
    return C.in_stock(Shop(spark, sf_dir).products, True).select("id", "stock_qty")


@register("fil_6_in_stock_false", oracle="""
    SELECT id, stock_qty FROM shop_products WHERE false""")
def fil_6_false(spark, sf_dir):
    return C.in_stock(Shop(spark, sf_dir).products, False).select("id", "stock_qty")


@register("fil_7_lookup", oracle="""
    SELECT r.id AS review_id, r.product_id, p.name, p.id IS NOT NULL AS found
    FROM shop_reviews r LEFT JOIN shop_products p ON p.id = r.product_id""")
def fil_7(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    keys = shop.reviews.select(F.col("id").alias("review_id"), "product_id")
    dim = shop.products.select(F.col("id").alias("product_id"), "name")
    return C.lookup(keys, dim, "product_id").select("review_id", "product_id", "name", "found")


@register("fil_7_lookup_ignore_case", oracle="""
    SELECT r.request_id, r.code, p.code AS promo_code, p.code IS NOT NULL AS found
    FROM shop_promo_requests r LEFT JOIN shop_promo_codes p ON lower(r.code) = lower(p.code)""")
def fil_7_ci(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    keys = shop.promo_requests.select("request_id", "code")
    dim = shop.promo_codes.select(F.col("code").alias("promo_code"))
    return C.lookup(keys, dim, "code", "promo_code", ignore_case=True) \
        .select("request_id", "code", "promo_code", "found")


@register("fil_8_orders_of", oracle="""
    SELECT id, user_id, status, created_at FROM shop_orders WHERE status = 'PROCESSING'""")
def fil_8(spark, sf_dir):
    return C.orders_of(Shop(spark, sf_dir).orders, None, "processing") \
        .select("id", "user_id", "status", "created_at")


@register("fil_8_orders_of_user", oracle="""
    SELECT id, user_id, status, created_at FROM shop_orders WHERE user_id = 1""")
def fil_8_user(spark, sf_dir):
    return C.orders_of(Shop(spark, sf_dir).orders, 1, "All").select("id", "user_id", "status", "created_at")


@register("fil_9_visible_reviews", oracle="""
    SELECT id, product_id, rating, created_at FROM shop_reviews WHERE NOT is_hidden""")
def fil_9(spark, sf_dir):
    return C.visible_reviews(Shop(spark, sf_dir).reviews) \
        .select("id", "product_id", "rating", "created_at")


@register("fil_9_reviews_of_product", oracle="""
    SELECT id, product_id, rating, created_at FROM shop_reviews WHERE NOT is_hidden AND product_id = 41""")
def fil_9_product(spark, sf_dir):
    return C.visible_reviews(Shop(spark, sf_dir).reviews, 41).select("id", "product_id", "rating", "created_at")


@register("fil_10_products_of_seller", oracle="""
    SELECT p.id, p.name, p.status, u.email AS seller_email
    FROM shop_products p JOIN shop_sellers s ON s.id = p.seller_id
    JOIN shop_users u ON u.id = s.user_id""")
def fil_10(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.products_of_seller(shop.products, shop.sellers, shop.users) \
        .select("id", "name", "status", "seller_email")


@register("jon_3_sellers_with_account", oracle="""
    SELECT s.id, s.store_name, u.email FROM shop_sellers s JOIN shop_users u ON u.id = s.user_id""")
def jon_3(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.sellers_with_account(shop.sellers, shop.users).select("id", "store_name", "email")


@register("prj_1_stock_state", oracle="""
    SELECT id, stock_qty, CASE WHEN stock_qty <= 0 THEN 'OUT'
                               WHEN stock_qty <= low_stock_threshold THEN 'LOW'
                               ELSE 'OK' END AS stock_state
    FROM shop_products""")
def prj_1(spark, sf_dir):
    return C.with_stock_state(Shop(spark, sf_dir).products).select("id", "stock_qty", "stock_state")


@register("prj_2_tracking", oracle="""
    SELECT id AS order_id, status,
           coalesce(strftime(estimated_delivery_date, '%Y-%m-%d'), 'TBD') AS estimated_delivery
    FROM shop_orders""")
def prj_2(spark, sf_dir):
    return C.tracking(Shop(spark, sf_dir).orders)


@register("prj_3_public_profile", oracle="""
    SELECT id, email, first_name, last_name, phone, coalesce(avatar_url, '') AS avatar_url,
           role, email_verified FROM shop_users""")
def prj_3(spark, sf_dir):
    return C.public_profile(Shop(spark, sf_dir).users)


@register("fts_3_name_contains", oracle="""
    SELECT id, name FROM shop_products WHERE lower(name) LIKE '%ri_g%'""")
def fts_3(spark, sf_dir):
    return C.name_contains(Shop(spark, sf_dir).products, "Ri_g").select("id", "name")


@register("fts_3_names_containing", oracle="""
    SELECT q.query, p.id AS product_id
    FROM (SELECT DISTINCT query FROM shop_search_events WHERE query IS NOT NULL
          UNION SELECT DISTINCT prefix FROM shop_prefix_requests) q
    JOIN shop_products p ON lower(p.name) LIKE '%' || lower(q.query) || '%'""")
def fts_3_batch(spark, sf_dir):
    """Every different search text and prefix (some with wildcards) at once."""
    shop = Shop(spark, sf_dir)
    texts = shop.search_events.select("query").union(shop.prefix_requests.select("prefix")).distinct()
    return names_containing(shop.products, texts, "query").select("query", F.col("id").alias("product_id"))


@register("fts_5_suggest", oracle="""
    SELECT request_id, prefix, name, rank FROM (
      SELECT r.request_id, r.prefix, n.name,
             row_number() OVER (PARTITION BY r.request_id ORDER BY n.name) AS rank
      FROM shop_prefix_requests r
      JOIN (SELECT DISTINCT name FROM shop_products WHERE is_active) n
        ON lower(n.name) LIKE lower(r.prefix) || '%'
      WHERE length(trim(r.prefix)) >= 2) t
    WHERE rank <= 10""")
def fts_5(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.suggest(shop.products, shop.prefix_requests) \
        .withColumn("rank", F.col("rank").cast("bigint"))


@register("srt_1_page", oracle="""
    SELECT id, name, created_at FROM shop_products WHERE is_active AND status = 'LIVE'
    ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 40""")
def srt_1(spark, sf_dir):
    live = C.live_products(Shop(spark, sf_dir).products)
    return page(live, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], 2, 20) \
        .select("id", "name", "created_at")


@register("srt_1_deep_page", oracle="""
    SELECT order_id, line_no, CAST(unit_price AS DOUBLE) AS unit_price FROM shop_order_items
    ORDER BY unit_price DESC NULLS FIRST, order_id, line_no LIMIT 20 OFFSET 5000""")
def srt_1_deep(spark, sf_dir):
    return deep_page(Shop(spark, sf_dir).order_items,
                     [("unit_price", True), ("order_id", False), ("line_no", False)], 250, 20) \
        .select("order_id", "line_no", _dbl("unit_price"))


@register("srt_2_search_order", oracle=f"""
    SELECT {PRODUCT_OUT_SQL} FROM shop_products WHERE is_active AND status = 'LIVE'
    ORDER BY price DESC, rating_avg DESC, id ASC LIMIT 20 OFFSET 20""")
def srt_2(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return _product_out(C.search_products(shop.products, shop.categories, sort="price_desc",
                                          page_no=1, size=20))


@register("srt_3_ordered_categories", oracle="""
    SELECT id, name, slug, sort_order FROM shop_categories""")
def srt_3(spark, sf_dir):
    return C.ordered_categories(Shop(spark, sf_dir).categories).select("id", "name", "slug", "sort_order")


@register("srt_4_top_per_category", oracle="""
    SELECT category_id, id, CAST(rating_avg AS DOUBLE) AS rating_avg, rank FROM (
      SELECT category_id, id, rating_avg,
             row_number() OVER (PARTITION BY category_id ORDER BY rating_avg DESC, id) AS rank
      FROM shop_products WHERE is_active) t WHERE rank <= 5""")
def srt_4(spark, sf_dir):
    return C.top_per_category(Shop(spark, sf_dir).products, 5) \
        .select("category_id", "id", _dbl("rating_avg"), F.col("rank").cast("bigint"))


@register("lim_1_first_n", oracle="""
    SELECT name FROM (SELECT DISTINCT name FROM shop_products) t ORDER BY name LIMIT 10""")
def lim_1(spark, sf_dir):
    return first_n(C.distinct_names(Shop(spark, sf_dir).products), [F.col("name")], 10)


@register("agg_11_page_total", oracle="""
    SELECT count(*) AS total FROM shop_products
    WHERE is_active AND status = 'LIVE' AND lower(name) LIKE '%ring%'
      AND price >= 900 AND price <= 1400 AND stock_qty > 0""")
def agg_11(spark, sf_dir):
    return C.page_total(catalog_search_frame(Shop(spark, sf_dir)))


@register("agg_13_distinct_names", oracle="SELECT DISTINCT name FROM shop_products")
def agg_13(spark, sf_dir):
    return C.distinct_names(Shop(spark, sf_dir).products)


@register("set_1_stack_rows", oracle="""
    SELECT id, 'featured' AS list FROM shop_products WHERE is_featured
    UNION ALL
    SELECT id, 'low_stock' AS list FROM shop_products WHERE stock_qty <= low_stock_threshold""")
def set_1(spark, sf_dir):
    p = Shop(spark, sf_dir).products
    return stack_rows(p.where("is_featured").select("id", F.lit("featured").alias("list")),
                      p.where(F.col("stock_qty") <= F.col("low_stock_threshold"))
                       .select("id", F.lit("low_stock").alias("list")))


@register("trd_1_trending", oracle=f"""
    SELECT lower(trim(query)) AS term, count(DISTINCT user_id) AS users
    FROM shop_search_events
    WHERE searched_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY
      AND searched_at < TIMESTAMP '{AS_OF_EVENTS}' AND lower(trim(query)) <> ''
    GROUP BY 1 ORDER BY users DESC, term LIMIT 8""")
def trd_1(spark, sf_dir):
    return C.trending(Shop(spark, sf_dir).search_events, AS_OF_EVENTS, "7 days", 8)


@register("src_1_typed_scan", oracle="SELECT * FROM orders")
def src_1(spark, sf_dir):
    return load_table(spark, sf_dir, "orders")


@register("src_3_first_image_url", oracle="""
    SELECT id, json_extract_string(images, '$[0].url') AS image_url FROM shop_products""")
def src_3(spark, sf_dir):
    return Shop(spark, sf_dir).products.select("id", first_image_url("images").alias("image_url"))
