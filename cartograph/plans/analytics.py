"""Grouped analytics, access joins, pricing and scalar-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartograph.functions import money as M
from cartograph.functions import text as T
from cartograph.operators import analytics as A
from cartograph.plans.registry import register
from cartograph.sources.shop import Shop

AS_OF_ORDERS = "1998-08-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def _dbl(c, name=None):
    return F.col(c).cast("double").alias(name or c)


def _cents_sql(s, n):
    return f"CAST(floor((CAST({s} AS DOUBLE) * 200 + {n}) / ({n} * 2)) AS DOUBLE) / 100"


@register("agg_1_platform_totals", oracle="""
    SELECT (SELECT count(*) FROM shop_users) AS users,
           (SELECT count(*) FROM shop_orders) AS orders,
           (SELECT count(*) FROM shop_products) AS products""")
def agg_1(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.platform_totals(shop.users, shop.orders, shop.products)


@register("agg_2_platform_revenue", oracle="""
    SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) AS revenue
    FROM shop_orders WHERE status <> 'CANCELLED'""")
def agg_2(spark, sf_dir):
    return A.platform_revenue(Shop(spark, sf_dir).orders).select(_dbl("revenue"))


@register("agg_3_seller_dashboard", bench=True, oracle="""
    WITH rev AS (
      SELECT p.seller_id, sum(i.quantity * i.unit_price) AS revenue
      FROM shop_order_items i JOIN shop_orders o ON o.id = i.order_id AND o.status <> 'CANCELLED'
      JOIN shop_products p ON p.id = i.product_id GROUP BY p.seller_id),
    cnt AS (SELECT seller_id, count(*) AS product_count FROM shop_products GROUP BY seller_id)
    SELECT s.id AS seller_id, s.store_name, CAST(s.rating_avg AS DOUBLE) AS rating_avg,
           s.review_count, coalesce(c.product_count, 0) AS product_count,
           CAST(coalesce(r.revenue, 0) AS DOUBLE) AS revenue, s.is_verified
    FROM shop_sellers s LEFT JOIN cnt c ON c.seller_id = s.id LEFT JOIN rev r ON r.seller_id = s.id""")
def agg_3(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    out = A.seller_dashboard(shop.sellers, shop.products, shop.orders, shop.order_items)
    return out.select("seller_id", "store_name", _dbl("rating_avg"), "review_count",
                      "product_count", _dbl("revenue"), "is_verified")


@register("agg_4_seller_analytics", oracle=f"""
    WITH lines AS (
      SELECT p.seller_id, i.order_id, i.quantity * i.unit_price AS amount
      FROM shop_order_items i
      JOIN shop_orders o ON o.id = i.order_id AND o.status <> 'CANCELLED'
        AND o.created_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 30 DAY
        AND o.created_at < TIMESTAMP '{AS_OF_ORDERS}'
      JOIN shop_products p ON p.id = i.product_id),
    sales AS (SELECT seller_id, sum(amount) AS revenue_30d, count(DISTINCT order_id) AS orders_30d
              FROM lines GROUP BY seller_id),
    seen AS (SELECT p.seller_id, count(*) AS views_30d FROM shop_product_views v
             JOIN shop_products p ON p.id = v.product_id
             WHERE v.ts >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 30 DAY
               AND v.ts < TIMESTAMP '{AS_OF_EVENTS}' GROUP BY p.seller_id)
    SELECT s.id AS seller_id, CAST(coalesce(sales.revenue_30d, 0) AS DOUBLE) AS revenue_30d,
           coalesce(sales.orders_30d, 0) AS orders_30d, coalesce(seen.views_30d, 0) AS views_30d
    FROM shop_sellers s LEFT JOIN sales ON sales.seller_id = s.id
    LEFT JOIN seen ON seen.seller_id = s.id""")
def agg_4(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    out = A.seller_analytics(shop.sellers, shop.products, shop.orders, shop.order_items,
                             shop.product_views, AS_OF_ORDERS, 30, views_as_of=AS_OF_EVENTS)
    return out.select("seller_id", _dbl("revenue_30d"), "orders_30d", "views_30d")


@register("agg_5_product_ratings", oracle=f"""
    WITH r AS (SELECT product_id, sum(rating) AS s, count(*) AS n FROM shop_reviews
               WHERE NOT is_hidden GROUP BY product_id)
    SELECT p.id AS product_id, coalesce({_cents_sql('r.s', 'r.n')}, 0.0) AS rating_avg,
           coalesce(r.n, 0) AS review_count
    FROM shop_products p LEFT JOIN r ON r.product_id = p.id""")
def agg_5(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.product_ratings(shop.products, shop.reviews) \
        .select("product_id", _dbl("rating_avg"), "review_count")


@register("agg_6_seller_ratings", oracle=f"""
    WITH r AS (SELECT p.seller_id, sum(rv.rating) AS s, count(*) AS n FROM shop_reviews rv
               JOIN shop_products p ON p.id = rv.product_id
               WHERE NOT rv.is_hidden GROUP BY p.seller_id)
    SELECT s.id AS seller_id, coalesce({_cents_sql('r.s', 'r.n')}, 0.0) AS rating_avg,
           coalesce(r.n, 0) AS review_count
    FROM shop_sellers s LEFT JOIN r ON r.seller_id = s.id""")
def agg_6(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.seller_ratings(shop.sellers, shop.products, shop.reviews) \
        .select("seller_id", _dbl("rating_avg"), "review_count")


@register("jon_1_cart_lines", oracle="""
    SELECT i.cart_id, i.product_id, p.name, CAST(p.price AS DOUBLE) AS current_price,
           json_extract_string(p.images, '$[0].url') AS image_url, i.quantity
    FROM shop_cart_items i JOIN shop_products p ON p.id = i.product_id""")
def jon_1(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.cart_lines(shop.cart_items, shop.products) \
        .select("cart_id", "product_id", "name", _dbl("current_price"), "image_url", "quantity")


@register("agg_7_cart_totals", bench=True, oracle="""
    SELECT i.cart_id, CAST(sum(i.quantity) AS BIGINT) AS item_count,
           CAST(sum(p.price * i.quantity) AS DOUBLE) AS subtotal
    FROM shop_cart_items i JOIN shop_products p ON p.id = i.product_id GROUP BY i.cart_id""")
def agg_7(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.cart_totals(shop.cart_items, shop.products) \
        .select("cart_id", "item_count", _dbl("subtotal"))


@register("agg_8_account_counters", oracle="""
    SELECT u.id AS user_id,
           coalesce((SELECT count(*) FROM shop_orders o WHERE o.user_id = u.id), 0) AS orders_count,
           coalesce((SELECT count(*) FROM shop_wishlists w WHERE w.user_id = u.id), 0) AS wishlist_count,
           coalesce((SELECT count(*) FROM shop_reviews r WHERE r.user_id = u.id), 0) AS reviews_count
    FROM shop_users u""")
def agg_8(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.account_counters(shop.users, shop.orders, shop.wishlists, shop.reviews)


@register("agg_9_helpful_votes", oracle="""
    SELECT review_id, count(DISTINCT user_id) AS helpful_votes
    FROM shop_helpful_votes GROUP BY review_id""")
def agg_9(spark, sf_dir):
    return A.helpful_votes(Shop(spark, sf_dir).helpful_votes)


@register("agg_10_promo_uses", oracle="""
    SELECT promo_id, count(*) AS uses_count FROM shop_orders
    WHERE promo_id IS NOT NULL GROUP BY promo_id""")
def agg_10(spark, sf_dir):
    return A.promo_uses(Shop(spark, sf_dir).orders)


@register("agg_12_decrement_stock", oracle="""
    SELECT p.id, CAST(greatest(0, p.stock_qty - coalesce(s.sold, 0)) AS INT) AS stock_qty
    FROM shop_products p
    LEFT JOIN (SELECT product_id, sum(quantity) AS sold FROM shop_cart_items
               GROUP BY product_id) s ON s.product_id = p.id""")
def agg_12(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.decrement_stock(shop.products, shop.cart_items).select("id", "stock_qty")


@register("jon_2_authorise_review_deletes", oracle="""
    SELECT q.request_id, q.review_id, q.caller_id, t.reason,
           coalesce(t.reason IN ('admin', 'author', 'seller'), false) AS allowed
    FROM shop_review_requests q
    LEFT JOIN (
      SELECT q2.request_id,
             CASE WHEN r.id IS NULL THEN 'not_found'
                  WHEN u.role = 'ADMIN' THEN 'admin'
                  WHEN r.user_id = q2.caller_id THEN 'author'
                  WHEN u.role = 'SELLER' AND s.user_id = q2.caller_id THEN 'seller' END AS reason
      FROM shop_review_requests q2
      LEFT JOIN shop_reviews r ON r.id = q2.review_id
      LEFT JOIN shop_products p ON p.id = r.product_id
      LEFT JOIN shop_sellers s ON s.id = p.seller_id
      LEFT JOIN shop_users u ON u.id = q2.caller_id) t ON t.request_id = q.request_id""")
def jon_2(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    req = shop.review_requests.select("request_id", "review_id", "caller_id")
    return A.authorise_review_deletes(req, shop.reviews, shop.products, shop.sellers, shop.users)


@register("jon_4_authorise_order_access", oracle="""
    SELECT q.request_id, q.order_id, q.caller_id, o.id IS NOT NULL AS found,
           o.id IS NOT NULL AND (o.user_id = q.caller_id OR coalesce(u.role, '') = 'ADMIN') AS allowed
    FROM shop_order_access_requests q
    LEFT JOIN shop_orders o ON o.id = q.order_id
    LEFT JOIN shop_users u ON u.id = q.caller_id""")
def jon_4(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    req = shop.order_access_requests.select("request_id", "order_id", "caller_id")
    return A.authorise_order_access(req, shop.orders, shop.users)


@register("jon_5_existing", oracle="""
    SELECT request_id, email FROM shop_registrations r
    WHERE EXISTS (SELECT 1 FROM shop_users u WHERE u.email = r.email)""")
def jon_5_existing(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.existing(shop.registrations.select("request_id", "email"), shop.users, "email")


@register("jon_5_missing", oracle="""
    SELECT request_id, email FROM shop_registrations r
    WHERE NOT EXISTS (SELECT 1 FROM shop_users u WHERE u.email = r.email)""")
def jon_5_missing(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return A.missing(shop.registrations.select("request_id", "email"), shop.users, "email")


# ----------------------------------------------------------- pricing rules --
@register("prc_1_delivery_fee", oracle="""
    SELECT id, delivery_type,
           CASE WHEN upper(delivery_type) = 'EXPRESS' THEN 9.99
                WHEN upper(delivery_type) = 'SAME_DAY' THEN 19.99 ELSE 0.0 END::DOUBLE AS delivery_fee
    FROM shop_orders""")
def prc_1(spark, sf_dir):
    o = Shop(spark, sf_dir).orders
    return o.select("id", "delivery_type", M.delivery_fee("delivery_type").cast("double")
                    .alias("delivery_fee"))


@register("prc_2_delivery_date", oracle="""
    SELECT id, strftime(CAST(created_at AS DATE)
               + CASE WHEN delivery_type = 'STANDARD' THEN 3 ELSE 1 END, '%Y-%m-%d') AS delivery_date
    FROM shop_orders""")
def prc_2(spark, sf_dir):
    o = Shop(spark, sf_dir).orders
    return o.select("id", F.date_format(M.delivery_date("delivery_type", "created_at"), "yyyy-MM-dd")
                    .alias("delivery_date"))


PROMO_JOIN_SQL = """
    SELECT o.id AS order_id, p.code, o.total, o.created_at, p.discount_type, p.discount_value,
           p.is_active, p.expires_at, p.max_uses, p.uses_count, p.min_order
    FROM shop_orders o JOIN shop_promo_codes p ON p.id = o.promo_id"""


def _orders_with_promo(shop):
    promos = shop.promo_codes.withColumnRenamed("id", "promo_id")
    return shop.orders.join(promos, "promo_id").withColumnRenamed("id", "order_id")


@register("prc_3_promo_is_valid", oracle=f"""
    SELECT order_id, code,
           is_active AND (expires_at IS NULL OR expires_at >= created_at)
             AND (max_uses IS NULL OR uses_count < max_uses) AND total >= min_order AS valid
    FROM ({PROMO_JOIN_SQL}) t""")
def prc_3(spark, sf_dir):
    x = _orders_with_promo(Shop(spark, sf_dir))
    return x.select("order_id", "code", M.promo_is_valid("total", "created_at").alias("valid"))


@register("prc_4_promo_discount", oracle=f"""
    SELECT order_id, code,
           CAST(CASE WHEN discount_type = 'PERCENT' THEN round(total * discount_value * 0.01, 2)
                     ELSE least(discount_value, total) END AS DOUBLE) AS discount
    FROM ({PROMO_JOIN_SQL}) t""")
def prc_4(spark, sf_dir):
    x = _orders_with_promo(Shop(spark, sf_dir))
    return x.select("order_id", "code", M.promo_discount("total").cast("double").alias("discount"))


# A fifth of the stated caps (1000 and 500), so that they bind on these orders.
CAP_SHARE = 5


def _capped(promos):
    return promos.withColumn("max_uses", (F.col("max_uses") / CAP_SHARE).cast("int"))


@register("prc_3_use_cap", oracle=f"""
    SELECT order_id, code, uses_count,
           is_active AND (expires_at IS NULL OR expires_at >= created_at)
             AND (max_uses IS NULL OR uses_count < max_uses // {CAP_SHARE}) AND total >= min_order AS valid
    FROM (SELECT t.* EXCLUDE (uses_count), row_number() OVER (PARTITION BY code ORDER BY created_at, order_id) - 1 AS uses_count
          FROM ({PROMO_JOIN_SQL}) t) u""")
def prc_3_cap(spark, sf_dir):
    """Validity of every order's code at that moment: the uses before it count."""
    from cartograph.operators.pricing import uses_before
    shop = Shop(spark, sf_dir)
    promos = _capped(shop.promo_codes).drop("uses_count").withColumnRenamed("id", "promo_id")
    x = uses_before(shop.orders).join(promos, "promo_id")
    return x.select(F.col("id").alias("order_id"), "code", "uses_count", M.promo_is_valid("total", "created_at").alias("valid"))


# ---------------------------------------------------------- kept rollups --
def _at(spark, name):
    import uuid

    from cartograph.session import checkpoint_dir, temporary
    return temporary(spark, f"{checkpoint_dir(spark).rstrip('/')}/rollups/{name}-{uuid.uuid4().hex}")


_HIDDEN_SQL = """
    ch AS (SELECT review_id, seq,
                  CASE WHEN NOT coalesce(json_valid(body), false) THEN NULL
                       WHEN NOT json_exists(body, '$.hidden') THEN true
                       WHEN lower(json_extract_string(body, '$.hidden')) IN ('true', 'false')
                       THEN CAST(json_extract_string(body, '$.hidden') AS BOOLEAN) END AS v
           FROM shop_hide_changes),
    last AS (SELECT review_id, arg_max(v, seq) AS v FROM ch WHERE v IS NOT NULL GROUP BY review_id),
    rv AS (SELECT rv.product_id, rv.rating FROM shop_reviews rv LEFT JOIN last ON last.review_id = rv.id
           WHERE NOT coalesce(last.v, rv.is_hidden))"""


def _kept_reviews(spark, sf_dir):
    """Changes of the reviews in three batches: all of them as new, then two of
    requests to hide or show some, by the hour they came in."""
    from cartograph.operators import changes as C
    from cartograph.operators import rollups as R
    shop = Shop(spark, sf_dir)
    ok, _ = C.flag_from_body(shop.hide_changes, "hidden")
    half = ok.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("m")).first().m
    yield shop, R.rating_changes(None, shop.reviews)
    before = shop.reviews.select("id", "product_id", "rating", "is_hidden")
    for part in (F.col("seq") <= half, F.col("seq") > half):
        asked = ok.where(part)
        # only the reviews that the batch touches
        touched = before.join(asked.select(F.col("review_id").alias("id")).distinct(), "id", "left_semi")
        after, _ = C.apply_flags(touched, asked, "id", "is_hidden", change_key="review_id")
        yield shop, R.rating_changes(touched, after)
        before = before.join(touched.select("id"), "id", "left_anti").unionByName(after.select(*before.columns))


@register("agg_5_kept_ratings", oracle=f"""
    WITH {_HIDDEN_SQL},
    r AS (SELECT product_id, sum(rating) AS s, count(*) AS n FROM rv GROUP BY product_id)
    SELECT p.id AS product_id, coalesce({_cents_sql('r.s', 'r.n')}, 0.0) AS rating_avg, coalesce(r.n, 0) AS review_count
    FROM shop_products p LEFT JOIN r ON r.product_id = p.id""")
def agg_5_kept(spark, sf_dir):
    """Rating columns kept by deltas over hides and shows, one compaction in between."""
    from cartograph.operators import rollups as R
    table = R.ratings_table(spark, _at(spark, "ratings"))
    for batch, (shop, changes) in enumerate(_kept_reviews(spark, sf_dir)):
        table.append(batch, changes)
        if batch == 1:
            table.compact()
    return R.rating_columns(shop.products, table).select("product_id", _dbl("rating_avg"), "review_count")


@register("agg_6_kept_ratings", oracle=f"""
    WITH {_HIDDEN_SQL},
    r AS (SELECT p.seller_id, sum(rv.rating) AS s, count(*) AS n FROM rv JOIN shop_products p ON p.id = rv.product_id GROUP BY p.seller_id)
    SELECT s.id AS seller_id, coalesce({_cents_sql('r.s', 'r.n')}, 0.0) AS rating_avg, coalesce(r.n, 0) AS review_count
    FROM shop_sellers s LEFT JOIN r ON r.seller_id = s.id""")
def agg_6_kept(spark, sf_dir):
    from cartograph.operators import rollups as R
    table = R.ratings_table(spark, _at(spark, "sellers"), "seller_id")
    for batch, (shop, changes) in enumerate(_kept_reviews(spark, sf_dir)):
        table.append(batch, R.seller_rating_changes(changes, shop.products))
    return R.rating_columns(shop.sellers, table, "seller_id").select("seller_id", _dbl("rating_avg"), "review_count")


# ------------------------------------------------------------ scalar rules --
@register("scl_1_slugify", oracle="""
    SELECT id, CASE WHEN s = '' THEN 'product' ELSE s END AS slug FROM (
      SELECT id, regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'),
                                '^-|-$', '', 'g') AS s
      FROM shop_products) t""")
def scl_1(spark, sf_dir):
    return Shop(spark, sf_dir).products.select("id", T.slugify("description").alias("slug"))


@register("scl_3_split_name", oracle=r"""
    SELECT profile_id,
           CASE WHEN coalesce(n, '') = '' THEN split_part(email, '@', 1) ELSE split_part(n, ' ', 1) END AS first_name,
           CASE WHEN coalesce(strpos(n, ' '), 0) = 0 THEN '' ELSE substr(n, strpos(n, ' ') + 1) END AS last_name
    FROM (SELECT *, regexp_replace(full_name, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS n FROM shop_profiles)""")
def scl_3(spark, sf_dir):
    p = Shop(spark, sf_dir).profiles
    return p.select("profile_id", T.first_name("full_name", "email").alias("first_name"),
                    T.last_name("full_name").alias("last_name"))


@register("scl_4_normalise_email", oracle=r"""
    SELECT profile_id, lower(regexp_replace(email, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS email FROM shop_profiles""")
def scl_4(spark, sf_dir):
    return Shop(spark, sf_dir).profiles.select("profile_id", T.normalise_email("email").alias("email"))


@register("scl_5_shipping_address", oracle="""
    SELECT r.request_id,
           CASE WHEN json_exists(r.shipping_address, '$.name')
                THEN json_extract_string(r.shipping_address, '$.name')
                ELSE u.first_name || ' ' || u.last_name END AS recipient_name,
           CASE WHEN json_exists(r.shipping_address, '$.street')
                THEN json_extract_string(r.shipping_address, '$.street') ELSE 'N/A' END AS address_line1,
           CASE WHEN json_exists(r.shipping_address, '$.city')
                THEN json_extract_string(r.shipping_address, '$.city') ELSE 'N/A' END AS city,
           CASE WHEN json_exists(r.shipping_address, '$.zipCode')
                THEN json_extract_string(r.shipping_address, '$.zipCode') ELSE '00000' END AS postal_code,
           'US' AS country
    FROM shop_order_requests r JOIN shop_users u ON u.id = r.user_id""")
def scl_5(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    u = shop.users.select(F.col("id").alias("user_id"),
                          F.concat_ws(" ", "first_name", "last_name").alias("_full"))
    x = shop.order_requests.join(u, "user_id")
    return x.select("request_id", M.shipping_address("shipping_address", "_full").alias("a")) \
        .select("request_id", "a.*")


@register("scl_6_parse_enum", oracle="""
    SELECT request_id, upper(delivery_type) AS delivery_type,
           coalesce(upper(delivery_type) IN ('STANDARD', 'EXPRESS'), false) AS valid
    FROM shop_order_requests""")
def scl_6(spark, sf_dir):
    from cartograph.operators.changes import parse_enum
    ok, bad = parse_enum(Shop(spark, sf_dir).order_requests.select("request_id", "delivery_type"),
                         "delivery_type", M.DELIVERY_TYPES)
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.select(
        "request_id", F.upper("delivery_type").alias("delivery_type"), F.lit(False).alias("valid")))


@register("prc_5_quote_promos", oracle="""
    SELECT r.request_id, r.code,
           CASE WHEN upper(r.code) IN ('BABY10', 'FREESHIP', 'WELCOME20') THEN upper(r.code) END
               AS quoted_code,
           CAST(CASE upper(r.code) WHEN 'BABY10' THEN 10 WHEN 'FREESHIP' THEN 9.99
                                   WHEN 'WELCOME20' THEN 20 END AS DOUBLE) AS discount,
           CASE upper(r.code) WHEN 'FREESHIP' THEN 'FIXED' WHEN 'BABY10' THEN 'PERCENT'
                              WHEN 'WELCOME20' THEN 'PERCENT' END AS discount_type,
           coalesce(upper(r.code) IN ('BABY10', 'FREESHIP', 'WELCOME20'), false) AS valid
    FROM shop_promo_requests r""")
def prc_5(spark, sf_dir):
    from cartograph.operators.pricing import quote_promos
    req = Shop(spark, sf_dir).promo_requests.select("request_id", "code")
    return quote_promos(req, strict=False).select(
        "request_id", "code", "quoted_code", _dbl("discount"), "discount_type", "valid")


AS_OF_PROMO = "1998-06-30 00:00:00"


@register("prc_5_quote_promos_used", oracle=f"""
    WITH u AS (SELECT promo_id, count(*) AS uses FROM shop_orders WHERE promo_id IS NOT NULL AND created_at <= TIMESTAMP '{AS_OF_PROMO}'
               GROUP BY promo_id),
    x AS (
      SELECT r.request_id, r.code, r.subtotal, p.code AS quoted_code, p.discount_type,
             coalesce(p.is_active AND (p.expires_at IS NULL OR p.expires_at >= TIMESTAMP '{AS_OF_PROMO}')
                      AND (p.max_uses IS NULL OR coalesce(u.uses, 0) < p.max_uses // {CAP_SHARE})
                      AND r.subtotal >= p.min_order, false) AS valid,
             p.discount_value
      FROM shop_promo_requests r LEFT JOIN shop_promo_codes p ON lower(r.code) = lower(p.code) LEFT JOIN u ON u.promo_id = p.id)
    SELECT request_id, code, quoted_code,
           CAST(CASE WHEN valid THEN CASE WHEN discount_type = 'PERCENT'
                                          THEN round(subtotal * discount_value * 0.01, 2)
                                          ELSE least(discount_value, subtotal) END END AS DOUBLE) AS discount,
           discount_type, valid
    FROM x""")
def prc_5_used(spark, sf_dir):
    """Strict quotes under the uses that a kept rollup has counted, a batch of orders per year."""
    from cartograph.operators import rollups as R
    from cartograph.operators.common import ts_lit
    from cartograph.operators.pricing import quote_promos
    shop = Shop(spark, sf_dir)
    table = R.uses_table(spark, _at(spark, "uses"))
    due = shop.orders.where(F.col("created_at") <= ts_lit(AS_OF_PROMO)).select("promo_id", "created_at")
    for batch, part in enumerate((F.year("created_at") < 1996, F.year("created_at") >= 1996)):
        table.append(batch, R.use_changes(None, due.where(part)))
    promos = R.with_uses(_capped(shop.promo_codes), table.current())
    req = shop.promo_requests.select("request_id", "code", "subtotal")
    return quote_promos(req, promos, strict=True, as_of=AS_OF_PROMO).select(
        "request_id", "code", "quoted_code", _dbl("discount"), "discount_type", "valid")


@register("prc_5_quote_promos_strict", oracle=f"""
    WITH x AS (
      SELECT r.request_id, r.code, r.subtotal, p.code AS quoted_code, p.discount_type,
             coalesce(p.is_active AND (p.expires_at IS NULL OR p.expires_at >= TIMESTAMP '{AS_OF_PROMO}')
                      AND (p.max_uses IS NULL OR p.uses_count < p.max_uses)
                      AND r.subtotal >= p.min_order, false) AS valid,
             p.discount_value
      FROM shop_promo_requests r LEFT JOIN shop_promo_codes p ON lower(r.code) = lower(p.code))
    SELECT request_id, code, quoted_code,
           CAST(CASE WHEN valid THEN CASE WHEN discount_type = 'PERCENT'
                                          THEN round(subtotal * discount_value * 0.01, 2)
                                          ELSE least(discount_value, subtotal) END END AS DOUBLE) AS discount,
           discount_type, valid
    FROM x""")
def prc_5_strict(spark, sf_dir):
    from cartograph.operators.pricing import quote_promos
    shop = Shop(spark, sf_dir)
    req = shop.promo_requests.select("request_id", "code", "subtotal")
    return quote_promos(req, shop.promo_codes, strict=True, as_of=AS_OF_PROMO).select(
        "request_id", "code", "quoted_code", _dbl("discount"), "discount_type", "valid")
