"""Audit queries over the shop tables: the reference's constraints (DQ-1..8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartograph.functions import money as M
from cartograph.operators import analytics as A
from cartograph.operators import quality as Q
from cartograph.plans.registry import register
from cartograph.sources.shop import Shop
from cartograph.sources.tables import load_table

# NOT NULL columns of the products and users tables (fixed by the schema).
PRODUCT_NOT_NULL = ["seller_id", "category_id", "name", "slug", "price", "stock_qty",
                    "low_stock_threshold", "images", "is_featured", "is_active", "status",
                    "rating_avg", "review_count", "created_at"]
USER_NOT_NULL = ["email", "first_name", "last_name", "role", "email_verified", "is_suspended"]


def _nn_sql(table, cols):
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, 'not_null:{c}' AS rule, CAST(id AS VARCHAR) AS key, "
        f"CAST(NULL AS VARCHAR) AS value FROM {table} WHERE {c} IS NULL" for c in cols)


@register("dq_1_not_null", oracle=_nn_sql("shop_products", PRODUCT_NOT_NULL) + "\nUNION ALL "
          + _nn_sql("shop_users", USER_NOT_NULL))
def dq_1(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return Q.stack_violations(Q.not_null(shop.products, "shop_products", PRODUCT_NOT_NULL),
                              Q.not_null(shop.users, "shop_users", USER_NOT_NULL))


@register("dq_2_check", oracle="""
    SELECT 'shop_reviews' AS table_name, 'check:rating_1_5' AS rule, CAST(id AS VARCHAR) AS key,
           CAST(rating AS VARCHAR) AS value FROM shop_reviews WHERE NOT (rating BETWEEN 1 AND 5)
    UNION ALL
    SELECT 'shop_cart_items', 'check:quantity_positive',
           CAST(cart_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR), CAST(quantity AS VARCHAR)
    FROM shop_cart_items WHERE NOT (quantity > 0)
    UNION ALL
    SELECT 'shop_order_items', 'check:quantity_positive',
           CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR), CAST(quantity AS VARCHAR)
    FROM shop_order_items WHERE NOT (quantity > 0)
    UNION ALL
    SELECT 'shop_carts', 'check:cart_owner', CAST(id AS VARCHAR), NULL FROM shop_carts
    WHERE NOT (user_id IS NOT NULL)
    UNION ALL
    SELECT 'shop_products', 'check:stock_not_negative', CAST(id AS VARCHAR),
           CAST(stock_qty AS VARCHAR) FROM shop_products WHERE NOT (stock_qty >= 0)
    UNION ALL
    SELECT 'shop_cart_events', 'check:quantity_positive', CAST(seq AS VARCHAR),
           CAST(quantity AS VARCHAR) FROM shop_cart_events WHERE NOT (quantity > 0)""")
def dq_2(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return Q.stack_violations(
        Q.check(shop.reviews, "shop_reviews", "rating_1_5", F.col("rating").between(1, 5),
                value=F.col("rating")),
        Q.check(shop.cart_items, "shop_cart_items", "quantity_positive", F.col("quantity") > 0,
                key=["cart_id", "product_id"], value=F.col("quantity")),
        Q.check(shop.order_items, "shop_order_items", "quantity_positive", F.col("quantity") > 0,
                key=["order_id", "line_no"], value=F.col("quantity")),
        Q.check(shop.carts, "shop_carts", "cart_owner", F.col("user_id").isNotNull()),
        Q.check(shop.products, "shop_products", "stock_not_negative", F.col("stock_qty") >= 0,
                value=F.col("stock_qty")),
        Q.check(shop.cart_events, "shop_cart_events", "quantity_positive", F.col("quantity") > 0,
                key="seq", value=F.col("quantity")))


def _uniq_sql(table, keys):
    k = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    g = ", ".join(keys)
    return (f"SELECT '{table}' AS table_name, 'unique:{','.join(keys)}' AS rule, {k} AS key, "
            f"CAST(count(*) AS VARCHAR) AS value FROM {table} WHERE {nn} GROUP BY {g} "
            f"HAVING count(*) > 1")


UNIQUE_RULES = [("shop_users", ["email"]), ("shop_products", ["slug"]), ("shop_products", ["sku"]),
                ("shop_reviews", ["user_id", "product_id", "order_id"]),
                ("shop_wishlists", ["user_id", "product_id"]),
                ("shop_helpful_votes", ["user_id", "review_id"]),
                ("shop_search_events", ["user_id", "query"]),
                ("shop_cart_items", ["cart_id", "product_id"])]


@register("dq_3_unique", oracle="\nUNION ALL ".join(_uniq_sql(t, k) for t, k in UNIQUE_RULES))
def dq_3(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return Q.stack_violations(*[Q.unique(shop[t], t, k) for t, k in UNIQUE_RULES])


FK_RULES = [("shop_reviews", "product_id", "shop_products", "id"),
            ("shop_reviews", "order_id", "shop_orders", "id"),
            ("shop_reviews", "user_id", "shop_users", "id"),
            ("shop_products", "seller_id", "shop_sellers", "id"),
            ("shop_products", "category_id", "shop_categories", "id"),
            ("shop_order_items", "product_id", "shop_products", "id"),
            ("shop_order_items", "order_id", "shop_orders", "id"),
            ("shop_orders", "user_id", "shop_users", "id"),
            ("shop_orders", "promo_id", "shop_promo_codes", "id"),
            ("shop_wishlists", "product_id", "shop_products", "id"),
            ("shop_helpful_votes", "review_id", "shop_reviews", "id"),
            ("shop_helpful_votes", "user_id", "shop_users", "id"),
            ("shop_carts", "user_id", "shop_users", "id"),
            ("shop_cart_items", "cart_id", "shop_carts", "id"),
            ("shop_cart_items", "product_id", "shop_products", "id"),
            ("shop_sellers", "user_id", "shop_users", "id"),
            ("shop_status_updates", "order_id", "shop_orders", "id"),
            ("shop_status_updates", "changed_by", "shop_users", "id"),
            ("shop_wishlists", "user_id", "shop_users", "id"),
            ("shop_search_events", "user_id", "shop_users", "id"),
            ("shop_tokens_issued", "user_id", "shop_users", "id"),
            ("shop_support_tickets", "user_id", "shop_users", "id"),
            ("shop_support_tickets", "order_id", "shop_orders", "id"),
            ("shop_support_messages", "ticket_id", "shop_support_tickets", "id"),
            ("shop_support_messages", "sender_id", "shop_users", "id"),
            ("shop_product_variants", "product_id", "shop_products", "id"),
            ("shop_payouts", "seller_id", "shop_sellers", "id"),
            ("shop_app_feedback", "user_id", "shop_users", "id")]
FK_KEYS = {"shop_cart_items": ["src_order", "line_no"], "shop_status_updates": ["request_id"],
           "shop_order_items": ["order_id", "line_no"], "shop_wishlists": ["user_id", "product_id"],
           "shop_helpful_votes": ["user_id", "review_id"], "shop_search_events": ["event_id"],
           "shop_tokens_issued": ["token_id"]}


def _fk_sql(child, fk, parent, pk):
    key = FK_KEYS.get(child, ["id"])
    k = " || '|' || ".join(f"CAST(c.{c} AS VARCHAR)" for c in key)
    return (f"SELECT '{child}' AS table_name, 'fk:{fk}->{parent}' AS rule, {k} AS key, "
            f"CAST(c.{fk} AS VARCHAR) AS value FROM {child} c WHERE c.{fk} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})")


@register("dq_4_orphans", oracle="\nUNION ALL ".join(_fk_sql(*r) for r in FK_RULES))
def dq_4(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    parents: dict[str, list] = {}
    for c, fk, p, _ in FK_RULES:
        parents.setdefault(p, []).append((shop[c], c, fk, FK_KEYS.get(c, "id")))
    return Q.stack_violations(*[Q.orphans_of(shop[p], p, children) for p, children in parents.items()])


DOMAIN_RULES = [("shop_orders", "status", M.ORDER_STATUSES),
                ("shop_orders", "delivery_type", M.DELIVERY_TYPES),
                ("shop_products", "status", M.PRODUCT_STATUSES),
                ("shop_users", "role", M.USER_ROLES),
                ("shop_promo_codes", "discount_type", M.DISCOUNT_TYPES),
                ("shop_status_updates", "status", M.ORDER_STATUSES)]
DOMAIN_KEYS = {"shop_status_updates": "request_id"}


def _dom_sql(t, c, values):
    vs = ", ".join(f"'{v}'" for v in values)
    k = DOMAIN_KEYS.get(t, "id")
    return (f"SELECT '{t}' AS table_name, 'domain:{c}' AS rule, CAST({k} AS VARCHAR) AS key, "
            f"{c} AS value FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN ({vs})")


@register("dq_5_domain", oracle="\nUNION ALL ".join(_dom_sql(*r) for r in DOMAIN_RULES))
def dq_5(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return Q.stack_violations(*[Q.domain(shop[t], t, c, v, key=DOMAIN_KEYS.get(t, "id")) for t, c, v in DOMAIN_RULES])


LENGTH_RULES = [("shop_users", "email", 255), ("shop_users", "first_name", 100),
                ("shop_users", "last_name", 100), ("shop_users", "phone", 30),
                ("shop_products", "name", 255), ("shop_products", "slug", 255),
                ("shop_products", "sku", 100), ("shop_reviews", "title", 255),
                ("shop_search_events", "query", 255), ("shop_sellers", "store_name", 255),
                ("shop_categories", "slug", 100), ("shop_reviews", "text", 5000)]
LENGTH_KEYS = {"shop_search_events": "event_id"}


def _len_sql(t, c, n):
    k = LENGTH_KEYS.get(t, "id")
    return (f"SELECT '{t}' AS table_name, 'length:{c}>{n}' AS rule, CAST({k} AS VARCHAR) AS key, "
            f"CAST(length({c}) AS VARCHAR) AS value FROM {t} WHERE length({c}) > {n}")


@register("dq_6_max_length", oracle="\nUNION ALL ".join(_len_sql(*r) for r in LENGTH_RULES))
def dq_6(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return Q.stack_violations(*[Q.max_length(shop[t], t, c, n, key=LENGTH_KEYS.get(t, "id"))
                                for t, c, n in LENGTH_RULES])


DECIMAL_RULES = [("orders", "o_totalprice", 10, 2, "o_orderkey"),
                 ("part", "p_retailprice", 10, 2, "p_partkey"),
                 ("customer", "c_acctbal", 10, 2, "c_custkey"),
                 ("lineitem", "l_extendedprice", 10, 2, "l_orderkey"),
                 # a narrower column than the tables have, which large orders overflow
                 ("orders", "o_totalprice", 7, 2, "o_orderkey")]


def _dec_sql(t, c, p, s, k):
    return (f"SELECT '{t}' AS table_name, 'decimal:{c}({p},{s})' AS rule, CAST({k} AS VARCHAR) AS key,"
            f" CAST(CAST({c} AS DECIMAL(20,2)) AS VARCHAR) AS value FROM {t} "
            f"WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS DECIMAL(20,2)) AS DECIMAL({p},{s})) IS NULL")


@register("dq_7_decimal_fit", oracle="\nUNION ALL ".join(_dec_sql(*r) for r in DECIMAL_RULES))
def dq_7(spark, sf_dir):
    return Q.stack_violations(*[
        Q.decimal_fit(load_table(spark, sf_dir, t).select(k, F.col(c).cast("decimal(20,2)").alias(c)),
                      t, c, p, s, key=k)
        for t, c, p, s, k in DECIMAL_RULES])


@register("dq_8_drift", oracle="""
    WITH r AS (SELECT product_id, sum(rating) AS s, count(*) AS n FROM shop_reviews
               WHERE NOT is_hidden GROUP BY product_id),
    rec AS (SELECT p.id, CAST(coalesce(CAST(floor((CAST(r.s AS DOUBLE) * 200 + r.n) / (r.n * 2))
                                              AS DOUBLE) / 100, 0) AS DECIMAL(3,2)) AS rating_avg,
                   coalesce(r.n, 0) AS review_count
            FROM shop_products p LEFT JOIN r ON r.product_id = p.id),
    uses AS (SELECT promo_id, count(*) AS n FROM shop_orders WHERE promo_id IS NOT NULL GROUP BY 1),
    sr AS (SELECT s.id, coalesce(t.n, 0) AS n,
                  CAST(coalesce(CAST(floor((CAST(t.s AS DOUBLE) * 200 + t.n) / (t.n * 2)) AS DOUBLE) / 100, 0)
                       AS DECIMAL(3,2)) AS rating_avg
           FROM shop_sellers s LEFT JOIN (SELECT p.seller_id, sum(r.s) AS s, sum(r.n) AS n FROM r
             JOIN shop_products p ON p.id = r.product_id GROUP BY 1) t ON t.seller_id = s.id),
    votes AS (SELECT review_id, count(DISTINCT user_id) AS n FROM shop_helpful_votes GROUP BY 1)
    SELECT 'shop_products' AS table_name, 'drift:rating_avg' AS rule, CAST(p.id AS VARCHAR) AS key,
           CAST(p.rating_avg AS VARCHAR) || ' != ' || CAST(rec.rating_avg AS VARCHAR) AS value
    FROM shop_products p JOIN rec ON rec.id = p.id WHERE p.rating_avg <> rec.rating_avg
    UNION ALL
    SELECT 'shop_products', 'drift:review_count', CAST(p.id AS VARCHAR),
           CAST(p.review_count AS VARCHAR) || ' != ' || CAST(rec.review_count AS VARCHAR)
    FROM shop_products p JOIN rec ON rec.id = p.id WHERE p.review_count <> rec.review_count
    UNION ALL
    SELECT 'shop_promo_codes', 'drift:uses_count', CAST(c.id AS VARCHAR),
           CAST(c.uses_count AS VARCHAR) || ' != ' || coalesce(CAST(u.n AS VARCHAR), 'null')
    FROM shop_promo_codes c LEFT JOIN uses u ON u.promo_id = c.id
    WHERE u.n IS NULL OR c.uses_count <> u.n
    UNION ALL
    SELECT 'shop_sellers', 'drift:rating_avg', CAST(s.id AS VARCHAR),
           CAST(s.rating_avg AS VARCHAR) || ' != ' || CAST(sr.rating_avg AS VARCHAR)
    FROM shop_sellers s JOIN sr ON sr.id = s.id WHERE s.rating_avg <> sr.rating_avg
    UNION ALL
    SELECT 'shop_sellers', 'drift:review_count', CAST(s.id AS VARCHAR),
           CAST(s.review_count AS VARCHAR) || ' != ' || CAST(sr.n AS VARCHAR)
    FROM shop_sellers s JOIN sr ON sr.id = s.id WHERE s.review_count <> sr.n
    UNION ALL
    SELECT 'shop_reviews', 'drift:helpful_votes', CAST(r.id AS VARCHAR),
           CAST(r.helpful_votes AS VARCHAR) || ' != ' || coalesce(CAST(v.n AS VARCHAR), 'null')
    FROM shop_reviews r LEFT JOIN votes v ON v.review_id = r.id
    WHERE v.n IS NULL OR r.helpful_votes <> v.n""")
def dq_8(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    rec = A.product_ratings(shop.products, shop.reviews).withColumnRenamed("product_id", "id") \
        .withColumn("review_count", F.col("review_count").cast("int"))
    uses = A.promo_uses(shop.orders).withColumnRenamed("promo_id", "id") \
        .withColumn("uses_count", F.col("uses_count").cast("int"))
    sellers = A.seller_ratings(shop.sellers, shop.products, shop.reviews).withColumnRenamed("seller_id", "id") \
        .withColumn("review_count", F.col("review_count").cast("int"))
    votes = A.helpful_votes(shop.helpful_votes).withColumnRenamed("review_id", "id") \
        .withColumn("helpful_votes", F.col("helpful_votes").cast("int"))
    return Q.stack_violations(
        Q.drift(shop.products, rec, "shop_products", ["id"], ["rating_avg", "review_count"]),
        Q.drift(shop.promo_codes, uses, "shop_promo_codes", ["id"], ["uses_count"]),
        Q.drift(shop.sellers, sellers, "shop_sellers", ["id"], ["rating_avg", "review_count"]),
        Q.drift(shop.reviews, votes, "shop_reviews", ["id"], ["helpful_votes"]))
