"""Bulk change jobs over request batches derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartograph.functions import text as T
from cartograph.operators import changes as C
from cartograph.operators.analytics import authorise_review_deletes
from cartograph.operators.tokens import match_tokens
from cartograph.plans.registry import register
from cartograph.sources.shop import Shop

AS_OF_CHECKOUT = "2024-02-01 00:00:00"
NEVER = C.NEVER


def _dbl(c, name=None):
    return F.col(c).cast("double").alias(name or c)


def _place(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.place_orders(shop.carts, shop.cart_items, shop.products, shop.users,
                          shop.order_requests, AS_OF_CHECKOUT, shop.orders)


NEW_ORDER_SQL = """(SELECT max(id) FROM shop_orders) + 1 + d.request_id
           - (SELECT min(request_id) FROM shop_order_requests)"""

CHECKOUT_SQL = """
    WITH req AS (
      SELECT r.*, upper(coalesce(r.delivery_type, 'STANDARD')) AS dt,
             coalesce(upper(coalesce(r.delivery_type, 'STANDARD')) IN ('STANDARD', 'EXPRESS'), false)
               AS valid
      FROM shop_order_requests r),
    cart AS (
      SELECT c.id AS cart_id, c.user_id, count(i.product_id) AS n_lines,
             sum(i.unit_price * i.quantity) AS subtotal
      FROM shop_carts c LEFT JOIN shop_cart_items i ON i.cart_id = c.id GROUP BY c.id, c.user_id),
    win AS (SELECT user_id, min(seq) AS win_seq FROM req WHERE valid GROUP BY user_id),
    decided AS (
      SELECT req.*, cart.cart_id, cart.subtotal,
             CASE WHEN cart.cart_id IS NULL THEN 'CART_NOT_FOUND'
                  WHEN coalesce(cart.n_lines, 0) = 0 THEN 'CART_EMPTY'
                  WHEN req.seq > win.win_seq THEN 'CART_EMPTY'
                  WHEN NOT req.valid THEN 'INVALID_DELIVERY_TYPE' END AS reason
      FROM req LEFT JOIN cart ON cart.user_id = req.user_id
      LEFT JOIN win ON win.user_id = req.user_id)"""


@register("chg_1_place_orders", bench=True, oracle=CHECKOUT_SQL + f"""
    SELECT {NEW_ORDER_SQL} AS id, d.user_id, d.cart_id, CAST(d.subtotal AS DOUBLE) AS subtotal,
           CAST(CASE WHEN d.dt = 'EXPRESS' THEN 9.99 ELSE 0 END AS DOUBLE) AS delivery_fee,
           CAST(d.subtotal + CASE WHEN d.dt = 'EXPRESS' THEN 9.99 ELSE 0 END AS DOUBLE) AS total,
           d.dt AS delivery_type, 'CONFIRMED' AS status,
           strftime(DATE '2024-02-01' + CASE WHEN d.dt = 'STANDARD' THEN 3 ELSE 1 END, '%Y-%m-%d')
               AS estimated_delivery_date,
           CASE WHEN json_exists(d.shipping_address, '$.name')
                THEN json_extract_string(d.shipping_address, '$.name')
                ELSE u.first_name || ' ' || u.last_name END AS recipient_name,
           CASE WHEN json_exists(d.shipping_address, '$.city')
                THEN json_extract_string(d.shipping_address, '$.city') ELSE 'N/A' END AS city
    FROM decided d LEFT JOIN shop_users u ON u.id = d.user_id WHERE d.reason IS NULL""")
def chg_1_orders(spark, sf_dir):
    orders = _place(spark, sf_dir)[0]
    return orders.select("id", "user_id", "cart_id", _dbl("subtotal"), _dbl("delivery_fee"),
                         _dbl("total"), "delivery_type", "status",
                         F.date_format("estimated_delivery_date", "yyyy-MM-dd")
                         .alias("estimated_delivery_date"),
                         F.col("address.recipient_name").alias("recipient_name"),
                         F.col("address.city").alias("city"))


@register("chg_1_order_items", oracle=CHECKOUT_SQL + f"""
    SELECT {NEW_ORDER_SQL} AS order_id, i.product_id, coalesce(p.name, 'Unknown Product') AS product_name,
           i.quantity, CAST(i.unit_price AS DOUBLE) AS unit_price
    FROM decided d JOIN shop_cart_items i ON i.cart_id = d.cart_id
    LEFT JOIN shop_products p ON p.id = i.product_id WHERE d.reason IS NULL""")
def chg_1_items(spark, sf_dir):
    return _place(spark, sf_dir)[1].select("order_id", "product_id", "product_name", "quantity",
                                           _dbl("unit_price"))


@register("chg_1_stock_after", oracle=CHECKOUT_SQL + """,
    sold AS (SELECT i.product_id, sum(i.quantity) AS q FROM decided d
             JOIN shop_cart_items i ON i.cart_id = d.cart_id WHERE d.reason IS NULL GROUP BY 1)
    SELECT p.id, CAST(greatest(0, p.stock_qty - coalesce(sold.q, 0)) AS INT) AS stock_qty
    FROM shop_products p LEFT JOIN sold ON sold.product_id = p.id""")
def chg_1_stock(spark, sf_dir):
    return _place(spark, sf_dir)[2].select("id", "stock_qty")


@register("chg_1_rejects", oracle=CHECKOUT_SQL + """
    SELECT request_id, user_id, reason FROM decided WHERE reason IS NOT NULL""")
def chg_1_rejects(spark, sf_dir):
    return _place(spark, sf_dir)[4]


@register("chg_2_cancel_orders", oracle="""
    WITH acc AS (
      SELECT q.request_id, q.seq, q.order_id, q.caller_id, o.status, o.id IS NOT NULL AS found,
             o.id IS NOT NULL AND (o.user_id = q.caller_id OR coalesce(u.role, '') = 'ADMIN') AS allowed
      FROM shop_order_access_requests q LEFT JOIN shop_orders o ON o.id = q.order_id
      LEFT JOIN shop_users u ON u.id = q.caller_id),
    f AS (SELECT order_id, min(seq) AS first_seq FROM acc WHERE allowed GROUP BY order_id)
    SELECT a.request_id, a.order_id, a.caller_id,
           CASE WHEN NOT a.found THEN 'NOT_FOUND' WHEN NOT a.allowed THEN 'FORBIDDEN'
                WHEN a.seq = f.first_seq AND a.status IN ('CONFIRMED', 'PROCESSING') THEN 'CANCELLED'
                ELSE 'CONFLICT' END AS outcome,
           CASE WHEN NOT a.found OR NOT a.allowed THEN NULL
                WHEN a.seq = f.first_seq AND a.status IN ('CONFIRMED', 'PROCESSING') THEN NULL
                WHEN a.status IN ('CONFIRMED', 'PROCESSING') AND a.seq > f.first_seq THEN 'CANCELLED'
                ELSE a.status END AS blocking_status
    FROM acc a LEFT JOIN f ON f.order_id = a.order_id""")
def chg_2(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.cancel_orders(shop.orders, shop.users, shop.order_access_requests)[1]


STATUS_SQL = """
    WITH ok AS (SELECT r.order_id, upper(r.status) AS status, r.seq FROM shop_status_updates r
                WHERE upper(r.status) IN ('CONFIRMED', 'PROCESSING', 'SHIPPED', 'OUT_FOR_DELIVERY',
                                          'DELIVERED', 'CANCELLED')
                  AND r.order_id IN (SELECT id FROM shop_orders)),
    last AS (SELECT order_id, arg_max(status, seq) AS new_status FROM ok GROUP BY order_id)"""


@register("chg_3_set_status", oracle=STATUS_SQL + """
    SELECT o.id, coalesce(last.new_status, o.status) AS status
    FROM shop_orders o LEFT JOIN last ON last.order_id = o.id""")
def chg_3(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.set_status(shop.orders, shop.status_updates)[0].select("id", "status")


@register("chg_3_rejects", oracle="""
    SELECT request_id, order_id, 'invalid status' AS reason FROM shop_status_updates
    WHERE NOT coalesce(upper(status) IN ('CONFIRMED', 'PROCESSING', 'SHIPPED', 'OUT_FOR_DELIVERY',
                                         'DELIVERED', 'CANCELLED'), false)
    UNION ALL
    SELECT request_id, order_id, 'order not found' AS reason FROM shop_status_updates
    WHERE upper(status) IN ('CONFIRMED', 'PROCESSING', 'SHIPPED', 'OUT_FOR_DELIVERY', 'DELIVERED',
                            'CANCELLED')
      AND order_id NOT IN (SELECT id FROM shop_orders)""")
def chg_3_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.set_status(shop.orders, shop.status_updates)[1]


CART_SQL = f"""
    WITH ev AS (
      SELECT seq, cart_id, product_id, lower(action) AS action, quantity, price,
             CASE WHEN NOT coalesce(lower(action) IN ('add', 'set', 'remove', 'clear'), false) THEN 'INVALID_ACTION'
                  WHEN cart_id IS NULL THEN 'CART_NOT_FOUND'
                  WHEN lower(action) <> 'clear' AND NOT coalesce(product_id IN (SELECT id FROM shop_products), false)
                    THEN 'PRODUCT_NOT_FOUND'
                  WHEN lower(action) IN ('add', 'set') AND NOT coalesce(quantity > 0, false)
                    THEN 'INVALID_QUANTITY' END AS pre
      FROM shop_cart_events
      UNION ALL
      SELECT CAST({NEVER} AS BIGINT), cart_id, product_id, 'add', CAST(sum(quantity) AS INT), min(unit_price), NULL
      FROM shop_cart_items GROUP BY cart_id, product_id),
    a AS (SELECT *, CASE WHEN pre IS NULL AND action = 'clear' THEN seq END AS cl,
                 CASE WHEN pre IS NULL AND action = 'remove' THEN seq END AS rm,
                 CASE WHEN pre IS NULL AND action = 'add' THEN seq END AS ad FROM ev),
    b AS (SELECT *, coalesce(max(cl) OVER (PARTITION BY cart_id ORDER BY seq), {NEVER - 1}) AS cleared,
                 coalesce(max(cl) OVER (PARTITION BY cart_id), {NEVER - 1}) AS last_clear FROM a),
    c AS (SELECT *, coalesce(max(ad) OVER w > greatest(coalesce(max(rm) OVER w, {NEVER - 1}), cleared), false) AS held,
                 greatest(coalesce(max(rm) OVER (PARTITION BY cart_id, product_id), {NEVER - 1}), last_clear) AS kill
          FROM b WINDOW w AS (PARTITION BY cart_id, product_id ORDER BY seq
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, CASE WHEN pre IS NULL AND action IN ('set', 'remove') AND NOT held THEN 'LINE_NOT_FOUND'
                         ELSE pre END AS reason FROM c),
    e AS (SELECT *, max(CASE WHEN reason IS NULL AND action = 'set' AND seq > kill THEN seq END)
                      OVER (PARTITION BY cart_id, product_id) AS last_set FROM d)"""


@register("chg_4_fold_cart", oracle=CART_SQL + """
    SELECT cart_id, product_id,
           CAST(sum(CASE WHEN last_set IS NULL OR seq >= last_set THEN quantity END) AS INT) AS quantity,
           CAST(arg_min(price, seq) FILTER (WHERE action = 'add') AS DOUBLE) AS unit_price
    FROM e WHERE reason IS NULL AND seq > kill AND action IN ('add', 'set') GROUP BY cart_id, product_id""")
def chg_4(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    items, _ = C.fold_cart(shop.cart_items, shop.cart_events, products=shop.products)
    return items.select("cart_id", "product_id", "quantity", _dbl("unit_price"))


@register("chg_4_rejects", oracle=CART_SQL + """
    SELECT seq, cart_id, product_id, action, reason FROM e WHERE reason IS NOT NULL""")
def chg_4_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.fold_cart(shop.cart_items, shop.cart_events, products=shop.products)[1]


@register("chg_4_outcomes", oracle="""
    SELECT seq, count(*) AS outcomes FROM shop_cart_events GROUP BY seq""")
def chg_4_outcomes(spark, sf_dir):
    """Every cart event exactly once among those in effect and the rejects."""
    shop = Shop(spark, sf_dir)
    x = C.judge_cart_events(shop.cart_items, shop.cart_events, shop.products).where(~F.col("_stored"))
    _, rejects = C.fold_cart(shop.cart_items, shop.cart_events, products=shop.products)
    return x.where(F.col("reason").isNull()).select("seq").unionByName(rejects.select("seq")) \
        .groupBy("seq").agg(F.count(F.lit(1)).alias("outcomes"))


@register("chg_5_apply_flags", oracle="""
    WITH last AS (SELECT user_id, arg_max(value, seq) AS v FROM shop_flag_changes GROUP BY user_id)
    SELECT u.id, coalesce(last.v, u.is_suspended) AS is_suspended
    FROM shop_users u LEFT JOIN last ON last.user_id = u.id""")
def chg_5(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    out, _ = C.apply_flags(shop.users, shop.flag_changes, "id", "is_suspended",
                           change_key="user_id")
    return out.select("id", "is_suspended")


@register("chg_5_verify_emails", oracle="""
    SELECT q.request_id, q.caller_email,
           CASE WHEN u.id IS NULL THEN 'USER_NOT_FOUND' WHEN u.email_verified THEN 'ALREADY_VERIFIED'
                ELSE 'VERIFIED' END AS outcome
    FROM shop_product_requests q LEFT JOIN shop_users u ON u.email = q.caller_email""")
def chg_5_verify(spark, sf_dir):
    """Outcome of the callers' requests to confirm their e-mail."""
    shop = Shop(spark, sf_dir)
    return C.verify_emails(shop.users, shop.product_requests.select("request_id", "caller_email"))[1]


@register("chg_5_verified_users", oracle="""
    SELECT id, email_verified OR email IN (SELECT caller_email FROM shop_product_requests) AS email_verified
    FROM shop_users""")
def chg_5_verified(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.verify_emails(shop.users, shop.product_requests.select("request_id", "caller_email"))[0] \
        .select("id", "email_verified")


def _patch_sql(key, col):
    return (f"CASE WHEN max(seq) FILTER (WHERE json_exists(b, '$.{key}')) IS NULL THEN NULL "
            f"ELSE struct_extract(arg_max({{'v': json_extract_string(b, '$.{key}')}}, seq) "
            f"FILTER (WHERE json_exists(b, '$.{key}')), 'v') END AS {col}, "
            f"max(seq) FILTER (WHERE json_exists(b, '$.{key}')) IS NOT NULL AS has_{col}")


PATCH_SQL = """
    WITH x AS (SELECT q.*, CASE WHEN json_valid(body) THEN body END AS b FROM shop_profile_patches q),
    y AS (SELECT x.*, CASE WHEN x.user_id NOT IN (SELECT id FROM shop_users) THEN 'UNKNOWN_KEY'
                           WHEN b IS NULL THEN 'UNREADABLE_BODY'
                           WHEN json_exists(b, '$.firstName') AND json_extract_string(b, '$.firstName') IS NULL
                             THEN 'NULL_NOT_ALLOWED'
                           WHEN json_exists(b, '$.lastName') AND json_extract_string(b, '$.lastName') IS NULL
                             THEN 'NULL_NOT_ALLOWED' END AS reason FROM x)"""


@register("chg_6_apply_patches", oracle=PATCH_SQL + f""",
    p AS (SELECT user_id, {_patch_sql('firstName', 'first_name')},
                      {_patch_sql('lastName', 'last_name')}, {_patch_sql('phone', 'phone')},
                      {_patch_sql('avatarUrl', 'avatar_url')}
               FROM y WHERE reason IS NULL GROUP BY user_id)
    SELECT u.id,
           CASE WHEN coalesce(p.has_first_name, false) THEN p.first_name ELSE u.first_name END AS first_name,
           CASE WHEN coalesce(p.has_last_name, false) THEN p.last_name ELSE u.last_name END AS last_name,
           CASE WHEN coalesce(p.has_phone, false) THEN p.phone ELSE u.phone END AS phone,
           CASE WHEN coalesce(p.has_avatar_url, false) THEN p.avatar_url ELSE u.avatar_url END AS avatar_url
    FROM shop_users u LEFT JOIN p ON p.user_id = u.id""")
def chg_6(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    out, _ = C.apply_patches(shop.users, shop.profile_patches, "id", patch_key="user_id")
    return out.select("id", "first_name", "last_name", "phone", "avatar_url")


@register("chg_6_rejects", oracle=PATCH_SQL + """
    SELECT patch_id, user_id, reason FROM y WHERE reason IS NOT NULL""")
def chg_6_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.apply_patches(shop.users, shop.profile_patches, "id", patch_key="user_id")[1] \
        .select("patch_id", "user_id", "reason")


UPDATE_SQL = """
    WITH own AS (SELECT p.id AS product_id, u.email AS owner_email FROM shop_products p
                 JOIN shop_sellers s ON s.id = p.seller_id JOIN shop_users u ON u.id = s.user_id),
    judged AS (SELECT q.*, CASE WHEN own.product_id IS NULL THEN 'PRODUCT_NOT_FOUND'
                                WHEN own.owner_email IS DISTINCT FROM q.caller_email THEN 'NOT_OWNER'
                                WHEN q.name IS NULL OR q.price IS NULL OR q.stock_qty IS NULL OR q.status IS NULL
                                  THEN 'NULL_NOT_ALLOWED' END AS reason
               FROM shop_product_updates q LEFT JOIN own ON own.product_id = q.product_id)"""


@register("chg_7_rejects", oracle=UPDATE_SQL + """
    SELECT request_id, product_id, reason FROM judged WHERE reason IS NOT NULL""")
def chg_7_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.update_products(shop.products, shop.sellers, shop.users, shop.product_updates)[1]


@register("chg_7_update_products", oracle=UPDATE_SQL + """,
    last AS (SELECT product_id, arg_max({'name': name, 'description': description, 'price': price,
                                         'stock_qty': stock_qty, 'status': status}, seq) AS u
             FROM judged WHERE reason IS NULL GROUP BY product_id)
    SELECT p.id,
           CASE WHEN last.u IS NULL THEN p.name ELSE struct_extract(last.u, 'name') END AS name,
           CASE WHEN last.u IS NULL THEN p.description
                ELSE struct_extract(last.u, 'description') END AS description,
           CAST(CASE WHEN last.u IS NULL THEN p.price ELSE struct_extract(last.u, 'price') END
                AS DOUBLE) AS price,
           CASE WHEN last.u IS NULL THEN p.stock_qty ELSE struct_extract(last.u, 'stock_qty') END
               AS stock_qty,
           CASE WHEN last.u IS NULL THEN p.status ELSE struct_extract(last.u, 'status') END AS status
    FROM shop_products p LEFT JOIN last ON last.product_id = p.id""")
def chg_7(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    out, _ = C.update_products(shop.products, shop.sellers, shop.users, shop.product_updates)
    return out.select("id", "name", "description", _dbl("price"), "stock_qty", "status")


@register("chg_8_delete_authorised", oracle="""
    WITH allowed AS (
      SELECT q.review_id FROM shop_review_requests q
      JOIN shop_reviews r ON r.id = q.review_id
      LEFT JOIN shop_products p ON p.id = r.product_id
      LEFT JOIN shop_sellers s ON s.id = p.seller_id
      LEFT JOIN shop_users u ON u.id = q.caller_id
      WHERE u.role = 'ADMIN' OR r.user_id = q.caller_id
         OR (u.role = 'SELLER' AND s.user_id = q.caller_id))
    SELECT id, product_id FROM shop_reviews WHERE id NOT IN (SELECT review_id FROM allowed)""")
def chg_8(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    req = shop.review_requests.select("request_id", "review_id", "caller_id")
    auth = authorise_review_deletes(req, shop.reviews, shop.products, shop.sellers, shop.users)
    return C.delete_authorised(shop.reviews, auth.where("allowed"), "id", "review_id") \
        .select("id", "product_id")


ERASE_SQL = """
    WITH req AS (SELECT DISTINCT user_id FROM shop_flag_changes WHERE value),
    restricted AS (SELECT user_id FROM req WHERE user_id IN (SELECT user_id FROM shop_orders)),
    du AS (SELECT id FROM shop_users WHERE id IN (SELECT user_id FROM req)
           AND id NOT IN (SELECT user_id FROM restricted)),
    ds AS (SELECT id FROM shop_sellers WHERE user_id IN (SELECT id FROM du)),
    dc AS (SELECT id FROM shop_carts WHERE user_id IN (SELECT id FROM du)),
    dp AS (SELECT id FROM shop_products WHERE seller_id IN (SELECT id FROM ds)),
    dr AS (SELECT id FROM shop_reviews WHERE user_id IN (SELECT id FROM du)
           OR product_id IN (SELECT id FROM dp)),
    dv AS (SELECT id FROM shop_product_variants WHERE product_id IN (SELECT id FROM dp)),
    dt AS (SELECT id FROM shop_support_tickets WHERE user_id IN (SELECT id FROM du))"""


ERASE_KEYS = {"users": ["id"], "seller_profiles": ["id"], "carts": ["id"], "products": ["id"], "reviews": ["id"],
              "cart_items": ["cart_id", "product_id", "line_no", "src_order"], "wishlists": ["user_id", "product_id"],
              "helpful_votes": ["user_id", "review_id"], "search_history": ["event_id"],
              "verification_tokens": ["token_id"], "product_variants": ["id"], "support_tickets": ["id"], "support_messages": ["id"],
              "notification_preferences": ["user_id"], "payouts": ["id"]}


def _key_sql(cols):
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)


@register("chg_9_erase_users", oracle=ERASE_SQL + f"""
    SELECT DISTINCT 'users' AS table_name, CAST(id AS VARCHAR) AS key FROM du
    UNION ALL SELECT 'seller_profiles', CAST(id AS VARCHAR) FROM ds
    UNION ALL SELECT DISTINCT 'carts', CAST(id AS VARCHAR) FROM dc
    UNION ALL SELECT 'products', CAST(id AS VARCHAR) FROM dp
    UNION ALL SELECT 'reviews', CAST(id AS VARCHAR) FROM dr
    UNION ALL SELECT DISTINCT 'cart_items', {_key_sql(ERASE_KEYS["cart_items"])} FROM shop_cart_items
      WHERE cart_id IN (SELECT id FROM dc) OR product_id IN (SELECT id FROM dp)
    UNION ALL SELECT DISTINCT 'wishlists', {_key_sql(ERASE_KEYS["wishlists"])} FROM shop_wishlists
      WHERE user_id IN (SELECT id FROM du) OR product_id IN (SELECT id FROM dp)
    UNION ALL SELECT DISTINCT 'helpful_votes', {_key_sql(ERASE_KEYS["helpful_votes"])} FROM shop_helpful_votes
      WHERE user_id IN (SELECT id FROM du) OR review_id IN (SELECT id FROM dr)
    UNION ALL SELECT 'search_history', CAST(event_id AS VARCHAR) FROM shop_search_events
      WHERE user_id IN (SELECT id FROM du)
    UNION ALL SELECT 'verification_tokens', CAST(token_id AS VARCHAR) FROM shop_tokens_issued
      WHERE user_id IN (SELECT id FROM du)
    UNION ALL SELECT 'product_variants', CAST(id AS VARCHAR) FROM dv
    UNION ALL SELECT 'support_tickets', CAST(id AS VARCHAR) FROM dt
    UNION ALL SELECT 'support_messages', CAST(id AS VARCHAR) FROM shop_support_messages
      WHERE ticket_id IN (SELECT id FROM dt) OR sender_id IN (SELECT id FROM du)
    UNION ALL SELECT 'notification_preferences', CAST(user_id AS VARCHAR) FROM shop_notification_preferences
      WHERE user_id IN (SELECT id FROM du)
    UNION ALL SELECT 'payouts', CAST(id AS VARCHAR) FROM shop_payouts WHERE seller_id IN (SELECT id FROM ds)
    UNION ALL SELECT 'app_feedback.user_id', CAST(id AS VARCHAR) FROM shop_app_feedback WHERE user_id IN (SELECT id FROM du)
    UNION ALL SELECT 'order_items.variant_id', CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)
      FROM shop_order_lines WHERE variant_id IN (SELECT id FROM dv)
    UNION ALL SELECT 'order_items.product_id', CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)
      FROM shop_order_items WHERE product_id IN (SELECT id FROM dp)
    UNION ALL SELECT 'order_status_history.changed_by', CAST(request_id AS VARCHAR)
      FROM shop_status_updates WHERE changed_by IN (SELECT id FROM du)""")
def chg_9(spark, sf_dir):
    """Keys of the rows that go, and of those whose reference is blanked."""
    shop = Shop(spark, sf_dir)
    tables = {"users": shop.users, "seller_profiles": shop.sellers, "carts": shop.carts,
              "products": shop.products, "reviews": shop.reviews, "cart_items": shop.cart_items,
              "wishlists": shop.wishlists, "helpful_votes": shop.helpful_votes,
              "orders": shop.orders, "order_items": shop.order_lines,
              "search_history": shop.search_events, "verification_tokens": shop.tokens_issued,
              "order_status_history": shop.status_updates, "product_variants": shop.product_variants,
              "support_tickets": shop.support_tickets, "support_messages": shop.support_messages,
              "notification_preferences": shop.notification_preferences, "payouts": shop.payouts,
              "app_feedback": shop.app_feedback}
    e = C.Erasure(tables, shop.flag_changes.where("value").select("user_id"), keys={"notification_preferences": "user_id"})
    key = lambda cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key")
    found = [e.gone(t).select(F.lit(t).alias("table_name"), key(cols)).distinct() for t, cols in ERASE_KEYS.items()]
    found += [e.blanked(t, fk).select(F.lit(f"{t}.{fk}").alias("table_name"), key(cols)) for t, fk, cols in (
        ("order_items", "product_id", ["order_id", "line_no"]), ("order_items", "variant_id", ["order_id", "line_no"]),
        ("order_status_history", "changed_by", ["request_id"]), ("app_feedback", "user_id", ["id"]))]
    return C.stack_rows(*found)


@register("chg_9_restricted", oracle=ERASE_SQL + """
    SELECT user_id, 'orders' AS blocked_by FROM restricted""")
def chg_9_restricted(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    tables = {"users": shop.users, "orders": shop.orders}
    req = shop.flag_changes.where("value").select("user_id")
    return C.erase_users(tables, req)[1]


REG_SQL = r"""
    WITH f AS (
      SELECT r.*, concat_ws(',',
        CASE WHEN (email IS NULL OR NOT regexp_matches(email, '[^\x00-\x20]'))
                  OR NOT regexp_matches(email, '^[^@\s]+@[^@\s]+$') THEN 'email' END,
        CASE WHEN (first_name IS NULL OR NOT regexp_matches(first_name, '[^\x00-\x20]')) OR length(first_name) > 100
             THEN 'firstName' END,
        CASE WHEN (last_name IS NULL OR NOT regexp_matches(last_name, '[^\x00-\x20]')) OR length(last_name) > 100
             THEN 'lastName' END,
        CASE WHEN (password IS NULL OR NOT regexp_matches(password, '[^\x00-\x20]')) OR length(password) < 8
             THEN 'password' END,
        CASE WHEN role NOT IN ('CUSTOMER', 'SELLER', 'ADMIN') THEN 'role' END) AS fields
      FROM (SELECT * REPLACE (coalesce(role, 'CUSTOMER') AS role) FROM shop_registrations) r),
    firsts AS (SELECT email, min(seq) AS first_seq FROM f
               WHERE fields = ''
                 AND NOT (role = 'ADMIN' AND NOT coalesce(admin_code = 'letmein', false))
                 AND NOT (role = 'SELLER' AND (store_name IS NULL OR NOT regexp_matches(store_name, '[^\x00-\x20]')))
               GROUP BY email),
    decided AS (
      SELECT f.request_id, f.email, f.fields, f.role, f.store_name,
             CASE WHEN f.fields <> '' THEN 'INVALID_FIELDS'
                  WHEN f.email IN (SELECT email FROM shop_users) OR f.seq > firsts.first_seq
                    THEN 'EMAIL_TAKEN'
                  WHEN f.role = 'ADMIN' AND NOT coalesce(f.admin_code = 'letmein', false)
                    THEN 'ADMIN_CODE_WRONG'
                  WHEN f.role = 'SELLER' AND (f.store_name IS NULL OR NOT regexp_matches(f.store_name, '[^\x00-\x20]'))
                    THEN 'STORE_NAME_MISSING' END AS error
      FROM f LEFT JOIN firsts ON firsts.email = f.email)"""


@register("chg_10_validate_registrations", oracle=REG_SQL + """
    SELECT request_id, email, error, fields FROM decided""")
def chg_10(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    ok, bad = C.validate_registrations(shop.registrations, shop.users, "letmein")
    return ok.select("request_id", "email", F.lit(None).cast("string").alias("error"),
                     F.lit("").alias("fields")) \
        .unionByName(bad.select("request_id", "email", "error",
                                F.array_join(F.array_sort(F.map_keys("field_errors")), ",")
                                .alias("fields")))


@register("chg_10_seller_profiles", oracle=REG_SQL + """
    SELECT request_id AS user_request_id, email, store_name, false AS is_verified FROM decided
    WHERE error IS NULL AND role = 'SELLER'""")
def chg_10_profiles(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.seller_profiles(C.validate_registrations(shop.registrations, shop.users, "letmein")[0])


REVIEW_SQL = """
    WITH x AS (SELECT q.*, p.id IS NOT NULL AS known,
                      CASE WHEN regexp_matches(coalesce(q.rating_text, '5'), '^[+-]?[0-9]+$')
                           THEN TRY_CAST(coalesce(q.rating_text, '5') AS SMALLINT) END AS rating
               FROM shop_review_requests q LEFT JOIN shop_products p ON p.id = q.product_id),
    y AS (SELECT *, CASE WHEN NOT known THEN 'PRODUCT_NOT_FOUND' WHEN rating IS NULL THEN 'RATING_NOT_A_NUMBER'
                         WHEN rating NOT BETWEEN 1 AND 5 THEN 'RATING_OUT_OF_RANGE' END AS reason FROM x)"""


@register("chg_11_intake_reviews", oracle=REVIEW_SQL + """
    SELECT (SELECT max(id) FROM shop_reviews) + 1 + request_id - (SELECT min(request_id) FROM y WHERE reason IS NULL) AS id,
           caller_id AS user_id, product_id, rating, title, text FROM y WHERE reason IS NULL""")
def chg_11(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    ok, _ = C.intake_reviews(shop.review_requests, shop.products, shop.reviews)
    return ok.select("id", "user_id", "product_id", "rating", "title", "text")


@register("chg_11_rejects", oracle=REVIEW_SQL + """
    SELECT request_id, product_id, rating, reason FROM y WHERE reason IS NOT NULL""")
def chg_11_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.intake_reviews(shop.review_requests, shop.products)[1]


SIGN_IN_SQL = r"""
    WITH j AS (SELECT p.*, u.id AS user_id,
                      CASE WHEN (p.email IS NULL OR NOT regexp_matches(p.email, '[^\x00-\x20]')) THEN 'NO_EMAIL' WHEN u.is_suspended THEN 'SUSPENDED' END AS reason
               FROM shop_profiles p LEFT JOIN shop_users u ON u.email = p.email)"""


@register("chg_13_find_or_create_users", oracle=SIGN_IN_SQL + r""",
    firsts AS (SELECT email, arg_min({'profile_id': profile_id, 'full_name': full_name,
                                      'avatar_url': avatar_url}, seq) AS p
               FROM j WHERE reason IS NULL AND user_id IS NULL GROUP BY email),
    t AS (SELECT email, struct_extract(p, 'profile_id') AS profile_id,
                 coalesce(regexp_replace(struct_extract(p, 'full_name'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '') AS n,
                 struct_extract(p, 'avatar_url') AS avatar_url FROM firsts)
    SELECT profile_id, email, CASE WHEN n = '' THEN split_part(email, '@', 1) ELSE split_part(n, ' ', 1) END AS first_name,
           CASE WHEN strpos(n, ' ') = 0 THEN '' ELSE substr(n, strpos(n, ' ') + 1) END AS last_name,
           avatar_url, 'CUSTOMER' AS role, true AS email_verified
    FROM t""")
def chg_13(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    return C.find_or_create_users(shop.profiles, shop.users)[0]


@register("chg_13_outcomes", oracle=SIGN_IN_SQL + """
    SELECT profile_id, user_id, reason FROM j WHERE reason IS NOT NULL OR user_id IS NOT NULL""")
def chg_13_outcomes(spark, sf_dir):
    """Sign-ins that found a user, and refused ones."""
    shop = Shop(spark, sf_dir)
    _, found, rejects = C.find_or_create_users(shop.profiles, shop.users)
    users = shop.users.select(F.col("id").alias("user_id"), "email")
    return found.select("profile_id", "user_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.join(users, "email", "left").select("profile_id", "user_id", "reason"))


@register("snk_1_upsert", oracle="""
    WITH ch AS (SELECT CASE WHEN seq % 10 = 0 THEN product_id + 1000000000
                            WHEN seq % 10 <> 3 THEN product_id END AS id,
                       name, price, seq FROM shop_product_updates),
    last AS (SELECT id, arg_max({'name': name, 'price': price}, seq) AS r FROM ch
             WHERE id IS NOT NULL GROUP BY id)
    SELECT id, name, CAST(price AS DOUBLE) AS price FROM shop_products
    WHERE id NOT IN (SELECT id FROM last)
    UNION ALL
    SELECT id, struct_extract(r, 'name'), CAST(struct_extract(r, 'price') AS DOUBLE) FROM last
    UNION ALL SELECT id, name, CAST(price AS DOUBLE) FROM ch WHERE id IS NULL""")
def snk_1(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    base = shop.products.select("id", "name", "price")
    changes = shop.product_updates.select(
        F.when(F.col("seq") % 10 == 0, F.col("product_id") + 1000000000)
         .when(F.col("seq") % 10 != 3, F.col("product_id")).alias("id"), "name", "price", "seq")
    return C.upsert(base, changes, ["id"]).select("id", "name", _dbl("price"))


@register("src_2_resolve_keys", oracle="""
    SELECT w.row_id, u.id AS user_id, p.id AS product_id
    FROM shop_incoming_wishlists w JOIN shop_users u ON u.email = w.email
    JOIN shop_products p ON p.slug = w.slug""")
def src_2(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    rows = shop.incoming_wishlists
    by_user, _ = C.resolve_keys(rows, shop.users, "email", "user_id")
    both, _ = C.resolve_keys(by_user, shop.products, "slug", "product_id")
    return both.select("row_id", "user_id", "product_id")


@register("src_2_rejects", oracle="""
    SELECT row_id, 'unknown email' AS reason FROM shop_incoming_wishlists w
    WHERE NOT EXISTS (SELECT 1 FROM shop_users u WHERE u.email = w.email)""")
def src_2_rejects(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    _, bad = C.resolve_keys(shop.incoming_wishlists, shop.users, "email", "user_id")
    return bad.select("row_id", "reason")


MATCH_TOKENS_SQL = """
    WITH m AS (
      SELECT a.attempt_id, a.user_id, a.purpose, a.attempted_at,
             CASE WHEN a.attempted_at <= t.issued_at + INTERVAL 15 MINUTE THEN t.token_id END
                 AS token_id,
             coalesce(t.token_id IS NOT NULL AND a.code = t.code
                      AND a.attempted_at <= t.issued_at + INTERVAL 15 MINUTE, false) AS valid
      FROM shop_token_attempts a ASOF LEFT JOIN shop_tokens_issued t
        ON a.user_id = t.user_id AND a.purpose = t.purpose AND a.attempted_at >= t.issued_at),
    firsts AS (SELECT token_id, arg_min(attempt_id, attempted_at) AS first_attempt
               FROM m WHERE valid GROUP BY token_id)
    SELECT m.attempt_id, m.user_id, m.purpose, m.attempted_at, coalesce(m.token_id, -1) AS token_id,
           m.valid, coalesce(m.valid AND m.attempt_id = f.first_attempt, false) AS matched
    FROM m LEFT JOIN firsts f ON f.token_id = m.token_id"""


@register("jon_6_match_tokens", oracle=MATCH_TOKENS_SQL)
def jon_6(spark, sf_dir):
    """Code matching; an attempt without a code in force shows token_id -1."""
    shop = Shop(spark, sf_dir)
    return match_tokens(shop.tokens_issued, shop.token_attempts) \
        .withColumn("token_id", F.coalesce("token_id", F.lit(-1).cast("bigint")))


def _slug_sql(requests: str) -> str:
    """One request after another within a family of slugs, with the list of
    slugs taken so far. ``requests``: SQL for (request_id, seq, base)."""
    family = lambda c: f"regexp_replace({c}, '(-[0-9]+)+$', '')"
    return f"""
    WITH RECURSIVE wanted AS ({requests}),
    turn AS (SELECT request_id, base, {family('base')} AS fam,
                    row_number() OVER (PARTITION BY {family('base')} ORDER BY seq, request_id) AS rn FROM wanted),
    held AS (SELECT {family('slug')} AS fam, list(DISTINCT slug) AS taken FROM shop_products
             WHERE slug IS NOT NULL GROUP BY 1),
    step(fam, rn, request_id, slug, taken) AS (
      SELECT DISTINCT turn.fam, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
             coalesce(held.taken, CAST([] AS VARCHAR[])) FROM turn LEFT JOIN held ON held.fam = turn.fam
      UNION ALL
      SELECT fam, rn, request_id, slug, list_append(taken, slug) FROM (
        SELECT turn.fam, turn.rn, turn.request_id, step.taken,
               list_filter(list_transform(range(0, len(step.taken) + 1),
                                          lambda i: CASE WHEN i = 0 THEN turn.base ELSE turn.base || '-' || i END),
                           lambda s: NOT list_contains(step.taken, s))[1] AS slug
        FROM step JOIN turn ON turn.fam = step.fam AND turn.rn = step.rn + 1)),
    given AS (SELECT request_id, slug FROM step WHERE rn > 0)"""


SLUGIFY_SQL = """coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'),
                                 '^-|-$', '', 'g'), ''), 'product')"""


@register("scl_2_assign_slugs", oracle=_slug_sql(
    f"SELECT request_id, seq, {SLUGIFY_SQL} AS base FROM shop_product_requests") + """
    SELECT request_id, slug FROM given""")
def scl_2(spark, sf_dir):
    """Unique slugs for the product requests against all existing slugs."""
    from cartograph.operators.slugs import assign_slugs
    shop = Shop(spark, sf_dir)
    new = shop.product_requests.select("request_id", "seq", T.slugify("name").alias("base"))
    return assign_slugs(new, shop.products.select("slug"))


NEW_PRODUCT_SQL = f"""
      SELECT q.*, s.id AS seller_id, {SLUGIFY_SQL} AS base, coalesce(c.id, q.category_id) AS category
      FROM shop_product_requests q JOIN shop_users u ON u.email = q.caller_email
      JOIN shop_sellers s ON s.user_id = u.id LEFT JOIN shop_categories c ON c.slug = q.category_slug
      WHERE q.name IS NOT NULL"""


@register("chg_12_create_products", oracle=_slug_sql(
    NEW_PRODUCT_SQL.replace("{SLUGIFY_SQL}", SLUGIFY_SQL).replace("lower(name)", "lower(q.name)")) + """
    SELECT (SELECT max(id) FROM shop_products) + 1 + w.request_id - (SELECT min(request_id) FROM wanted) AS id,
           w.seller_id, w.category AS category_id, w.name, g.slug, CAST(w.price AS DOUBLE) AS price,
           w.description, w.sku, w.stock_qty, coalesce(w.status, 'LIVE') AS status
    FROM wanted w JOIN given g ON g.request_id = w.request_id""")
def chg_12(spark, sf_dir):
    """Bulk product creation (seller by e-mail, category by slug, SCL-2 slugs)."""
    from cartograph.operators.slugs import create_products
    shop = Shop(spark, sf_dir)
    new, _ = create_products(shop.product_requests, shop.products, shop.categories,
                             shop.sellers, shop.users)
    return new.select("id", "seller_id", "category_id", "name", "slug",
                      F.col("price").cast("double").alias("price"), "description", "sku", "stock_qty", "status")


@register("chg_8_delete_products", oracle="""
    WITH own AS (SELECT p.id AS product_id, u.email AS owner_email FROM shop_products p
                 JOIN shop_sellers s ON s.id = p.seller_id JOIN shop_users u ON u.id = s.user_id),
    allowed AS (SELECT q.product_id FROM shop_product_updates q
                JOIN own ON own.product_id = q.product_id AND own.owner_email = q.caller_email)
    SELECT id, name FROM shop_products WHERE id NOT IN (SELECT product_id FROM allowed)""")
def chg_8_products(spark, sf_dir):
    """Product deletes by their owner (other callers are ignored)."""
    shop = Shop(spark, sf_dir)
    own = C.owned_products(shop.products, shop.sellers, shop.users)
    reqs = shop.product_updates.select("product_id", "caller_email")
    allowed = reqs.join(own, "product_id").where(F.col("owner_email") == F.col("caller_email"))
    return C.delete_authorised(shop.products, allowed, "id", "product_id").select("id", "name")


@register("chg_5_feature_products", oracle="""
    WITH ch AS (SELECT product_id, seq,
                       CASE WHEN NOT coalesce(json_valid(body), false) THEN NULL
                            WHEN NOT json_exists(body, '$.featured') THEN true
                            WHEN lower(json_extract_string(body, '$.featured')) IN ('true', 'false')
                            THEN CAST(json_extract_string(body, '$.featured') AS BOOLEAN) END AS v
                FROM shop_feature_changes),
    last AS (SELECT product_id, arg_max(v, seq) AS v FROM ch WHERE v IS NOT NULL GROUP BY product_id)
    SELECT p.id, coalesce(last.v, p.is_featured) AS is_featured
    FROM shop_products p LEFT JOIN last ON last.product_id = p.id""")
def chg_5_feature(spark, sf_dir):
    """Featured flag from request bodies (missing key: true; null: reject)."""
    shop = Shop(spark, sf_dir)
    ok, _ = C.flag_from_body(shop.feature_changes, "featured")
    out, _ = C.apply_flags(shop.products, ok, "id", "is_featured", change_key="product_id")
    return out.select("id", "is_featured")


@register("chg_5_hide_reviews", oracle="""
    WITH ch AS (SELECT review_id, seq,
                       CASE WHEN NOT coalesce(json_valid(body), false) THEN NULL
                            WHEN NOT json_exists(body, '$.hidden') THEN true
                            WHEN lower(json_extract_string(body, '$.hidden')) IN ('true', 'false')
                            THEN CAST(json_extract_string(body, '$.hidden') AS BOOLEAN) END AS v
                FROM shop_hide_changes),
    last AS (SELECT review_id, arg_max(v, seq) AS v FROM ch WHERE v IS NOT NULL GROUP BY review_id)
    SELECT r.id, coalesce(last.v, r.is_hidden) AS is_hidden
    FROM shop_reviews r LEFT JOIN last ON last.review_id = r.id""")
def chg_5_hide(spark, sf_dir):
    """Review hidden flag from request bodies (missing key: true; null: reject)."""
    shop = Shop(spark, sf_dir)
    ok, _ = C.flag_from_body(shop.hide_changes, "hidden")
    out, _ = C.apply_flags(shop.reviews, ok, "id", "is_hidden", change_key="review_id")
    return out.select("id", "is_hidden")
