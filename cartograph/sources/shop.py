"""Shop tables over the driver's TPC-H-like parquet files.

The mapping is written once, as SQL text that both Spark and DuckDB run, so the
library's jobs (DataFrame code) and the oracle queries (SQL) read identical
inputs. Each view is a projection/join of the given tables only; no view does
any of a job's work. Placeholders ``{name}`` are driver tables or other views:
Spark receives DataFrames for them (``spark.sql(text, **frames)``), DuckDB
receives the bare names as common table expressions. Literal braces are
doubled.

Money is built from integer cents: ``floor(x * 100 + 0.5)`` is computed in
IEEE double in both engines, then turned into ``DECIMAL(10,2)`` exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartograph.sources.tables import DRIVER_SCHEMAS, load_table

DRIVER_TABLES = tuple(DRIVER_SCHEMAS)

_CENTS_UNIT_PRICE = ("CAST(CAST(floor(l.l_extendedprice * 100 / l.l_quantity + 0.5) AS DOUBLE)"
                     " / 100 AS DECIMAL(10,2))")

# name -> SQL text. Fixed mapping rules for the fixture (see SURVEY §7.2).
VIEWS: dict[str, str] = {
    "shop_events": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS INT) AS k
        FROM {events}""",
    "shop_categories": """
        SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_type) AS BIGINT) AS id,
               p_type AS name, lower(p_type) AS slug,
               CAST(ROW_NUMBER() OVER (ORDER BY p_type DESC) AS INT) AS sort_order,
               CAST(NULL AS BIGINT) AS parent_id
        FROM (SELECT DISTINCT p_type FROM {part}) t""",
    "shop_users": """
        SELECT c.c_custkey AS id,
               'user' || CAST(c.c_custkey AS STRING) || '@shop.test' AS email,
               split_part(c.c_name, '#', 1) AS first_name,
               split_part(c.c_name, '#', 2) AS last_name,
               CASE WHEN c.c_custkey % 3 = 0 THEN NULL
                    ELSE '+1-555-' || CAST(c.c_custkey % 10000 AS STRING) END AS phone,
               CASE WHEN c.c_custkey % 2 = 0 THEN NULL
                    ELSE '/avatars/' || CAST(c.c_custkey AS STRING) || '.png' END AS avatar_url,
               CASE WHEN c.c_custkey % 97 = 1 THEN 'ADMIN'
                    WHEN s.s_suppkey IS NOT NULL AND c.c_custkey % 5 <> 2 THEN 'SELLER'
                    ELSE 'CUSTOMER' END AS role,
               c.c_acctbal >= 0 AS email_verified,
               (c.c_mktsegment = 'AUTOMOBILE' AND c.c_acctbal < 0) AS is_suspended
        FROM {customer} c LEFT JOIN {supplier} s ON s.s_suppkey = c.c_custkey""",
    "shop_sellers": """
        SELECT s_suppkey AS id, s_suppkey AS user_id, s_name AS store_name,
               s_acctbal > 0 AS is_verified,
               CAST(CAST(s_suppkey % 500 AS DOUBLE) / 100 AS DECIMAL(3,2)) AS rating_avg,
               CAST(s_suppkey % 50 AS INT) AS review_count
        FROM {supplier}""",
    "shop_products": """
        SELECT p.p_partkey AS id, f.seller_id, c.id AS category_id, p.p_name AS name,
               replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS STRING) AS slug,
               'A ' || lower(p.p_type) || ' ' || p.p_name || ' by ' || p.p_brand AS description,
               CAST(p.p_retailprice AS DECIMAL(10,2)) AS price,
               'SKU-' || CAST(p.p_partkey AS STRING) AS sku,
               p.p_size AS stock_qty,
               CAST(5 AS INT) AS low_stock_threshold,
               CASE p.p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '[]'
                    ELSE '[{{"url": "/img/' || CAST(p.p_partkey AS STRING) || '.jpg", "alt": "'
                         || p.p_name || '"}}]' END AS images,
               p.p_partkey % 7 = 0 AS is_featured,
               p.p_partkey % 10 <> 0 AS is_active,
               CASE WHEN p.p_partkey % 20 < 17 THEN 'LIVE'
                    WHEN p.p_partkey % 20 < 19 THEN 'DRAFT' ELSE 'DEACTIVATED' END AS status,
               CAST(CAST((p.p_partkey * 37) % 501 AS DOUBLE) / 100 AS DECIMAL(3,2)) AS rating_avg,
               CAST(p.p_partkey % 13 AS INT) AS review_count,
               f.created_at
        FROM {part} p
        JOIN {shop_categories} c ON c.name = p.p_type
        LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS seller_id, min(l_shipdate) AS created_at
                   FROM {lineitem} GROUP BY l_partkey) f ON f.l_partkey = p.p_partkey""",
    "shop_orders": """
        -- one user in ten has no orders (the one before has them), so that
        -- erasure meets users it may delete
        SELECT o.o_orderkey AS id,
               CASE WHEN o.o_custkey % 10 = 3 THEN o.o_custkey - 1 ELSE o.o_custkey END AS user_id,
               CASE WHEN o.o_orderstatus = 'O' THEN 'CONFIRMED'
                    WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 0 THEN 'SHIPPED'
                    WHEN o.o_orderstatus = 'P' THEN 'PROCESSING'
                    WHEN o.o_orderkey % 5 = 0 THEN 'CANCELLED'
                    ELSE 'DELIVERED' END AS status,
               CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EXPRESS'
                    ELSE 'STANDARD' END AS delivery_type,
               CAST(o.o_totalprice AS DECIMAL(10,2)) AS total,
               CASE o.o_orderkey % 33 WHEN 0 THEN CAST(1 AS BIGINT) WHEN 11 THEN CAST(2 AS BIGINT)
                    WHEN 22 THEN CAST(3 AS BIGINT) END AS promo_id,
               CASE WHEN o.o_orderkey % 4 = 0 THEN NULL
                    ELSE CAST(o.o_orderdate AS DATE) END AS estimated_delivery_date,
               o.o_orderdate AS created_at
        FROM {orders} o""",
    "shop_order_items": f"""
        SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, l.l_linenumber AS line_no,
               l.l_suppkey AS supplier_id,
               CAST(l.l_quantity AS INT) AS quantity,
               {_CENTS_UNIT_PRICE} AS unit_price,
               p.p_name AS product_name
        FROM {{lineitem}} l LEFT JOIN {{part}} p ON p.p_partkey = l.l_partkey""",
    "shop_carts": """
        SELECT DISTINCT o_custkey AS id, o_custkey AS user_id
        FROM {orders} WHERE o_orderstatus = 'O'""",
    "shop_cart_items": f"""
        SELECT o.o_custkey AS cart_id, l.l_partkey AS product_id,
               CAST(l.l_quantity AS INT) AS quantity,
               {_CENTS_UNIT_PRICE} AS unit_price,
               l.l_orderkey AS src_order, l.l_linenumber AS line_no
        FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
        WHERE o.o_orderstatus = 'O'""",
    "shop_reviews": """
        SELECT d.doc_id AS id,
               CASE WHEN d.doc_id % 50 = 49 THEN -d.doc_id
                    ELSE (d.doc_id % (SELECT count(*) FROM {part} WHERE p_partkey % 20 = 0)) * 20 + 1
               END AS product_id,
               d.doc_id % (SELECT count(*) FROM {customer}) AS user_id,
               CASE WHEN d.doc_id % 5 = 0 THEN NULL
                    ELSE d.doc_id % (SELECT count(*) FROM {orders}) END AS order_id,
               CAST(1 + (d.doc_id * 7) % 5 AS SMALLINT) AS rating,
               d.lang || ' review ' || CAST(d.doc_id AS STRING) AS title,
               d.text AS text,
               coalesce(lb.toxic, 0) = 1 AS is_hidden,
               CAST(d.doc_id % 7 AS INT) AS helpful_votes,
               o.o_orderdate AS created_at
        FROM {documents} d
        LEFT JOIN {labels} lb ON lb.doc_id = d.doc_id
        LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id % (SELECT count(*) FROM {orders})""",
    "shop_search_events": """
        SELECT e.event_id, e.user_id, e.ts AS searched_at,
               CASE e.event_id % 4
                    WHEN 0 THEN upper(split_part(p.p_name, ' ', 1))
                    WHEN 1 THEN '  ' || split_part(p.p_name, ' ', 2)
                    WHEN 2 THEN p.p_name
                    ELSE split_part(p.p_name, ' ', 1) || ' ' END AS query
        FROM {events} e
        JOIN {part} p ON p.p_partkey = e.event_id % (SELECT count(*) FROM {part})
        WHERE e.event_type = 'click'""",
    "shop_product_views": """
        SELECT event_id, user_id, ts,
               event_id % (SELECT count(*) FROM {part}) AS product_id
        FROM {events} WHERE event_type = 'view'""",
    "shop_helpful_votes": """
        SELECT user_id, k * 10 + event_id % 10 AS review_id
        FROM {shop_events} WHERE event_type = 'view'""",
    "shop_wishlists": """
        SELECT user_id, event_id % (SELECT count(*) FROM {part}) AS product_id, ts AS added_at
        FROM {shop_events} WHERE event_type = 'purchase'""",
    "shop_product_variants": """
        SELECT p_partkey * 2 AS id, p_partkey AS product_id FROM {part} WHERE p_size % 3 <> 0
        UNION ALL SELECT p_partkey * 2 + 1, p_partkey FROM {part} WHERE p_size % 3 = 1""",
    "shop_order_lines": """
        SELECT i.*, v.id AS variant_id FROM {shop_order_items} i
        LEFT JOIN {shop_product_variants} v ON v.id = i.product_id * 2 + i.line_no % 2""",
    "shop_support_tickets": """
        SELECT event_id AS id, user_id, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS order_id, ts AS created_at
        FROM {shop_events} WHERE event_type = 'error' AND event_id % 2 = 0""",
    "shop_support_messages": """
        SELECT id * 2 AS id, id AS ticket_id, user_id AS sender_id FROM {shop_support_tickets}
        UNION ALL SELECT id * 2 + 1, id, (user_id * 7 + 1) % (SELECT count(*) FROM {customer}) FROM {shop_support_tickets}""",
    "shop_notification_preferences": """
        SELECT id AS user_id, id % 2 = 0 AS promotions FROM {shop_users}""",
    "shop_payouts": """
        SELECT id * 2 AS id, id AS seller_id FROM {shop_sellers}
        UNION ALL SELECT id * 2 + 1, id FROM {shop_sellers} WHERE is_verified""",
    "shop_app_feedback": """
        SELECT event_id AS id, user_id, k AS stars FROM {shop_events} WHERE event_type = 'click' AND event_id % 3 = 0""",
    "shop_logins": """
        SELECT event_id, user_id, ts, event_type = 'signup' AS success
        FROM {events} WHERE event_type IN ('error', 'signup')""",
    "shop_tokens_issued": """
        SELECT event_id AS token_id, user_id, ts AS issued_at,
               CASE WHEN k % 2 = 0 THEN 'EMAIL_VERIFY' ELSE 'PASSWORD_RESET' END AS purpose,
               lpad(CAST(k % 10 AS STRING), 6, '0') AS code
        FROM {shop_events} WHERE event_type = 'signup'""",
    "shop_token_attempts": """
        SELECT event_id AS attempt_id, user_id, ts AS attempted_at,
               CASE WHEN k % 3 = 0 THEN 'PASSWORD_RESET' ELSE 'EMAIL_VERIFY' END AS purpose,
               lpad(CAST(k % 10 AS STRING), 6, '0') AS code
        FROM {shop_events} WHERE event_type IN ('click', 'purchase')
        UNION ALL
        -- follow-up entries typed 0 to 19 minutes after each signup, with the
        -- signup's code or a neighbouring one
        SELECT event_id + 1000000000 AS attempt_id, user_id,
               ts + (k % 20) * INTERVAL '1' MINUTE AS attempted_at,
               CASE WHEN k % 2 = 0 THEN 'EMAIL_VERIFY' ELSE 'PASSWORD_RESET' END AS purpose,
               lpad(CAST((k + event_id % 2) % 10 AS STRING), 6, '0') AS code
        FROM {shop_events} WHERE event_type = 'signup'""",
    "shop_order_requests": """
        SELECT event_id AS request_id, user_id, ts AS requested_at, event_id AS seq,
               CASE k % 4 WHEN 0 THEN 'express' WHEN 1 THEN 'SAME_DAY'
                          WHEN 2 THEN 'Standard' ELSE NULL END AS delivery_type,
               CASE k % 3 WHEN 0 THEN NULL
                          WHEN 1 THEN '{{"name": "Ann Lee", "city": "Austin"}}'
                          ELSE '{{"street": "1 Main St", "zipCode": "78701", "name": null}}' END
                   AS shipping_address
        FROM {shop_events} WHERE event_type = 'purchase'""",
    "shop_promo_requests": """
        SELECT event_id AS request_id, user_id,
               CASE k % 6 WHEN 0 THEN 'baby10' WHEN 1 THEN 'FreeShip' WHEN 2 THEN 'WELCOME20'
                          WHEN 3 THEN 'SAVE50' WHEN 4 THEN ' BABY10' ELSE NULL END AS code,
               CAST(CAST(k * 137 AS DOUBLE) / 100 AS DECIMAL(10,2)) AS subtotal
        FROM {shop_events} WHERE event_type = 'click'""",
    "shop_prefix_requests": """
        SELECT event_id AS request_id,
               CASE WHEN event_id % 10 = 7 THEN 'r_'
                    ELSE substr(query, 1, 2 + CAST(event_id % 3 AS INT)) END
                   || CASE WHEN event_id % 50 = 3 THEN chr(92) ELSE '' END AS prefix
        FROM {shop_search_events}""",
    # The reference's three seeded promo codes (fixed values); expiry dates
    # are set inside the order history so that some orders fall after them.
    "shop_promo_codes": """
        SELECT CAST(id AS BIGINT) AS id, code, discount_type,
               CAST(discount_value AS DECIMAL(10,2)) AS discount_value,
               CAST(min_order AS DECIMAL(10,2)) AS min_order,
               CAST(max_uses AS INT) AS max_uses, CAST(0 AS INT) AS uses_count,
               CAST(expires_at AS TIMESTAMP) AS expires_at, is_active
        FROM (VALUES (1, 'BABY10', 'PERCENT', 10.00, 30.00, 1000, '1999-03-31 00:00:00', true),
                     (2, 'FREESHIP', 'FIXED', 9.99, 25.00, 500, '1998-06-30 00:00:00', true),
                     (3, 'WELCOME20', 'PERCENT', 20.00, 50.00, NULL, '1999-06-30 00:00:00', true))
             AS t(id, code, discount_type, discount_value, min_order, max_uses, expires_at, is_active)""",
    "shop_registrations": """
        SELECT event_id AS request_id, event_id AS seq,
               CASE k % 5 WHEN 0 THEN 'user' || CAST(user_id AS STRING) || '@shop.test'
                          WHEN 1 THEN 'new' || CAST(user_id AS STRING) || '@shop.test'
                          WHEN 2 THEN 'new' || CAST(event_id AS STRING) || '@shop.test'
                          WHEN 3 THEN 'not-an-email' ELSE NULL END AS email,
               CASE WHEN k % 7 = 0 THEN chr(9) ELSE 'First' || CAST(k AS STRING) END AS first_name,
               CASE WHEN k % 11 = 0 THEN NULL ELSE 'Last' END AS last_name,
               CASE WHEN k % 6 = 0 THEN 'short' ELSE 'password-' || CAST(k AS STRING) END AS password,
               CASE k % 4 WHEN 0 THEN 'SELLER' WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'CUSTOMER' END AS role,
               CASE WHEN k % 16 = 0 THEN NULL WHEN k % 16 = 4 THEN ' ' || chr(10) || ''
                    ELSE 'Store ' || CAST(k AS STRING) END AS store_name,
               CASE WHEN k % 3 = 0 THEN 'letmein' ELSE 'nope' END AS admin_code
        FROM {shop_events} WHERE event_type = 'signup'""",
    "shop_profiles": """
        SELECT event_id AS profile_id, event_id AS seq,
               CASE k % 4 WHEN 0 THEN 'user' || CAST(user_id AS STRING) || '@shop.test'
                          WHEN 1 THEN ' User' || CAST(user_id AS STRING) || '@Shop.test'
                          WHEN 2 THEN CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN chr(9) || ' '
                                           ELSE 'social' || CAST(k AS STRING) || '@mail.test' END
                          ELSE 'social' || CAST(k AS STRING) || '@mail.test' END AS email,
               CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN chr(9) || ' Ann  Lee Smith '
                          WHEN 3 THEN 'Solo' ELSE 'Kim ' || CAST(k AS STRING) END AS full_name,
               CASE WHEN k % 2 = 0 THEN NULL ELSE '/a/' || CAST(k AS STRING) || '.png' END AS avatar_url
        FROM {shop_events} WHERE event_type = 'click'""",
    "shop_review_requests": """
        SELECT event_id AS request_id, event_id AS seq,
               CASE WHEN k % 3 = 1 AND k % 2 = 0
                    THEN (SELECT min(s.user_id) FROM {shop_sellers} s) + k % 8 ELSE user_id END AS caller_id,
               CASE k % 3 WHEN 0 THEN user_id
                          WHEN 1 THEN event_id % (SELECT count(*) FROM {documents})
                          ELSE -1 END AS review_id,
               CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 1 THEN ' 4 ' WHEN k % 9 = 2 THEN 'four'
                    ELSE CAST(k % 7 AS STRING) END AS rating_text,
               'Title ' || CAST(k AS STRING) AS title,
               CASE WHEN k % 5 = 0 THEN NULL ELSE 'Text ' || CAST(k AS STRING) END AS text,
               event_id % (SELECT count(*) FROM {part}) AS product_id
        FROM {shop_events} WHERE event_type = 'purchase'""",
    "shop_order_access_requests": """
        SELECT e.event_id AS request_id, e.event_id AS seq, e.user_id AS caller_id,
               CASE WHEN e.k % 2 = 0 THEN coalesce(f.first_order, -1)
                    ELSE e.event_id % (SELECT count(*) FROM {orders}) END AS order_id
        FROM {shop_events} e
        LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM {orders}
                   GROUP BY o_custkey) f ON f.o_custkey = e.user_id
        WHERE e.event_type = 'view'""",
    "shop_product_requests": """
        SELECT e.event_id AS request_id, e.event_id AS seq,
               'user' || CAST(e.user_id AS STRING) || '@shop.test' AS caller_email,
               CASE e.k % 5 WHEN 0 THEN p.p_name WHEN 1 THEN upper(p.p_name) || '!'
                            WHEN 2 THEN '***' WHEN 3 THEN replace(p.p_name, ' ', '-') || '-1'
                            ELSE p.p_name || ' ' || CAST(e.k % 3 AS STRING) END AS name,
               CASE e.k % 3 WHEN 0 THEN lower(p.p_type) WHEN 1 THEN 'no-such' ELSE NULL END
                   AS category_slug,
               CAST(1 AS BIGINT) AS category_id,
               CAST(p.p_retailprice AS DECIMAL(10,2)) AS price,
               CASE WHEN e.k % 6 = 0 THEN NULL ELSE 'New ' || p.p_name END AS description,
               'NEW-' || CAST(e.event_id AS STRING) AS sku, CAST(e.k AS INT) AS stock_qty,
               CASE e.k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'DRAFT' ELSE 'LIVE' END AS status
        FROM {shop_events} e
        JOIN {part} p ON p.p_partkey = e.event_id % (SELECT count(*) FROM {part})
        WHERE e.event_type = 'view'""",
    "shop_product_updates": """
        SELECT event_id AS request_id, event_id AS seq,
               event_id % (SELECT count(*) FROM {part}) AS product_id,
               'user' || CAST(CASE WHEN k % 3 = 0 THEN user_id ELSE k % (SELECT count(*) FROM {supplier}) END
                              AS STRING) || '@shop.test' AS caller_email,
               CASE WHEN k % 11 = 0 THEN NULL ELSE 'Renamed ' || CAST(k AS STRING) END AS name,
               CASE WHEN k % 4 = 0 THEN NULL ELSE 'Updated ' || CAST(k AS STRING) END AS description,
               CAST(CAST(k * 1000 + 99 AS DOUBLE) / 100 AS DECIMAL(10,2)) AS price,
               CAST(k AS INT) AS stock_qty,
               CASE WHEN k % 3 = 0 THEN 'DRAFT' ELSE 'LIVE' END AS status
        FROM {shop_events} WHERE event_type = 'purchase'""",
    "shop_incoming_wishlists": """
        SELECT e.event_id AS row_id,
               CASE WHEN e.k % 5 = 0 THEN 'ghost' ELSE 'user' END
                   || CAST(e.user_id AS STRING) || '@shop.test' AS email,
               CASE WHEN e.k % 7 = 0 THEN 'no-such-slug'
                    ELSE replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS STRING) END AS slug
        FROM {shop_events} e
        JOIN {part} p ON p.p_partkey = e.event_id % (SELECT count(*) FROM {part})
        WHERE e.event_type = 'view'""",
    "shop_flag_changes": """
        SELECT event_id AS change_id, event_id AS seq, user_id, k % 2 = 0 AS value
        FROM {shop_events} WHERE event_type = 'error'""",
    "shop_profile_patches": """
        SELECT event_id AS patch_id, event_id AS seq, user_id,
               CASE k % 8 WHEN 0 THEN '{{"phone": "+1-222-' || CAST(k AS STRING) || '"}}'
                          WHEN 1 THEN '{{"phone": null, "firstName": "Pat"}}'
                          WHEN 2 THEN '{{"lastName": "Lee' || CAST(k AS STRING) || '", "avatarUrl": null}}'
                          WHEN 3 THEN '{{}}' WHEN 5 THEN 'name=Pat'
                          WHEN 6 THEN '{{"firstName": null, "phone": "1"}}' WHEN 7 THEN '{{"nick": "x"}}'
                          ELSE '{{"firstName": "Sam' || CAST(k AS STRING) || '"}}' END AS body
        FROM {shop_events} WHERE event_type = 'click'""",
    "shop_status_updates": """
        SELECT event_id AS request_id, event_id AS seq,
               event_id % (SELECT count(*) FROM {orders}) AS order_id,
               CASE k % 7 WHEN 0 THEN 'shipped' WHEN 1 THEN 'OUT_FOR_DELIVERY' WHEN 2 THEN 'Delivered'
                          WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'PROCESSING' WHEN 5 THEN 'LOST'
                          ELSE 'CONFIRMED' END AS status,
               ts AS changed_at, user_id AS changed_by
        FROM {shop_events} WHERE event_type = 'error'""",
    "shop_cart_events": """
        SELECT e.seq, o.o_custkey AS cart_id,
               CASE WHEN e.k % 13 = 7 THEN -1 WHEN e.k % 13 = 2 THEN NULL ELSE l.l_partkey END AS product_id,
               CASE e.k % 13 WHEN 0 THEN 'remove' WHEN 1 THEN 'set' WHEN 2 THEN 'clear'
                             WHEN 3 THEN 'SET' WHEN 4 THEN 'move' WHEN 5 THEN NULL ELSE 'add' END AS action,
               CASE e.k % 13 WHEN 3 THEN 0 - e.k % 2 WHEN 6 THEN NULL ELSE 1 + e.k % 4 END AS quantity,
               CAST(CAST(e.k * 100 + 5 AS DOUBLE) / 100 AS DECIMAL(10,2)) AS price
        FROM (SELECT event_id AS seq, k,
                     event_id % (SELECT count(*) FROM {orders}) AS okey
              FROM {shop_events} WHERE event_type IN ('click', 'view', 'purchase')) e
        JOIN {orders} o ON o.o_orderkey = e.okey
        JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 + e.k % 3""",
    "shop_feature_changes": """
        SELECT event_id AS change_id, event_id AS seq,
               event_id % (SELECT count(*) FROM {part}) AS product_id,
               CASE k % 8 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"featured": false}}'
                          WHEN 2 THEN '{{"featured": true}}' WHEN 3 THEN '{{"featured": null}}'
                          WHEN 4 THEN '{{"featured": false, "note": "x"}}' WHEN 5 THEN 'featured'
                          WHEN 6 THEN '{{"featured": "soon"}}' ELSE NULL END AS body
        FROM {shop_events} WHERE event_type = 'click'""",
    "shop_hide_changes": """
        SELECT event_id AS change_id, event_id AS seq,
               event_id % (SELECT count(*) FROM {documents}) AS review_id,
               CASE k % 7 WHEN 0 THEN '{{"hidden": false}}' WHEN 1 THEN '{{}}'
                          WHEN 2 THEN '{{"hidden": null}}' WHEN 3 THEN '{{"hidden": true}}'
                          WHEN 4 THEN '{{"hidden": false, "by": 7}}' WHEN 5 THEN '{{"hidden'
                          ELSE '{{"hidden": 3}}' END AS body
        FROM {shop_events} WHERE event_type = 'error'""",
}


def view_deps(name: str) -> list[str]:
    """Names (driver tables or views) a view reads, in first-use order."""
    import re
    found = []
    for dep in re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", VIEWS[name]):
        if dep not in found:
            found.append(dep)
    return found


# sf_dir -> folder holding the views written as parquet (see ``materialize``)
_MATERIALIZED: dict[str, str] = {}


def materialize(spark: SparkSession, sf_dir: str, path: str, names=None) -> None:
    """Write the shop views of ``sf_dir`` once as parquet tables under
    ``path`` (a shared folder) and read them from there afterwards, as a
    deployment would keep them as tables. Views are written parents first."""
    shop = Shop(spark, sf_dir)
    for name in _ordered_views(list(names or VIEWS)):
        shop[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    _MATERIALIZED[sf_dir] = path


class Shop:
    """Lazily built shop DataFrames for one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str,
                 overrides: dict[str, DataFrame] | None = None):
        """``overrides`` replaces driver tables by other frames, e.g. the
        events table by a streaming frame, so the same views feed a stream."""
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = dict(overrides or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            stored = _MATERIALIZED.get(self.sf_dir)
            if name in VIEWS and stored and not self._streaming():
                self._frames[name] = self.spark.read.parquet(f"{stored.rstrip('/')}/{name}")
            elif name in VIEWS:
                deps = {d: self[d] for d in view_deps(name)}
                self._frames[name] = self.spark.sql(VIEWS[name], **deps)
            else:
                self._frames[name] = load_table(self.spark, self.sf_dir, name)
        return self._frames[name]

    def _streaming(self) -> bool:
        return any(df.isStreaming for df in self._frames.values())

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = f"shop_{name}" if f"shop_{name}" in VIEWS else name
        if key not in VIEWS and key not in DRIVER_TABLES:
            raise AttributeError(name)
        return self[key]


def _ordered_views(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEWS:
            return
        for d in view_deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(body: str) -> str:
    """DuckDB text: the views ``body`` mentions, as CTEs, then ``body``.

    ``body`` names views as plain identifiers (``shop_products``).
    """
    import re
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    views = _ordered_views(used)
    if not views:
        return body
    ctes = []
    for n in views:
        text = VIEWS[n].format(**{d: d for d in view_deps(n)})
        ctes.append(f"{n} AS ({text.strip()})")
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
