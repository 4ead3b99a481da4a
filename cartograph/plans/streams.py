"""Batch twins of the streaming rules (STR-1, STR-3, STR-4, STR-5), and STR-2 as
a stream over the events table.

The streaming forms live in :mod:`cartograph.streaming`; tests run them on
the same tables and compare with these batch results. STR-2's batch twin is
``jon_6_match_tokens``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartograph.plans.changes import MATCH_TOKENS_SQL
from cartograph.plans.registry import register
from cartograph.session import checkpoint_dir, temporary
from cartograph.sources.shop import Shop
from cartograph.streaming.feed import merge_current, status_history
from cartograph.streaming.lockout import lockouts_batch
from cartograph.streaming.sources import table_stream
from cartograph.streaming.tokens import closing_event, replay_tokens, token_events
from cartograph.streaming.windows import rate_violations_batch, trending_panes_batch, trending_windows_batch


LOCKOUT_SQL = """
    WITH RECURSIVE a AS (
      SELECT l.event_id, l.user_id, l.ts, l.success, coalesce(u.email_verified, false) AS verified,
             coalesce(u.is_suspended, false) AS suspended,
             row_number() OVER (PARTITION BY l.user_id ORDER BY l.ts, l.event_id) AS rn
      FROM shop_logins l LEFT JOIN shop_users u ON u.id = l.user_id),
    f(user_id, rn, event_id, ts, outcome, failed, until) AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR),
             0, CAST(NULL AS TIMESTAMP) FROM a
      UNION ALL
      SELECT user_id, rn, event_id, ts, outcome,
             CASE WHEN outcome = 'OK' THEN 0 WHEN outcome IN ('FAILED', 'LOCKED_NOW') THEN failed + 1 ELSE failed END,
             CASE WHEN outcome = 'LOCKED_NOW' THEN ts + INTERVAL 15 MINUTE
                  WHEN outcome = 'OK' AND failed > 0 THEN NULL ELSE until END
      FROM (SELECT a.user_id, a.rn, a.event_id, a.ts, f.failed, f.until,
                   CASE WHEN f.until > a.ts THEN 'LOCKED' WHEN a.suspended THEN 'SUSPENDED'
                        WHEN NOT a.verified THEN 'UNVERIFIED' WHEN a.success THEN 'OK'
                        WHEN f.failed + 1 >= 5 THEN 'LOCKED_NOW' ELSE 'FAILED' END AS outcome
            FROM f JOIN a ON a.user_id = f.user_id AND a.rn = f.rn + 1))"""


@register("str_1_lockouts", oracle=LOCKOUT_SQL + """
    SELECT event_id, user_id, ts, outcome, failed AS failed_attempts, until AS locked_until FROM f WHERE rn > 0""")
def str_1(spark, sf_dir):
    """Outcome of every login attempt under the lockout fold."""
    shop = Shop(spark, sf_dir)
    return lockouts_batch(shop.logins, shop.users)


@register("str_1_locks_per_user", oracle=LOCKOUT_SQL + """
    SELECT user_id, count(*) AS locks FROM f WHERE outcome = 'LOCKED_NOW' GROUP BY user_id""")
def str_1_locks(spark, sf_dir):
    """Number of locks each user ran into (from the lockout fold)."""
    shop = Shop(spark, sf_dir)
    out = lockouts_batch(shop.logins, shop.users)
    return out.where(F.col("outcome") == "LOCKED_NOW").groupBy("user_id") \
        .agg(F.count(F.lit(1)).alias("locks"))


@register("str_2_match_tokens", oracle=MATCH_TOKENS_SQL)
def str_2(spark, sf_dir):
    """Code matching as a stream over the events table, read to its end."""
    batch = Shop(spark, sf_dir)
    live = Shop(spark, sf_dir, overrides={"events": table_stream(spark, sf_dir, "events")})
    run = f"str_2/{uuid.uuid4().hex}"
    folder = temporary(spark, f"{checkpoint_dir(spark).rstrip('/')}/{run}")
    events = token_events(live.tokens_issued, live.token_attempts) \
        .unionByName(closing_event(token_events(batch.tokens_issued, batch.token_attempts), f"{folder}/closing"))
    return replay_tokens(events, f"{folder}/answers", f"{run}/state") \
        .withColumn("token_id", F.coalesce("token_id", F.lit(-1).cast("bigint")))


@register("str_3_rate_violations", oracle="""
    SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS requests
    FROM shop_logins GROUP BY 1, 2 HAVING count(*) > 10""")
def str_3(spark, sf_dir):
    return rate_violations_batch(Shop(spark, sf_dir).logins, 10)


@register("str_3_rate_violations_limit1", oracle="""
    SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS requests
    FROM shop_logins GROUP BY 1, 2 HAVING count(*) > 1""")
def str_3_1(spark, sf_dir):
    return rate_violations_batch(Shop(spark, sf_dir).logins, 1)


@register("str_4_status_history", oracle="""
    SELECT order_id, upper(status) AS status, seq, changed_at, changed_by
    FROM shop_status_updates
    WHERE upper(status) IN ('CONFIRMED', 'PROCESSING', 'SHIPPED', 'OUT_FOR_DELIVERY',
                            'DELIVERED', 'CANCELLED')""")
def str_4_history(spark, sf_dir):
    return status_history(Shop(spark, sf_dir).status_updates)


@register("str_4_status_current", oracle="""
    WITH h AS (SELECT order_id, upper(status) AS status, seq FROM shop_status_updates
               WHERE upper(status) IN ('CONFIRMED', 'PROCESSING', 'SHIPPED', 'OUT_FOR_DELIVERY',
                                       'DELIVERED', 'CANCELLED')),
    base AS (SELECT id AS order_id, status, CAST(-1 AS BIGINT) AS seq FROM shop_orders),
    allrows AS (SELECT * FROM base UNION ALL SELECT * FROM h)
    SELECT order_id, arg_max(status, seq) AS status, max(seq) AS seq FROM allrows GROUP BY order_id""")
def str_4_current(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    base = shop.orders.select(F.col("id").alias("order_id"), "status",
                              F.lit(-1).cast("bigint").alias("seq"),
                              F.col("created_at").alias("changed_at"))
    return merge_current(base, status_history(shop.status_updates)).select("order_id", "status", "seq")


TRENDING_SQL = r"""
    WITH t AS (SELECT * FROM (
      SELECT lower(regexp_replace(query, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS term, user_id, searched_at AS ts
      FROM shop_search_events) WHERE term <> ''),
    w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(r.k * 10 AS BIGINT))
                   AS window_start, term, user_id
          FROM t, range(0, 6) r(k)),
    per AS (SELECT window_start, term, count(DISTINCT user_id) AS users FROM w GROUP BY 1, 2)
    SELECT window_start, term, users, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY users DESC, term) AS rank
      FROM per) x WHERE rank <= 8"""


@register("str_5_trending_windows", oracle=TRENDING_SQL)
def str_5(spark, sf_dir):
    return trending_windows_batch(Shop(spark, sf_dir).search_events)


@register("str_5_trending_panes", oracle=TRENDING_SQL)
def str_5_panes(spark, sf_dir):
    """The same from mergeable sketches per pane. Estimates, which are exact for
    the up to some hundred users of a term and window that these tables hold."""
    return trending_panes_batch(Shop(spark, sf_dir).search_events)
