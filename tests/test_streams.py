"""Streams against their batch twins. The events table is split into daily
files in a scratch folder so the streams run many micro-batches in time
order and carry state across them."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cartograph.operators.tokens import match_tokens
from cartograph.sources.shop import Shop
from cartograph.sources.tables import DRIVER_SCHEMAS, load_table
from cartograph.streaming.feed import compact_current, current_table, merge_current, order_status_feed, status_history, trending_stream
from cartograph.streaming.lockout import lockouts, lockouts_batch
from cartograph.streaming.tokens import match_tokens_stream, token_events
from cartograph.streaming.windows import (rate_violations, rate_violations_batch, trending_panes_batch,
                                          trending_sketches,
                                          trending_windows_batch)


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    ev = load_table(spark, SF_SMALL, "events").withColumn("day", F.to_date("ts"))
    # one file per day, written in day order so file order is time order
    for i, d in enumerate(sorted(r.day for r in ev.select("day").distinct().collect())):
        ev.where(F.col("day") == d).drop("day").coalesce(1).write.parquet(os.path.join(out, f"d{i:03d}"))
    files = []
    for root, _, names in os.walk(out):
        files += [os.path.join(root, n) for n in names if n.endswith(".parquet")]
    flat = str(tmp_path_factory.mktemp("events_flat"))
    for i, f in enumerate(sorted(files)):
        os.link(f, os.path.join(flat, f"part-{i:04d}.parquet"))
    return flat


def _stream_shop(spark, event_files):
    stream = spark.readStream.schema(DRIVER_SCHEMAS["events"]).option("maxFilesPerTrigger", 3) \
        .parquet(event_files)
    return Shop(spark, SF_SMALL, overrides={"events": stream})


def _run_to_table(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def _collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_lockout_stream_equals_batch(spark, event_files):
    sshop = _stream_shop(spark, event_files)
    streamed = _run_to_table(lockouts(sshop.logins, sshop.users), "lockout_out")
    bshop = Shop(spark, SF_SMALL)
    batch = lockouts_batch(bshop.logins, bshop.users)
    cols = ["event_id", "outcome", "failed_attempts", "locked_until"]
    last = Shop(spark, SF_SMALL).logins.agg(F.max("ts")).first()[0]
    due = batch.where(F.col("ts") < F.lit(last - dt.timedelta(minutes=11)))
    got = _collect(streamed, cols)
    assert set(_collect(due, cols)) <= set(got) <= set(_collect(batch, cols)) and len(got) == len(set(got))


def test_lockout_stream_takes_late_rows_in_their_place(spark, tmp_path):
    """Failures that arrive one micro-batch after a later success, and a reset."""
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    users = spark.createDataFrame([(1, True, False)], "id long, email_verified boolean, is_suspended boolean")
    schema = "event_id long, user_id long, ts timestamp_ntz, success boolean, reset boolean"
    at = lambda i, m, ok=False, reset=False: (i, 1, t0 + dt.timedelta(minutes=m), ok, reset)
    batches = [[at(5, 5, True)], [at(i, i) for i in range(5)], [at(6, 30)] + [at(i, 31 + i) for i in range(7, 11)],
               [at(11, 42, True), at(12, 43, False, True), at(13, 44, True)], [(99, 2, t0 + dt.timedelta(days=1), False, False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    import shutil
    flat = tmp_path / "in"
    flat.mkdir()
    for i in range(len(batches)):
        name = next(n for n in os.listdir(tmp_path / f"b{i}") if n.endswith(".parquet"))
        shutil.copy(tmp_path / f"b{i}" / name, flat / f"{i}.parquet")
        os.utime(flat / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    got = {r.event_id: (r.outcome, r.failed_attempts)
           for r in _run_to_table(lockouts(stream, users), "late_out").collect() if r.user_id == 1}
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r.event_id: (r.outcome, r.failed_attempts)
            for r in lockouts_batch(everything, users).collect() if r.user_id == 1}
    assert got == want
    assert want[4] == ("LOCKED_NOW", 5) and want[5][0] == "LOCKED" and want[12] == ("RESET", 0) and want[13] == ("OK", 0)


def test_token_state_is_empty_after_expiry(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    schema = "user_id long, purpose string, ts timestamp_ntz, kind int, id long, code string"
    # the attempt arrives a micro-batch before its code
    batches = [[(1, "P", t0 + dt.timedelta(minutes=3), 1, 10, "a")], [(1, "P", t0, 0, 1, "a")],
               [(1, "P", t0 + dt.timedelta(minutes=9), 1, 11, "a")], [(2, "P", t0 + dt.timedelta(days=1), 1, 12, "x")],
               [(2, "P", t0 + dt.timedelta(days=2), 1, 13, "x")]]
    import shutil
    flat = tmp_path / "in"
    flat.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        name = next(n for n in os.listdir(tmp_path / f"b{i}") if n.endswith(".parquet"))
        shutil.copy(tmp_path / f"b{i}" / name, flat / f"{i}.parquet")
        os.utime(flat / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    out = match_tokens_stream(stream)
    q = out.writeStream.outputMode("append").format("memory").queryName("expiry_out").start()
    q.processAllAvailable()
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {r.attempt_id: (r.token_id, r.valid, r.matched) for r in spark.table("expiry_out").collect()}
    assert got == {10: (1, True, True), 11: (1, True, False), 12: (None, False, False)}
    assert rows == 1  # only the last attempt waits; the code of user 1 is gone


def test_token_stream_equals_batch(spark, event_files):
    sshop = _stream_shop(spark, event_files)
    streamed = _run_to_table(match_tokens_stream(token_events(sshop.tokens_issued,
                                                              sshop.token_attempts)), "token_out")
    bshop = Shop(spark, SF_SMALL)
    batch = match_tokens(bshop.tokens_issued, bshop.token_attempts)
    cols = ["attempt_id", "token_id", "valid", "matched"]
    last = bshop.token_attempts.agg(F.max("attempted_at")).first()[0]
    due = batch.where(F.col("attempted_at") < F.lit(last - dt.timedelta(minutes=40)))
    as_text = lambda rows: sorted(map(str, rows))
    got = as_text(tuple(r) for r in streamed.select(*cols).collect())
    assert set(as_text(tuple(r) for r in due.select(*cols).collect())) <= set(got)
    assert set(got) <= set(as_text(tuple(r) for r in batch.select(*cols).collect()))


def test_token_stream_keeps_no_state_per_user(spark, tmp_path):
    """Many users with an event or two each, some of nobody and of no purpose."""
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    users = [None, *range(2999)]
    issued = spark.createDataFrame(
        [(u, None if u == 7 else "P", at(i % 50), 10_000 + i, "a") for i, u in enumerate(users)],
        "user_id long, purpose string, issued_at timestamp_ntz, token_id long, code string")
    attempts = spark.createDataFrame(
        [(u, None if u == 7 else "P", at(i % 50 + 5 + i % 3 * 6), i, "ab"[i % 7 == 6]) for i, u in enumerate(users)],
        "user_id long, purpose string, attempted_at timestamp_ntz, attempt_id long, code string")
    events = token_events(issued, attempts)
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    q = match_tokens_stream(stream).writeStream.format("memory").queryName("buckets_out").start()
    q.processAllAvailable()
    waiting = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert waiting < 2000  # 6,000 events of 3,000 users
    late = events.select("user_id", "purpose", F.lit(at(60 * 24)).alias("ts"), "kind", F.lit(-1).cast("bigint").alias("id"), "code")
    late.where("kind = 1 AND user_id = 5").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    q.processAllAvailable()
    q.stop()
    cols = ["attempt_id", "user_id", "purpose", "attempted_at", "token_id", "valid", "matched"]
    as_text = lambda df: sorted(str(tuple(r)) for r in df.where("attempt_id >= 0").select(*cols).collect())
    got = as_text(spark.table("buckets_out"))
    assert got == as_text(match_tokens(issued, attempts)) and len(got) == 3000


def test_rate_stream_equals_batch_up_to_watermark(spark, event_files):
    sshop = _stream_shop(spark, event_files)
    streamed = _run_to_table(rate_violations(sshop.logins, limit=1, lateness="2 minutes"), "rate_out")
    bshop = Shop(spark, SF_SMALL)
    batch = rate_violations_batch(bshop.logins, 1)
    last = bshop.logins.agg(F.max("ts")).first()[0]
    cutoff = last - dt.timedelta(minutes=3)
    cols = ["user_id", "window_start", "requests"]
    assert _collect(streamed, cols) == _collect(batch.where(F.col("window_start") < F.lit(cutoff)), cols)
    assert rate_violations_batch(bshop.logins, 10).count() == 0


def test_status_feed_equals_batch(spark, event_files, scratch):
    sshop = _stream_shop(spark, event_files)
    hist, cur = os.path.join(scratch, "history"), os.path.join(scratch, "current")
    q = order_status_feed(sshop.status_updates, hist, cur, name="feed_test", trigger_once=True)
    q.awaitTermination()
    bshop = Shop(spark, SF_SMALL)
    exp_hist = status_history(bshop.status_updates)
    got_hist = spark.read.parquet(hist)
    cols = ["order_id", "status", "seq"]
    assert _collect(got_hist, cols) == _collect(exp_hist, cols)
    empty = exp_hist.limit(0).select("order_id", "status", "seq", "changed_at")
    exp_cur = merge_current(empty, exp_hist)
    assert _collect(current_table(spark, cur).current(), cols) == _collect(exp_cur, cols)
    compact_current(spark, cur)
    assert _collect(current_table(spark, cur).current(), cols) == _collect(exp_cur, cols)


def test_trending_stream_equals_batch_up_to_watermark(spark, event_files, scratch):
    sshop = _stream_shop(spark, event_files)
    out = os.path.join(scratch, "trending")
    q = trending_stream(sshop.search_events, out, k=8, name="trend_test", trigger_once=True)
    q.awaitTermination()
    bshop = Shop(spark, SF_SMALL)
    batch = trending_windows_batch(bshop.search_events)
    got = spark.read.parquet(out)
    last = bshop.search_events.agg(F.max("searched_at")).first()[0]
    cutoff = last - dt.timedelta(minutes=10) - dt.timedelta(hours=1)
    cols = ["window_start", "term", "users", "rank"]
    exp = batch.where(F.col("window_start") <= F.lit(cutoff))
    got = got.where(F.col("window_start") <= F.lit(cutoff))
    assert _collect(got, cols) == _collect(exp, cols)
    assert got.count() > 0


def test_trending_terms_trim_like_the_batch_rule(spark):
    """A trailing tab or line end makes no term of its own, in TRD-1 and STR-5."""
    from cartograph.operators.catalog import trending
    at = dt.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(1, "Cot\t", at), (2, "\n cot ", at), (3, "\x0b", at)], "user_id long, query string, searched_at timestamp_ntz")
    assert {(r.term, r.users) for r in trending_windows_batch(rows).collect()} == {("cot", 2)}
    assert [(r.term, r.users) for r in trending(rows, "2024-01-02 00:00:00", "7 days", 8).collect()] == [("cot", 2)]


def test_trending_sketches_stay_within_their_error(spark):
    """Up to 30,000 users of a term: three standard errors; few users: exact."""
    users = spark.range(30000).selectExpr(
        "id AS user_id", "CASE WHEN id % 2 = 0 THEN 'Big ' WHEN id % 50 = 1 THEN 'mid' ELSE 'rest' END AS query",
        "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, id % 90, id % 60) AS searched_at")
    few = users.where("user_id < 300").withColumn("query", F.lit("few"))
    rows = users.unionByName(few).unionByName(few)
    exact = {(r.w.start, r.term): r.n for r in rows.selectExpr("lower(trim(query)) AS term", "user_id", "CAST(searched_at AS timestamp_ltz) AS ts")
             .groupBy(F.window("ts", "1 hour", "10 minutes").alias("w"), "term").agg(F.countDistinct("user_id").alias("n")).collect()}
    got = {(r.w.start, r.term): r.users for r in trending_sketches(rows).collect()}
    assert got.keys() == exact.keys() and max(exact.values()) > 9000
    assert all(abs(got[w] - n) <= 3 * 0.01625 * n for w, n in exact.items())
    assert all(got[w] == n for w, n in exact.items() if w[1] == "few")


def test_trending_panes_stream_equals_batch_up_to_watermark(spark, event_files, scratch):
    out = os.path.join(scratch, "panes")
    trending_stream(_stream_shop(spark, event_files).search_events, out, k=8, name="panes_test", trigger_once=True,
                    sketches=True).awaitTermination()
    searches = Shop(spark, SF_SMALL).search_events
    cutoff = searches.agg(F.max("searched_at")).first()[0] - dt.timedelta(minutes=70)
    cols = ["window_start", "term", "users", "rank"]
    got = spark.read.parquet(out).where(F.col("window_start") <= F.lit(cutoff))
    assert _collect(got, cols) == _collect(trending_panes_batch(searches).where(F.col("window_start") <= F.lit(cutoff)), cols)
    assert got.count() > 0
