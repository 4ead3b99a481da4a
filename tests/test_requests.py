"""Every request of a bulk job ends in exactly one output; odd requests."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartograph.functions import text as T
from cartograph.operators import analytics as A
from cartograph.operators import catalog as C
from cartograph.operators import changes as CH
from cartograph.sources.tables import check_schema
from cartograph.streaming import feed


def test_cart_events_all_accounted_for(spark):
    items = spark.createDataFrame([(1, 10, 2, 1.0)], "cart_id long, product_id long, quantity int, unit_price double")
    rows = [(1, 1, 10, "add", None, 1.0), (2, 1, 10, None, 1, 1.0), (3, 1, 10, "move", 1, 1.0), (4, 1, 11, "set", 3, 1.0),
            (5, 1, 11, "remove", None, None), (6, 1, 99, "add", 1, 1.0), (7, None, 10, "add", 1, 1.0), (8, 1, None, "add", 1, 1.0),
            (9, 1, None, "CLEAR", None, None), (10, 1, 10, "set", 5, 1.0), (11, 1, 11, "add", 4, 2.0), (12, 1, 11, "set", -1, 1.0)]
    ev = spark.createDataFrame(rows, "seq long, cart_id long, product_id long, action string, quantity int, price double")
    products = spark.createDataFrame([(10,), (11,)], "id long")
    lines, rejects = CH.fold_cart(items, ev, products=products)
    assert [tuple(r) for r in lines.collect()] == [(1, 11, 4, 2.0)]
    assert {r.seq: r.reason for r in rejects.collect()} == {
        1: "INVALID_QUANTITY", 2: "INVALID_ACTION", 3: "INVALID_ACTION", 4: "LINE_NOT_FOUND", 5: "LINE_NOT_FOUND",
        6: "PRODUCT_NOT_FOUND", 7: "CART_NOT_FOUND", 8: "PRODUCT_NOT_FOUND", 10: "LINE_NOT_FOUND", 12: "INVALID_QUANTITY"}


def test_flag_bodies(spark):
    bodies = ['{"hidden": false, "note": "x"}', "{}", '{"hidden": null}', "hidden", '{"hidden": "maybe"}', None, '{"hidden": true}']
    df = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    ok, bad = CH.flag_from_body(df, "hidden")
    assert {r.seq: r.value for r in ok.collect()} == {0: False, 1: True, 6: True}
    assert {r.seq: r.reason for r in bad.collect()} == {2: "NOT_A_BOOLEAN", 3: "UNREADABLE_BODY", 4: "NOT_A_BOOLEAN",
                                                        5: "UNREADABLE_BODY"}


def test_patches_reject_nulls_and_unreadable(spark):
    base = spark.createDataFrame([(1, "Ann", "Lee", "+1", None)],
                                 "id long, first_name string, last_name string, phone string, avatar_url string")
    rows = [(1, 1, '{"firstName": null, "phone": "9"}'), (2, 1, "oops"), (3, 2, "{}"), (4, 1, '{"phone": null}'), (5, 1, None)]
    out, bad = CH.apply_patches(base, spark.createDataFrame(rows, "seq long, id long, body string"), "id")
    assert tuple(out.first()) == (1, "Ann", "Lee", None, None)
    assert {r.seq: r.reason for r in bad.collect()} == {1: "NULL_NOT_ALLOWED", 2: "UNREADABLE_BODY", 3: "UNKNOWN_KEY",
                                                        5: "UNREADABLE_BODY"}


def test_upsert_inserts_every_row_without_a_key(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    changes = spark.createDataFrame([(None, "x", 1), (None, "y", 2), (1, "b", 3)], "id long, name string, seq long")
    assert sorted(map(str, (tuple(r) for r in CH.upsert(base, changes, ["id"]).collect()))) == [
        "(1, 'b')", "(None, 'x')", "(None, 'y')"]


def test_sign_ins(spark):
    users = spark.createDataFrame([(1, "a@x.io", False), (2, "b@x.io", True)], "id long, email string, is_suspended boolean")
    rows = [(1, None), (2, " \t"), (3, "a@x.io"), (4, "b@x.io"), (5, "n@x.io"), (6, "n@x.io"), (7, None)]
    p = spark.createDataFrame([(i, i, e, "\tAnn Lee\n", None) for i, e in rows],
                              "profile_id long, seq long, email string, full_name string, avatar_url string")
    created, found, bad = CH.find_or_create_users(p, users)
    assert [(r.email, r.first_name, r.last_name) for r in created.collect()] == [("n@x.io", "Ann", "Lee")]
    assert [tuple(r) for r in found.collect()] == [(3, 1)]
    assert {r.profile_id: r.reason for r in bad.collect()} == {1: "NO_EMAIL", 2: "NO_EMAIL", 4: "SUSPENDED", 7: "NO_EMAIL"}


def test_review_intake_and_new_ids(spark):
    rows = [(5, 1, 10, " 4 ", "t", "x"), (6, 1, 10, "4", "t", None), (7, 1, 10, None, None, None), (8, 1, 99, "3", "t", "x"),
            (9, 1, 10, "9", "t", "x")]
    req = spark.createDataFrame(rows, "request_id long, caller_id long, product_id long, rating_text string, title string, text string")
    products = spark.createDataFrame([(10,)], "id long")
    ok, bad = CH.intake_reviews(req, products, spark.createDataFrame([(100,)], "id long"))
    assert sorted((r.id, r.rating, r.title) for r in ok.collect()) == [(101, 4, "t"), (102, 5, None)]
    assert {r.request_id: r.reason for r in bad.collect()} == {5: "RATING_NOT_A_NUMBER", 8: "PRODUCT_NOT_FOUND",
                                                               9: "RATING_OUT_OF_RANGE"}


def test_customer_with_a_seller_profile_may_not_delete(spark):
    req = spark.createDataFrame([(1, 7, 1), (2, 7, 2)], "request_id long, review_id long, caller_id long")
    reviews = spark.createDataFrame([(7, 50, 10)], "id long, user_id long, product_id long")
    products = spark.createDataFrame([(10, 20)], "id long, seller_id long")
    for role, allowed in (("CUSTOMER", False), ("SELLER", True)):
        users = spark.createDataFrame([(1, role), (2, "SELLER")], "id long, role string")
        sellers = spark.createDataFrame([(20, 1)], "id long, user_id long")
        got = {r.request_id: r.allowed for r in A.authorise_review_deletes(req, reviews, products, sellers, users).collect()}
        assert got == {1: allowed, 2: False}


def test_suggest_takes_a_backslash_literally(spark):
    products = spark.createDataFrame([("ab\\c", True), ("abc", True)], "name string, is_active boolean")
    reqs = spark.createDataFrame([(1, "ab\\"), (2, "ab"), (3, "%b"), (4, "\t a")], "request_id long, prefix string")
    got = {}
    for r in C.suggest(products, reqs).collect():
        got.setdefault(r.request_id, []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["ab\\c"], 2: ["ab\\c", "abc"], 3: ["ab\\c", "abc"]}


def test_white_space_is_blank(spark):
    df = spark.createDataFrame([("\t",), ("\n Ann\x01 ",), (None,), ("a",)], "s string")
    assert [tuple(r) for r in df.select(T.is_blank("s"), T.trim("s")).collect()] == [
        (True, ""), (False, "Ann"), (True, None), (False, "a")]


def test_scan_refuses_files_that_drift(spark, scratch):
    path = f"{scratch}/t.parquet"
    spark.range(3).withColumn("x", F.lit("a")).write.parquet(path)
    from pyspark.sql import types as ty
    check_schema(spark, path, ty.StructType([ty.StructField("id", ty.LongType())]))
    for field in (ty.StructField("gone", ty.LongType()), ty.StructField("x", ty.LongType())):
        with pytest.raises(ValueError):
            check_schema(spark, path, ty.StructType([field]))


def _folders(path):
    import os
    return sorted(f"{k}/{int(n[1:])}" for k in ("base", "delta") if os.path.isdir(f"{path}/{k}") for n in os.listdir(f"{path}/{k}"))


def test_feed_survives_a_stop_between_any_two_steps(spark, scratch):
    """Batches and compactions, each replayed, stopped half way and run again:
    the current table is always that of the updates so far."""
    import os
    cols = "request_id long, order_id long, status string, seq long, changed_at timestamp_ntz, changed_by long"
    at = dt.datetime(2024, 1, 1)
    history, current = f"{scratch}/h", f"{scratch}/c"

    def put(batch, *rows):
        df = spark.createDataFrame([(i, o, s, i, at, 1) for i, o, s in rows], cols)
        for _ in range(2):  # replayed after a failure
            feed._write_batch(spark, df, batch, history, current)

    def now():
        return {r.order_id: r.status for r in feed.current_table(spark, current).current().collect()}

    def half_written(folder):
        """A writer that died before it committed."""
        os.makedirs(f"{current}/{folder}", exist_ok=True)
        with open(f"{current}/{folder}/part-0.parquet", "w") as f:
            f.write("not parquet")

    put(0, (1, 5, "SHIPPED"), (4, 9, "DELIVERED"))
    half_written("delta/n0000000000000000001")
    assert now() == {5: "SHIPPED", 9: "DELIVERED"}
    put(1, (2, 5, "DELIVERED"), (3, 9, "SHIPPED"), (5, 7, "nonsense"))  # seq 3 comes late
    assert now() == {5: "DELIVERED", 9: "DELIVERED"}
    half_written("base/n0000000000000000001")
    assert now() == {5: "DELIVERED", 9: "DELIVERED"}
    feed.compact_current(spark, current)
    feed.compact_current(spark, current)
    assert now() == {5: "DELIVERED", 9: "DELIVERED"} and _folders(current) == ["base/1", "delta/0", "delta/1"]
    put(1, (2, 5, "CANCELLED"))  # the base holds batch 1 already
    put(2, (6, 7, "SHIPPED"))
    assert now() == {5: "DELIVERED", 7: "SHIPPED", 9: "DELIVERED"}
    feed.compact_current(spark, current)
    assert now() == {5: "DELIVERED", 7: "SHIPPED", 9: "DELIVERED"} and _folders(current) == ["base/1", "base/2", "delta/2"]
    put(3, (7, 7, "DELIVERED"))
    feed.compact_current(spark, current)
    assert _folders(current) == ["base/2", "base/3", "delta/3"] and now()[7] == "DELIVERED"
    assert spark.read.parquet(history).count() == 5  # batch 1 was replayed with one row


def test_rollups_equal_recomputed_after_every_batch(spark, scratch):
    """New, hidden, shown, edited and deleted reviews; votes; promo orders; every
    batch applied twice, a compaction after every second one."""
    import random

    from cartograph.operators import analytics as A
    from cartograph.operators import quality as Q
    from cartograph.operators import rollups as R
    rnd = random.Random(4)
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    products = frame([(p, p % 3) for p in range(6)], "id long, seller_id long")
    sellers = frame([(s,) for s in range(4)], "id long")
    cols, votes_cols, order_cols = "id long, product_id long, rating int, is_hidden boolean", "review_id long, user_id long", "id long, promo_id long"
    per_product, per_seller = R.ratings_table(spark, f"{scratch}/p"), R.ratings_table(spark, f"{scratch}/s", "seller_id")
    votes, uses = R.votes_table(spark, f"{scratch}/v"), R.uses_table(spark, f"{scratch}/u")
    reviews, held, orders = {}, set(), []
    for batch in range(4):
        old = {}
        for i in range(batch * 10, batch * 10 + 10):
            reviews[i] = (i, rnd.randrange(5), rnd.randint(1, 5), rnd.random() < 0.3)
        new_ids = set(range(batch * 10, batch * 10 + 10))
        for i in rnd.sample(sorted(set(reviews) - new_ids), min(6, batch * 8)):
            old[i] = reviews.pop(i)
            if rnd.random() < 0.7:
                reviews[i] = (i, old[i][1], rnd.randint(1, 5), rnd.random() < 0.5)
        after = [reviews[i] for i in reviews if i in old or i in new_ids]
        added = {(rnd.randrange(10), rnd.randrange(5)) for _ in range(8)} - held
        gone = set(rnd.sample(sorted(held), min(3, len(held))))
        bought = [(len(orders) + i, rnd.choice([1, 1, 2, None])) for i in range(7)]
        for _ in range(2):
            changes = R.rating_changes(frame(list(old.values()), cols), frame(after, cols))
            per_product.append(batch, changes)
            per_seller.append(batch, R.seller_rating_changes(changes, products))
            votes.append(batch, R.vote_changes(frame(sorted(gone), votes_cols), frame(sorted(added), votes_cols)))
            uses.append(batch, R.use_changes(None, frame(bought, order_cols)))
        held = held - gone | added
        orders += bought
        if batch % 2:
            for t in (per_product, per_seller, votes, uses):
                t.compact()
        now = frame(list(reviews.values()), cols)
        rows = lambda df: sorted(map(tuple, df.collect()))
        stored = R.rating_columns(products, per_product)
        assert rows(stored) == rows(A.product_ratings(products, now))
        assert Q.drift(stored, A.product_ratings(products, now), "products", ["product_id"], ["rating_avg", "review_count"]).count() == 0
        assert rows(R.rating_columns(sellers, per_seller, "seller_id")) == rows(A.seller_ratings(sellers, products, now))
        assert rows(R.vote_counts(votes)) == rows(A.helpful_votes(frame(sorted(held), votes_cols)))
        assert rows(uses.current()) == rows(A.promo_uses(frame(orders, order_cols)))


def test_erasure_follows_deeper_keys(spark):
    t = {"users": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
         "addresses": spark.createDataFrame([(7, 2), (8, 3)], "id long, user_id long"),
         "orders": spark.createDataFrame([(50, 9, 7)], "id long, user_id long, address_id long"),
         "verification_tokens": spark.createDataFrame([(1, 1), (2, 3)], "token_id long, user_id long"),
         "order_status_history": spark.createDataFrame([(1, 3), (2, 2)], "id long, changed_by long")}
    out, blocked = CH.erase_users(t, spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id long"))
    assert [tuple(r) for r in blocked.collect()] == [(2, "orders")]
    assert [r.id for r in out["users"].collect()] == [2]
    assert [r.id for r in out["addresses"].collect()] == [7]
    assert out["verification_tokens"].count() == 0
    assert {r.id: r.changed_by for r in out["order_status_history"].collect()} == {1: None, 2: 2}


def test_erasure_reaches_every_table(spark):
    """One row of every table hangs on user 1; every key of the list is followed."""
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    ids = {t for c, _, p, _ in CH.USER_FKS for t in (c, p)}
    t = {"users": frame([(1,), (2,)], "id long")}
    for name in sorted(ids - {"users"}):
        cols = {fk: p for c, fk, p, _ in CH.USER_FKS if c == name}
        # row 1 points at row 1 of every parent, row 2 at row 2; orders are of user 2 alone
        rows = [(i, *[2 if name == "orders" else i for _ in cols]) for i in (1, 2)]
        t[name] = frame(rows, ", ".join(f"{c} long" for c in ("id", *cols)))
    e = CH.Erasure(t, frame([(1,), (2,)], "user_id long"))
    assert {tuple(r) for r in e.restricted.collect()} == {(2, "orders")}
    stay = {"orders", "order_items", "order_status_history", "app_feedback"}
    assert {n for n in t if [r.id for r in e.gone(n).collect()] == [1]} == set(t) - stay
    for name in stay:
        assert e.gone(name).count() == 0
    left = {n: {r.id: r.asDict() for r in e.kept(n).collect()} for n in t}
    assert all(set(rows) == ({1, 2} if n in stay else {2}) for n, rows in left.items())
    assert left["order_items"][1] == {"id": 1, "order_id": 1, "product_id": None, "variant_id": None}
    assert left["app_feedback"][1]["user_id"] is None and left["order_status_history"][1]["changed_by"] is None
    assert [r.id for r in e.blanked("order_items", "variant_id").collect()] == [1]


def test_erasure_over_cycles_and_several_owners(spark):
    """Employees point at their manager and departments at a head, and back;
    row 4 hangs on both users, of whom one is refused."""
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    fks = (("staff", "user_id", "users", "CASCADE"), ("staff", "manager", "staff", "CASCADE"), ("staff", "dept", "depts", "CASCADE"),
           ("depts", "head", "staff", "CASCADE"), ("audits", "staff_id", "staff", "RESTRICT"), ("notes", "staff_id", "staff", "CASCADE"))
    t = {"users": frame([(1,), (2,), (3,)], "id long"),
         "staff": frame([(1, 1, None, None), (2, None, 1, None), (3, None, 2, 7), (4, 2, 3, 8), (5, 2, None, 8), (6, 3, None, None), (7, None, None, 9)],
                        "id long, user_id long, manager long, dept long"),
         "depts": frame([(7, 3), (8, 5), (9, 4)], "id long, head long"),
         "audits": frame([(1, 5)], "id long, staff_id long"), "notes": frame([(1, 7), (2, 5), (3, 2)], "id long, staff_id long")}
    out, blocked = CH.erase_users(t, frame([(1,), (2,)], "user_id long"), fks)
    assert [tuple(r) for r in blocked.collect()] == [(2, "audits")]
    assert sorted(r.id for r in out["users"].collect()) == [2, 3]
    assert sorted(r.id for r in out["staff"].collect()) == [5, 6]  # 1 to 4 by managers, 7 by the department of 4
    assert [r.id for r in out["depts"].collect()] == [8]
    assert [r.id for r in out["notes"].collect()] == [2]
    empty, none = CH.erase_users(t, frame([], "user_id long"), fks)
    assert empty["staff"].count() == 7 and none.count() == 0
