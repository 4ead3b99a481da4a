"""Rules on hand-made rows with hand-computed answers (edge cases named in the
fixture notes), plus order-dependent jobs against plain-Python folds."""
import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartograph.functions import money as M
from cartograph.functions import text as T
from cartograph.functions.json import first_image_url
from cartograph.operators import analytics as A
from cartograph.operators import catalog as C
from cartograph.operators import changes as CH
from cartograph.operators.common import page, page_after
from cartograph.operators.slugs import assign_slugs
from cartograph.operators.tokens import match_tokens
from cartograph.streaming.lockout import lockouts_batch

TS = dt.datetime


def test_slugify_edges(spark):
    df = spark.createDataFrame([("Soft  Baby Blanket!",), ("***",), ("-Edge-",), ("Crème brûlée",)],
                               "name string")
    got = [r.s for r in df.select(T.slugify("name").alias("s")).collect()]
    assert got == ["soft-baby-blanket", "product", "edge", "cr-me-br-l-e"]


def test_split_full_name(spark):
    df = spark.createDataFrame([("  Ann  Lee Smith ", "a@x"), (None, "bob@x"), ("   ", "c@x"),
                                ("Solo", "d@x")], "full string, email string")
    got = [(r.f, r.l) for r in df.select(T.first_name("full", "email").alias("f"),
                                         T.last_name("full").alias("l")).collect()]
    assert got == [("Ann", " Lee Smith"), ("bob", ""), ("c", ""), ("Solo", "")]


def test_stemmer_and_stop_words(spark):
    df = spark.createDataFrame([("The babies are sleeping quietly in rings",)], "t string")
    lex = df.select(T.lexemes("t").alias("v")).first().v
    assert lex == ["babi", "sleep", "quiet", "ring"]
    only_stop = spark.createDataFrame([("the and of",)], "t string")
    assert only_stop.select(T.lexemes("t").alias("v")).first().v == []
    texts = ["The babies are sleeping", None, "", "running RUNS ran", "a\u00e9b_c 3rd x2", "running\trunning"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.lexemes("t").alias("v")).collect()
    assert {r.i: r.v for r in rows} == {i: T.lexemes_of(t) for i, t in enumerate(texts)}


# words of the published Porter2 description, with their stems
PORTER2 = """consign consigned consigning consignment:consign consist consisted consistency consistent consistently consisting
consists:consist consolation consolations:consol consolatory:consolatori consolidate consolidated consolidating:consolid
consoling:consol consolingly:consol consols:consol consonant:conson consort consorted consorting:consort
conspicuous conspicuously:conspicu conspiracy:conspiraci conspirator conspirators conspire conspired conspiring:conspir
constable constables:constabl constance constancy:constanc constant:constant knack knacks:knack knackeries:knackeri
knag:knag knave knaves:knave knavish:knavish kneaded kneading:knead knee knees:knee kneel kneeled kneeling kneels:kneel
knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight knightly knights:knight knit knits knitted
knitting:knit knives:knive knob knobs:knob knock knocked knocking knocks:knock knocker knockers:knocker knopp:knopp
knot knots:knot
skies:sky dying:die news:news inning innings:inning proceed proceeds:proceed generate generates generated generating:generat
general generally:general generic generically:generic generous generously:generous communism communist:communism|communist
ties:tie cries:cri gas:gas this:this gaps:gap kiwis:kiwi luxuriating:luxuri hopping:hop hoping:hope falling:fall
agreed:agre feed:feed cry:cri by:by say:say happy:happi enjoy enjoyed:enjoy relational:relat conditional:condit
rationalize:ration hopefulness:hope analogi:analog sensibility:sensibl adoption:adopt replacement:replac
running runs:run controlled:control rolling:roll yielding:yield youth:youth boyish:boyish sayings:say"""


def porter2_cases():
    out = []
    for part in re.findall(r"([^:]+):(\S+)", PORTER2.replace("\n", " ")):
        words, stems = part[0].split(), part[1].split("|")
        out += list(zip(words, stems if len(stems) > 1 else stems * len(words)))
    return out


def test_porter2_published_words():
    from cartograph.functions.porter2 import porter2
    assert [(w, porter2(w)) for w, _ in porter2_cases()] == porter2_cases()


def test_porter2_and_its_sql_agree():
    """The column function and the oracle's SQL on every word of the texts and on made-up words."""
    import duckdb
    from cartograph.functions import porter2 as P
    from conftest import SF_SMALL
    from cartograph.plans.stems import stem_ctes
    rnd = random.Random(2)
    con = duckdb.connect()
    words = {w for t in con.execute(f"select text from '{SF_SMALL}/documents.parquet'").fetchall() for w in re.findall(r"[^\W_]+", t[0].lower())}
    ends = [*P.STEP_2, *P.STEP_3, *P.STEP_4, "sses", "ied", "ies", "us", "ss", "s", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "e", "ll", "l"]
    heads = ["", "gener", "commun", "arsen", "y", "ay", "syzy"]
    for _ in range(20_000):
        middle = "".join(rnd.choice("aeiouybdlmnrstvwxz") for _ in range(rnd.randint(0, 6)))
        words.add(rnd.choice(heads) + middle + "".join(rnd.choice(ends) for _ in range(rnd.randint(0, 2))))
    words = sorted((words | {w for w, _ in porter2_cases()} | set(P.WHOLE)) - {""})
    con.execute("create table words(token varchar)")
    con.execute("insert into words select unnest(?)", [words])
    got = dict(con.execute(f"with {stem_ctes('select token from words')} select token, term from st").fetchall())
    assert {w: (got[w], P.porter2(w)) for w in words if got[w] != P.porter2(w)} == {}


def test_name_contains_wildcards_and_backslash(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, "a_b"), (3, "x\\y"), (4, "100% wool")],
                               "id long, name string")
    assert [r.id for r in C.name_contains(df, "R_NG").collect()] == [1]
    assert sorted(r.id for r in C.name_contains(df, "").collect()) == [1, 2, 3, 4]
    assert [r.id for r in C.name_contains(df, "\\").collect()] == [3]
    assert sorted(r.id for r in C.name_contains(df, "%").collect()) == [1, 2, 3, 4]


def test_in_stock_false_means_no_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "id long, stock_qty int")
    assert C.in_stock(df, False).count() == 0
    assert [r.id for r in C.in_stock(df, True).collect()] == [2]


def test_first_image_url(spark):
    df = spark.createDataFrame([(None,), ("[]",), ('[{"url": "/a.jpg", "alt": "x"}]',)], "images string")
    assert [r.u for r in df.select(first_image_url("images").alias("u")).collect()] == [None, None, "/a.jpg"]


def test_promo_rules_at_exact_expiry(spark):
    as_of = TS(2024, 1, 1, 12, 0)
    rows = [("PERCENT", Decimal("10.00"), Decimal("30.00"), 1000, 0, as_of, True, Decimal("80.00")),
            ("FIXED", Decimal("9.99"), Decimal("25.00"), 500, 500, None, True, Decimal("5.00")),
            ("PERCENT", Decimal("20.00"), Decimal("50.00"), None, 9, as_of - dt.timedelta(seconds=1),
             True, Decimal("100.00"))]
    df = spark.createDataFrame(rows, "discount_type string, discount_value decimal(10,2), "
                                     "min_order decimal(10,2), max_uses int, uses_count int, "
                                     "expires_at timestamp_ntz, is_active boolean, total decimal(10,2)")
    out = df.select(M.promo_is_valid("total", F.lit(as_of).cast("timestamp_ntz")).alias("v"),
                    M.promo_discount("total").alias("d")).collect()
    assert [r.v for r in out] == [True, False, False]
    assert [r.d for r in out] == [Decimal("8.00"), Decimal("5.00"), Decimal("20.00")]


def test_delivery_fee_and_date(spark):
    df = spark.createDataFrame([("EXPRESS",), ("standard",), ("SAME_DAY",)], "t string")
    out = df.select(M.delivery_fee("t").alias("f"),
                    M.delivery_date("t", F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")).alias("d")).collect()
    assert [r.f for r in out] == [Decimal("9.99"), Decimal("0.00"), Decimal("19.99")]
    assert [r.d for r in out] == [dt.date(2024, 2, 2), dt.date(2024, 2, 4), dt.date(2024, 2, 2)]


def test_shipping_address_present_null_stays_null(spark):
    df = spark.createDataFrame([('{"name": null, "city": "Austin"}', "Ann Lee"), (None, "Bo Li")],
                               "body string, full string")
    out = df.select(M.shipping_address("body", "full").alias("a")).collect()
    assert out[0].a.recipient_name is None and out[0].a.city == "Austin" and out[0].a.postal_code == "00000"
    assert out[1].a.recipient_name == "Bo Li" and out[1].a.country == "US"


def test_stock_decrement_order_independent(spark):
    products = spark.createDataFrame([(1, 5), (2, 2)], "id long, stock_qty int")
    lines = spark.createDataFrame([(1, 3), (1, 4), (2, 1)], "product_id long, quantity int")
    got = {r.id: r.stock_qty for r in A.decrement_stock(products, lines).collect()}
    assert got == {1: 0, 2: 1}
    # sequential reference loop in any order gives the same
    for order in ([(1, 3), (1, 4)], [(1, 4), (1, 3)]):
        s = 5
        for _, q in order:
            s = max(0, s - q)
        assert s == got[1]


def test_page_and_keyset_agree(spark):
    df = spark.range(0, 95).select(F.col("id"), (F.col("id") % 7).alias("k"))
    order = [F.col("k").desc(), F.col("id").desc()]
    p2 = [r.id for r in page(df, order, 2, 10).collect()]
    p1 = page(df, order, 1, 10).collect()
    last = (p1[-1].k, p1[-1].id)
    assert [r.id for r in page_after(df, ["k", "id"], last, 10).collect()] == p2


def test_place_orders_flow(spark):
    carts = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, user_id long")
    items = spark.createDataFrame([(10, 100, 2, Decimal("5.00")), (10, 101, 1, Decimal("2.50")),
                                   (20, 999, 1, Decimal("1.00"))],
                                  "cart_id long, product_id long, quantity int, unit_price decimal(10,2)")
    products = spark.createDataFrame([(100, "Bib", 1), (101, "Cup", 9)], "id long, name string, stock_qty int")
    users = spark.createDataFrame([(1, "Ann", "Lee"), (2, "Bo", "Li"), (3, "Cy", "Ma")],
                                  "id long, first_name string, last_name string")
    reqs = spark.createDataFrame([(1, 1, 1, "same_day", None), (2, 1, 2, None, None),
                                  (3, 1, 3, "EXPRESS", None), (4, 2, 4, "express", '{"city": "X"}'),
                                  (5, 4, 5, "STANDARD", None)],
                                 "request_id long, user_id long, seq long, delivery_type string, "
                                 "shipping_address string")
    orders, oitems, prods, left, rejects = CH.place_orders(carts, items, products, users, reqs,
                                                           "2024-02-01 00:00:00")
    o = {r.id: r for r in orders.collect()}
    assert set(o) == {2, 4}
    assert o[2].subtotal == Decimal("12.50") and o[2].total == Decimal("12.50")
    assert o[2].estimated_delivery_date == dt.date(2024, 2, 4)
    assert o[4].total == Decimal("10.99") and o[4].address.city == "X"
    assert o[2].address.recipient_name == "Ann Lee"
    rj = {r.request_id: r.reason for r in rejects.collect()}
    assert rj == {1: "INVALID_DELIVERY_TYPE", 3: "CART_EMPTY", 5: "CART_NOT_FOUND"}
    names = {(r.order_id, r.product_id): r.product_name for r in oitems.collect()}
    assert names[(4, 999)] == "Unknown Product"
    assert {r.id: r.stock_qty for r in prods.collect()} == {100: 0, 101: 8}
    assert left.count() == 0
    # invariant: every request is in exactly one of orders and rejects
    assert len(o) + len(rj) == reqs.count()


def _fold_cart_python(start, events):
    """Sequential reference fold for one cart: dict product -> [qty, price]."""
    lines = {p: [q, pr] for p, (q, pr) in start.items()}
    for seq, prod, action, qty, price in events:
        if action == "add":
            if qty <= 0:
                continue
            if prod in lines:
                lines[prod][0] += qty
            else:
                lines[prod] = [qty, price]
        elif action == "set":
            if qty > 0 and prod in lines:
                lines[prod][0] = qty
        elif action == "remove":
            lines.pop(prod, None)
        elif action == "clear":
            lines.clear()
    return lines


@pytest.mark.parametrize("slices", [1024, 3])
def test_fold_cart_matches_sequential_fold(spark, monkeypatch, slices):
    monkeypatch.setattr(CH, "CART_SLICES", slices)
    rnd = random.Random(7)
    items, events, expected = [], [], {}
    seq = 0
    for cart in range(60):
        start = {}
        for p in rnd.sample(range(5), rnd.randint(0, 3)):
            start[p] = (rnd.randint(1, 4), Decimal(rnd.randint(100, 999)) / 100)
            items.append((cart, p, start[p][0], start[p][1]))
        evs = []
        for _ in range(rnd.randint(0, 12)):
            seq += 1
            action = rnd.choice(["add", "add", "set", "remove", "clear"])
            prod = None if action == "clear" else rnd.randrange(5)
            qty = rnd.randint(-1, 4)
            price = Decimal(rnd.randint(100, 999)) / 100
            evs.append((seq, prod, action, qty, price))
            events.append((seq, cart, prod, action, qty, price))
        for p, (q, pr) in _fold_cart_python(start, evs).items():
            expected[(cart, p)] = (q, pr)
    items_df = spark.createDataFrame(items, "cart_id long, product_id long, quantity int, "
                                            "unit_price decimal(10,2)")
    ev_df = spark.createDataFrame(events, "seq long, cart_id long, product_id long, action string, "
                                          "quantity int, price decimal(10,2)")
    got_df, _ = CH.fold_cart(items_df, ev_df)
    got = {(r.cart_id, r.product_id): (r.quantity, r.unit_price) for r in got_df.collect()}
    assert got == expected


def test_assign_slugs_matches_loop(spark):
    existing = ["a", "a-1", "a-3", "b-2", "product", "product-1", "a-1-1"]
    bases = ["a", "a", "a-1", "b", "b", "product", "product", "a-1", "c", "a"]
    new = spark.createDataFrame([(i, i, b) for i, b in enumerate(bases)], "request_id long, seq long, base string")
    got = {r.request_id: r.slug for r in assign_slugs(
        new, spark.createDataFrame([(s,) for s in existing], "slug string")).collect()}
    taken, exp = set(existing), {}
    for i, b in enumerate(bases):
        s, c = b, 1
        while s in taken:
            s = f"{b}-{c}"
            c += 1
        taken.add(s)
        exp[i] = s
    assert got == exp


def test_match_tokens_edges(spark):
    t0 = TS(2024, 1, 1, 10, 0)
    issued = spark.createDataFrame([(1, 7, t0, "EMAIL_VERIFY", "111111"),
                                    (2, 7, t0 + dt.timedelta(minutes=5), "EMAIL_VERIFY", "222222"),
                                    (3, 8, t0, "EMAIL_VERIFY", "333333")],
                                   "token_id long, user_id long, issued_at timestamp_ntz, purpose string, code string")
    attempts = spark.createDataFrame([
        (10, 7, t0 + dt.timedelta(minutes=1), "EMAIL_VERIFY", "111111"),   # valid, consumes 1
        (11, 7, t0 + dt.timedelta(minutes=2), "EMAIL_VERIFY", "111111"),   # already used
        (12, 7, t0 + dt.timedelta(minutes=5), "EMAIL_VERIFY", "111111"),   # voided by re-issue
        (13, 8, t0 + dt.timedelta(minutes=15), "EMAIL_VERIFY", "333333"),  # expiry instant: valid
        (14, 7, t0 + dt.timedelta(minutes=21), "EMAIL_VERIFY", "222222"),  # past 15 min
        (15, 9, t0, "EMAIL_VERIFY", "000000")],
        "attempt_id long, user_id long, attempted_at timestamp_ntz, purpose string, code string")
    got = {r.attempt_id: (r.token_id, r.valid, r.matched) for r in match_tokens(issued, attempts).collect()}
    assert got == {10: (1, True, True), 11: (1, True, False), 12: (2, False, False),
                   13: (3, True, True), 14: (None, False, False), 15: (None, False, False)}


def _lockout_python(rows, verified, suspended):
    state, out = {}, {}
    for eid, uid, ts, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        failed, locked = state.get(uid, (0, None))
        if locked is not None and locked > ts:
            res = "LOCKED"
        elif suspended.get(uid, False):
            res = "SUSPENDED"
        elif not verified.get(uid, False):
            res = "UNVERIFIED"
        elif ok:
            if failed > 0:
                failed, locked = 0, None
            res = "OK"
        else:
            failed += 1
            if failed >= 5:
                locked = ts + dt.timedelta(minutes=15)
                res = "LOCKED_NOW"
            else:
                res = "FAILED"
        state[uid] = (failed, locked)
        out[eid] = res
    return out


def test_lockout_five_failures_then_lock(spark):
    t0 = TS(2024, 1, 1, 9, 0)
    m = dt.timedelta(minutes=1)
    rows = [(i, 1, t0 + i * m, False) for i in range(5)]                 # 5th locks
    rows += [(5, 1, t0 + 10 * m, False),                                 # during lock
             (6, 1, t0 + 4 * m + dt.timedelta(minutes=15), False),       # lock end: still counted
             (7, 1, t0 + 40 * m, True), (8, 1, t0 + 41 * m, False)]       # success clears
    users = spark.createDataFrame([(1, True, False)], "id long, email_verified boolean, is_suspended boolean")
    att = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, success boolean")
    got = {r.event_id: r.outcome for r in lockouts_batch(att, users).collect()}
    assert [got[i] for i in range(9)] == ["FAILED"] * 4 + ["LOCKED_NOW", "LOCKED", "LOCKED_NOW", "OK", "FAILED"]


def test_lockout_matches_python_fold_on_events(spark):
    from conftest import SF_MID
    from cartograph.sources.shop import Shop
    shop = Shop(spark, SF_MID)
    logins = shop.logins
    users = shop.users
    got = {r.event_id: r.outcome for r in lockouts_batch(logins, users).collect()}
    rows = [(r.event_id, r.user_id, r.ts, r.success) for r in logins.collect()]
    ver = {r.id: r.email_verified for r in users.select("id", "email_verified").collect()}
    sus = {r.id: r.is_suspended for r in users.select("id", "is_suspended").collect()}
    assert got == _lockout_python(rows, ver, sus)


def test_registration_checks(spark):
    users = spark.createDataFrame([("taken@x.io",)], "email string")
    reqs = spark.createDataFrame([
        (1, 1, "taken@x.io", "A", "B", "password1", "CUSTOMER", None, None),
        (2, 2, "new@x.io", "A", "B", "password1", "SELLER", " ", None),
        (3, 3, "new@x.io", "A", "B", "password1", "CUSTOMER", None, None),
        (4, 4, "new@x.io", "A", "B", "password1", "CUSTOMER", None, None),
        (5, 5, "bad", "", "B", "short", "ADMIN", None, "code"),
        (6, 6, "adm@x.io", "A", "B", "password1", "ADMIN", None, "wrong")],
        "request_id long, seq long, email string, first_name string, last_name string, "
        "password string, role string, store_name string, admin_code string")
    ok, bad = CH.validate_registrations(reqs, users, "code")
    assert [r.request_id for r in ok.collect()] == [3]
    errs = {r.request_id: (r.error, dict(r.field_errors)) for r in bad.collect()}
    assert errs[1][0] == "EMAIL_TAKEN"
    assert errs[2][0] == "STORE_NAME_MISSING"
    assert errs[4][0] == "EMAIL_TAKEN"
    assert errs[5][0] == "INVALID_FIELDS"
    assert set(errs[5][1]) == {"email", "firstName", "password"}
    assert errs[6][0] == "ADMIN_CODE_WRONG"


def test_erase_users_cascade_and_restrict(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    sellers = spark.createDataFrame([(10, 1)], "id long, user_id long")
    products = spark.createDataFrame([(100, 10), (101, 99)], "id long, seller_id long")
    orders = spark.createDataFrame([(500, 2)], "id long, user_id long")
    order_items = spark.createDataFrame([(500, 100), (500, 101)], "order_id long, product_id long")
    reviews = spark.createDataFrame([(7, 3, 101), (8, 2, 100)], "id long, user_id long, product_id long")
    out, restricted = CH.erase_users(
        {"users": users, "seller_profiles": sellers, "products": products, "orders": orders,
         "order_items": order_items, "reviews": reviews},
        spark.createDataFrame([(1,), (2,)], "user_id long"))
    assert sorted(r.id for r in out["users"].collect()) == [2, 3]
    assert [r.user_id for r in restricted.collect()] == [2]
    assert out["seller_profiles"].count() == 0
    assert [r.id for r in out["products"].collect()] == [101]
    assert sorted((r.product_id is None) for r in out["order_items"].collect()) == [False, True]
    assert [r.id for r in out["reviews"].collect()] == [7]


def test_apply_patches_present_null_overwrites(spark):
    base = spark.createDataFrame([(1, "Ann", "Lee", "+1", "/a.png")],
                                 "id long, first_name string, last_name string, phone string, avatar_url string")
    patches = spark.createDataFrame([(1, 1, '{"phone": "+2"}'), (2, 1, '{"phone": null, "firstName": "Pat"}'),
                                     (3, 1, '{}')], "seq long, id long, body string")
    out, _ = CH.apply_patches(base, patches, "id")
    r = out.first()
    assert (r.first_name, r.last_name, r.phone, r.avatar_url) == ("Pat", "Lee", None, "/a.png")


def test_suggest_min_prefix_and_limit(spark):
    names = [f"ring {i:02d}" for i in range(15)] + ["Rope", "draft ring"]
    products = spark.createDataFrame([(i, n, True) for i, n in enumerate(names)],
                                     "id long, name string, is_active boolean")
    prefixes = spark.createDataFrame([(1, "RI"), (2, " r"), (3, "r_p"), (4, "dr")],
                                     "request_id long, prefix string")
    got = {}
    for r in C.suggest(products, prefixes).collect():
        got.setdefault(r.request_id, []).append(r.name)
    assert len(got[1]) == 10 and got[1][0] == "ring 00"
    assert 2 not in got
    assert got[3] == ["Rope"]
    assert got[4] == ["draft ring"]


def test_seller_ratings_weighted_by_review(spark):
    sellers = spark.createDataFrame([(1,), (2,)], "id long")
    products = spark.createDataFrame([(10, 1), (11, 1)], "id long, seller_id long")
    reviews = spark.createDataFrame([(10, 5, False), (11, 4, False), (11, 4, False), (11, 1, True)],
                                    "product_id long, rating smallint, is_hidden boolean")
    got = {r.seller_id: (r.rating_avg, r.review_count) for r in
           A.seller_ratings(sellers, products, reviews).collect()}
    assert got == {1: (Decimal("4.33"), 3), 2: (Decimal("0.00"), 0)}


def test_slug_family_rule(spark):
    df = spark.createDataFrame([("a-1-2",), ("a",), ("b-x-3",)], "s string")
    assert [r.f for r in df.select(T.slug_family("s").alias("f")).collect()] == ["a", "a", "b-x"]
    assert re.sub(r"(-[0-9]+)+$", "", "a-1-2") == "a"


def test_active_faqs_and_categories_order(spark):
    faqs = spark.createDataFrame([(1, "Returns?", 3, True), (2, "Shipping?", 1, True),
                                  (3, "Old", 2, False)],
                                 "id long, question string, sort_order int, is_active boolean")
    assert [r.id for r in C.active_faqs(faqs).collect()] == [2, 1]
    cats = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, sort_order int")
    assert [r.id for r in C.ordered_categories(cats).collect()] == [2, 3, 1]


def test_quote_promos_modes(spark):
    from cartograph.operators.pricing import quote_promos
    req = spark.createDataFrame([(1, "baby10", Decimal("40.00")), (2, " BABY10", Decimal("40.00")),
                                 (3, "FreeShip", Decimal("5.00")), (4, None, Decimal("1.00"))],
                                "request_id long, code string, subtotal decimal(10,2)")
    lenient = {r.request_id: (r.quoted_code, r.discount, r.discount_type, r.valid)
               for r in quote_promos(req, strict=False).collect()}
    assert lenient == {1: ("BABY10", Decimal("10.00"), "PERCENT", True), 2: (None, None, None, False),
                       3: ("FREESHIP", Decimal("9.99"), "FIXED", True), 4: (None, None, None, False)}
    promos = spark.createDataFrame(
        [("BABY10", "PERCENT", Decimal("10.00"), Decimal("30.00"), 1000, 0, TS(2024, 1, 1), True),
         ("FREESHIP", "FIXED", Decimal("9.99"), Decimal("25.00"), 500, 0, TS(2024, 1, 1), True)],
        "code string, discount_type string, discount_value decimal(10,2), min_order decimal(10,2), "
        "max_uses int, uses_count int, expires_at timestamp_ntz, is_active boolean")
    strict = {r.request_id: (r.discount, r.valid) for r in
              quote_promos(req, promos, strict=True, as_of="2024-01-01 00:00:00").collect()}
    assert strict == {1: (Decimal("4.00"), True), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_match_tokens_across_time_slices(spark):
    t = TS(2024, 1, 1, 10, 14, 59)
    issued = spark.createDataFrame([(1, 7, t, "P", "111111"), (2, 8, t, "P", "222222"),
                                    (3, 8, TS(2024, 1, 1, 10, 20), "P", "333333")],
                                   "token_id long, user_id long, issued_at timestamp_ntz, purpose string, code string")
    attempts = spark.createDataFrame([
        (10, 7, TS(2024, 1, 1, 10, 29, 59), "P", "111111"),   # exactly at expiry, next slice
        (11, 7, TS(2024, 1, 1, 10, 30, 0), "P", "111111"),    # one second late (already used anyway)
        (12, 8, TS(2024, 1, 1, 10, 29, 0), "P", "222222"),    # voided by the 10:20 re-issue
        (13, 8, TS(2024, 1, 1, 10, 35, 0), "P", "333333")],   # code 3 still in force
        "attempt_id long, user_id long, attempted_at timestamp_ntz, purpose string, code string")
    got = {r.attempt_id: (r.token_id, r.valid, r.matched) for r in match_tokens(issued, attempts).collect()}
    assert got == {10: (1, True, True), 11: (None, False, False), 12: (3, False, False),
                   13: (3, True, True)}


def test_cumulative_sum_hot_key_over_partitions(spark):
    from cartograph.operators.common import cumulative_sum
    rows = [("hot", i, 1) for i in range(3000)] + [("cold", i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    got = {(r.k, r.s): r.c for r in cumulative_sum(df, ["k"], ["s"], "v", "c", partitions=7).collect()}
    assert got[("hot", 0)] == 1 and got[("hot", 2999)] == 3000
    assert got[("cold", 49)] == 100
    assert all(got[("hot", i)] == i + 1 for i in range(3000))


def test_assign_slugs_hot_base_matches_loop(spark):
    existing = ["product", "product-2", "product-5", "product-40", "product-07", "other"]
    new = spark.createDataFrame([(i, 1000 - i, "product") for i in range(600)],
                                "request_id long, seq long, base string")
    got = {r.request_id: r.slug for r in assign_slugs(
        new, spark.createDataFrame([(s,) for s in existing], "slug string")).collect()}
    taken, exp = set(existing), {}
    for i in sorted(range(600), key=lambda i: 1000 - i):
        s, c = "product", 1
        while s in taken:
            s = f"product-{c}"
            c += 1
        taken.add(s)
        exp[i] = s
    assert got == exp


def _slug_loop(existing, requests):
    taken, out = set(existing), {}
    for rid, _, base in sorted(requests, key=lambda r: (r[1], r[0])):
        s, c = base, 1
        while s in taken:
            s = f"{base}-{c}"
            c += 1
        taken.add(s)
        out[rid] = s
    return out


def test_assign_slugs_random_families_match_loop(spark):
    rnd = random.Random(11)
    pool = ["a", "a-1", "a-2", "a-1-1", "a-1-2", "a-3", "a-10", "b", "b-1", "b-1-1", "product", "product-1"]
    existing_pool = pool + ["a-4", "a-1-3", "b-2", "a-01", "product-2"]
    reqs, ex, rid = [], [], 0
    for case in range(120):
        prefix = f"c{case}"
        ex += [f"{prefix}{e}" for e in rnd.sample(existing_pool, rnd.randint(0, 6))]
        for _ in range(rnd.randint(1, 25)):
            reqs.append((rid, rnd.randint(0, 6), f"{prefix}{rnd.choice(pool)}"))
            rid += 1
    new = spark.createDataFrame(reqs, "request_id long, seq long, base string")
    got = {r.request_id: r.slug for r in assign_slugs(
        new, spark.createDataFrame([(s,) for s in ex], "slug string")).collect()}
    assert got == _slug_loop(ex, reqs)


def test_sinks_rewrite_and_postings_layout(spark, scratch):
    import os
    from cartograph.operators.search import build_postings, write_postings
    from cartograph.streaming.sources import table_stream
    path = os.path.join(scratch, "snap")
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id long, v string, part int")
    CH.write_snapshot(df, path, ["part"])
    CH.write_snapshot(df.where("part = 1").withColumn("v", F.lit("z")), path, ["part"])
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {1: "a", 2: "z"}          # only partition 1 was rewritten
    docs = spark.createDataFrame([(1, "Red rings ring"), (2, "blue")], "doc_id long, text string")
    ppath = os.path.join(scratch, "postings")
    write_postings(build_postings(docs, "doc_id", ["text"]), ppath)
    assert sorted((r.term, r.doc_id) for r in spark.read.parquet(ppath).collect()) == \
        [("blue", 2), ("red", 1), ("ring", 1)]
    from conftest import SF_SMALL
    assert table_stream(spark, SF_SMALL, "events").isStreaming


def test_lockout_segments_match_fold_on_random_histories(spark):
    rnd = random.Random(5)
    t0 = TS(2024, 1, 1)
    rows, ver, sus, eid = [], {}, {}, 0
    for uid in range(40):
        ver[uid] = rnd.random() > 0.1
        sus[uid] = rnd.random() < 0.05
        minute = 0
        for _ in range(rnd.randint(0, 70)):
            minute += rnd.choice([0, 1, 2, 3, 7, 15, 16, 30])
            rows.append((eid, uid, t0 + dt.timedelta(minutes=minute, seconds=rnd.choice([0, 0, 30])),
                         rnd.random() < 0.3))
            eid += 1
    users = spark.createDataFrame([(u, ver[u], sus[u]) for u in ver],
                                  "id long, email_verified boolean, is_suspended boolean")
    att = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, success boolean")
    got = {r.event_id: r.outcome for r in lockouts_batch(att, users).collect()}
    assert got == _lockout_python(rows, ver, sus)


def test_quality_checks_find_each_violation(spark):
    from cartograph.operators import quality as Q
    rows = spark.createDataFrame(
        [(1, "a@x", 3, "LIVE", "x" * 5, 12.5, 2), (2, None, 7, "GONE", "y" * 300, 123456789012.0, 2),
         (3, "a@x", None, None, None, None, 99)],
        "id long, email string, rating int, status string, name string, price double, cat long")
    parents = spark.createDataFrame([(2,)], "id long")
    got = Q.stack_violations(
        Q.not_null(rows, "t", ["email", "rating"]),
        Q.check(rows, "t", "rating_1_5", F.col("rating").between(1, 5), value=F.col("rating")),
        Q.unique(rows, "t", ["email"]),
        Q.orphans(rows, "t", "cat", parents, parent_table="p"),
        Q.domain(rows, "t", "status", ["LIVE", "DRAFT"]),
        Q.max_length(rows, "t", "name", 255),
        Q.decimal_fit(rows, "t", "price", 10, 2),
        Q.drift(spark.createDataFrame([(1, 3), (2, 5)], "id long, n int"),
                spark.createDataFrame([(1, 3), (2, 4)], "id long, n int"), "t", ["id"], ["n"]))
    found = sorted((r.rule, r.key) for r in got.collect())
    assert found == sorted([("not_null:email", "2"), ("not_null:rating", "3"), ("check:rating_1_5", "2"),
                            ("unique:email", "a@x"), ("fk:cat->p", "3"), ("domain:status", "2"),
                            ("length:name>255", "2"), ("decimal:price(10,2)", "2"), ("drift:n", "2")])


def test_assign_slugs_many_numbered_children(spark):
    rnd = random.Random(3)
    bases = ["item"] + [f"item-{i}" for i in range(1, 300)]
    reqs = [(i, rnd.randint(0, 50), rnd.choice(bases[:1] * 200 + bases)) for i in range(900)]
    existing = ["item", "item-3", "item-7", "item-250", "item-2-1"]
    new = spark.createDataFrame(reqs, "request_id long, seq long, base string")
    got = {r.request_id: r.slug for r in assign_slugs(
        new, spark.createDataFrame([(s,) for s in existing], "slug string")).collect()}
    assert got == _slug_loop(existing, reqs)


def test_set_status_and_cancel_rules(spark):
    orders = spark.createDataFrame([(1, 10, "CONFIRMED"), (2, 10, "DELIVERED"), (3, 11, "PROCESSING")],
                                   "id long, user_id long, status string")
    users = spark.createDataFrame([(10, "CUSTOMER"), (11, "CUSTOMER"), (99, "ADMIN")], "id long, role string")
    reqs = spark.createDataFrame([(1, 1, 1, 10), (2, 2, 1, 10), (3, 3, 2, 10), (4, 4, 3, 10),
                                  (5, 5, 3, 99), (6, 6, 7, 10)],
                                 "request_id long, seq long, order_id long, caller_id long")
    new_orders, outcomes = CH.cancel_orders(orders, users, reqs)
    got = {r.request_id: (r.outcome, r.blocking_status) for r in outcomes.collect()}
    assert got == {1: ("CANCELLED", None), 2: ("CONFLICT", "CANCELLED"), 3: ("CONFLICT", "DELIVERED"),
                   4: ("FORBIDDEN", None), 5: ("CANCELLED", None), 6: ("NOT_FOUND", None)}
    assert {r.id: r.status for r in new_orders.collect()} == {1: "CANCELLED", 2: "DELIVERED", 3: "CANCELLED"}
    ups = spark.createDataFrame([(1, 1, 1, "shipped"), (2, 2, 1, "Delivered"), (3, 3, 2, "LOST"),
                                 (4, 4, 9, "SHIPPED")], "request_id long, seq long, order_id long, status string")
    after, rejects = CH.set_status(orders, ups)
    assert {r.id: r.status for r in after.collect()} == {1: "DELIVERED", 2: "DELIVERED", 3: "PROCESSING"}
    assert {r.request_id: r.reason for r in rejects.collect()} == {3: "invalid status", 4: "order not found"}


import pytest  # noqa: E402


@pytest.mark.parametrize("seed", [9, 21])
def test_lockout_of_a_long_history_matches_fold(spark, seed):
    rnd = random.Random(seed)
    t0 = TS(2024, 1, 1)
    rows, ver, sus, eid = [], {}, {}, 0
    for uid in range(25):
        ver[uid] = rnd.random() > 0.1
        sus[uid] = rnd.random() < 0.05
        minute = 0
        # user 0 is a bot: a long history of mostly failures
        for _ in range(400 if uid == 0 else rnd.randint(0, 80)):
            minute += rnd.choice([0, 1, 2, 3, 5, 7, 14, 15, 16, 30])
            rows.append((eid, uid, t0 + dt.timedelta(minutes=minute, seconds=rnd.choice([0, 0, 30])),
                         rnd.random() < 0.15))
            eid += 1
    users = spark.createDataFrame([(u, ver[u], sus[u]) for u in ver],
                                  "id long, email_verified boolean, is_suspended boolean")
    att = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, success boolean")
    cols = ["event_id", "outcome", "failed_attempts", "locked_until"]
    a = sorted(tuple(r[c] for c in cols) for r in lockouts_batch(att, users).collect())
    assert len(a) == len(rows)
    assert {r[0]: r[1] for r in a} == _lockout_python(rows, ver, sus)


def test_stored_search_vector_gives_same_hits(spark):
    from conftest import SF_SMALL
    from cartograph.sources.shop import Shop
    shop = Shop(spark, SF_SMALL)
    plain = C.search_filter(shop.products, shop.categories, q="Red Rings", stock=True)
    stored = C.search_filter(C.with_search_vector(shop.products), shop.categories, q="Red Rings", stock=True)
    assert sorted(r.id for r in plain.collect()) == sorted(r.id for r in stored.collect())
    assert plain.count() > 0


def test_upsert_and_resolve_keys(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, qty int")
    changes = spark.createDataFrame([(2, "b1", 21, 5), (2, "b2", 22, 7), (3, "c", 30, 1)],
                                    "id long, name string, qty int, seq long")
    got = {r.id: (r.name, r.qty) for r in CH.upsert(base, changes, ["id"]).collect()}
    assert got == {1: ("a", 10), 2: ("b2", 22), 3: ("c", 30)}
    users = spark.createDataFrame([(7, "ann@x.io")], "id long, email string")
    rows = spark.createDataFrame([(1, "ann@x.io"), (2, "ANN@x.io"), (3, None)], "row_id long, email string")
    ok, bad = CH.resolve_keys(rows, users, "email", "user_id")
    assert [(r.row_id, r.user_id) for r in ok.collect()] == [(1, 7)]
    assert sorted(r.row_id for r in bad.collect()) == [2, 3]


def _lockout_states(rows):
    """The reference loop with its state and password resets: {event: (outcome, failed, until)}."""
    state, out = {}, {}
    for e, u, ts, ok, reset in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        failed, until = state.get(u, (0, None))
        if reset:
            failed, until, outcome = 0, None, "RESET"
        elif until and until > ts:
            outcome = "LOCKED"
        elif ok:
            failed, until, outcome = 0, None, "OK"
        else:
            failed += 1
            outcome = "LOCKED_NOW" if failed >= 5 else "FAILED"
            until = ts + dt.timedelta(minutes=15) if failed >= 5 else until
        state[u] = failed, until
        out[e] = outcome, failed, until
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lockout_summaries_of_small_chunks(spark, seed):
    """Chunks of a few rows: histories run over dozens of them, locks over
    several, a user under attack fails always, and some passwords are reset."""
    rnd = random.Random(seed)
    rows, t0 = [], TS(2024, 1, 1)
    for uid, n, step, ok in ((1, 400, [0, 1, 2, 3, 16], 0.0), (2, 300, [0, 0, 0, 1], 0.02), (3, 300, [1, 5, 14, 15, 16, 40], 0.2),
                             *[(u, rnd.randint(0, 12), [0, 1, 15], 0.3) for u in range(4, 40)]):
        minute = 0
        for _ in range(n):
            minute += rnd.choice(step)
            rows.append((len(rows), uid, t0 + dt.timedelta(minutes=minute, seconds=rnd.choice([0, 0, 30])), rnd.random() < ok,
                         uid != 1 and rnd.random() < 0.02))
    users = spark.createDataFrame([(u, True, False) for u in range(40)], "id long, email_verified boolean, is_suspended boolean")
    att = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, success boolean, reset boolean")
    got = {r.event_id: (r.outcome, r.failed_attempts, r.locked_until)
           for r in lockouts_batch(att, users, chunk=[7, 20, 60, 10 ** 6][seed]).collect()}
    assert got == _lockout_states(rows)
    assert lockouts_batch(att.limit(0), users).count() == 0


def test_slug_contests_in_rounds(spark):
    """One family of 60,000 numbered children and 100,000 contests in runs of 20,000, which
    depend on all those before, and a family with numbers within numbers; against the
    reference loop."""
    from cartograph.operators.slugs import settle
    rnd = random.Random(6)
    reqs = [(0, 0, "big")]
    for n in range(1, 60_000):  # children in a random order, parent requests between them
        reqs.append((len(reqs), rnd.randint(0, 10 ** 6), f"big-{n}"))
    reqs += [(len(reqs) + i, rnd.randint(0, 10 ** 6), "big") for i in range(40_000)]
    for n in range(2000):
        name = "deep" + "".join(f"-{rnd.choice([1, 1, 2, 3])}" for _ in range(rnd.randint(0, 5)))
        reqs.append((len(reqs), rnd.randint(0, 1000), name))
    existing = ["big-5", "big-70", "deep-1-1", "deep-2"] + [f"big-{n}" for n in range(300, 400)]
    new = spark.createDataFrame(reqs, "request_id long, seq long, base string")
    got = {r.request_id: r.slug for r in assign_slugs(new, spark.createDataFrame([(x,) for x in existing], "slug string")).collect()}
    taken, want, at = set(existing), {}, {}
    for rid, _, base in sorted(reqs, key=lambda r: (r[1], r[0])):
        c = at.get(base, 0)  # all smaller candidates are taken already
        while (s := f"{base}-{c}" if c else base) in taken:
            c += 1
        at[base] = c
        taken.add(s)
        want[rid] = s
    assert got == want
    # the same counts, a run at a time
    v = [rnd.randint(-3, i + 3) // rnd.choice([1, 2, 5]) for i in range(100_000)]
    rows = spark.createDataFrame([("p", f"p-{i + 1}", i, i + 1, x) for i, x in enumerate(v)], "parent string, child string, i long, n long, v long")
    lost, flags = 0, {}
    for i, x in enumerate(v):
        flags[i + 1] = x > lost
        lost += x > lost
    assert {r.n: r.lost for r in settle(rows, run=20_000).collect()} == flags


def test_session_rules_bound_what_a_merged_task_reads(spark):
    from cartograph.session import apply_session_rules
    key, was = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get(
        "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        for asked, held in [("64MB", "16m"), ("67108864b", "16m"), ("1g", "16m"), ("8m", "8m"), ("512k", "512k")]:
            spark.conf.set(key, asked)
            apply_session_rules(spark)
            assert spark.conf.get(key) == held
        spark.conf.unset(key)
        apply_session_rules(spark)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, was)
