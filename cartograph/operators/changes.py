"""Bulk change jobs: request handlers re-aimed at batches (CHG-1..11, CHG-13,
SNK-1, SRC-2, SCL-6, JON-6).

A job takes a snapshot and a batch of requests and returns the new snapshot
(or the changed rows) and a ``rejects`` frame, so every request ends up in
exactly one of the two. Requests on the same key are ordered by an explicit
``seq`` column. Order-dependent rules are written as grouped aggregates
(``max_by`` / ``min_by`` / conditional ``min``) keyed by the entity, so each
key is reduced map-side before the shuffle and no group is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions import money as M
from cartograph.functions import text as T
from cartograph.operators.analytics import authorise_order_access, decrement_stock
from cartograph.operators.common import stack_rows, stash, ts_lit

NEVER = -(2 ** 62)  # a seq before every request


# ---------------------------------------------------------------- loading --
def resolve_keys(rows: DataFrame, dim: DataFrame, natural_key: str, id_col: str,
                 dim_key: str | None = None, dim_id: str = "id"):
    """SRC-2: fill ``id_col`` from ``dim`` by natural key (e-mail, slug).
    Returns ``(resolved, rejects)``; a row whose key is unknown is a reject."""
    d = dim.select(F.col(dim_key or natural_key).alias("_nk"), F.col(dim_id).alias(id_col))
    resolved = rows.join(d, rows[natural_key] == d["_nk"], "inner").drop("_nk")
    rejects = rows.join(d, rows[natural_key] == d["_nk"], "left_anti") \
        .withColumn("reason", F.lit(f"unknown {natural_key}"))
    return resolved, rejects


def parse_enum(df: DataFrame, col: str, domain, default: str | None = None):
    """SCL-6: upper-case ``col``; members of ``domain`` are kept (upper-cased),
    the rest are rejects. A null takes ``default`` when one is given."""
    v = F.upper(F.col(col))
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    ok_cond = F.coalesce(v.isin(*domain), F.lit(False))
    x = df.withColumn("_v", v).withColumn("_ok", ok_cond)
    ok = x.where("_ok").withColumn(col, F.col("_v")).drop("_v", "_ok")
    bad = x.where(~F.col("_ok")).drop("_v", "_ok") \
        .withColumn("reason", F.lit(f"invalid {col}"))
    return ok, bad


def latest(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last change per key by ``seq`` (``max_by`` of the whole row)."""
    others = [c for c in changes.columns if c not in keys]
    agg = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
    return agg.select(*keys, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """SNK-1: insert keys that are new, overwrite keys that exist; the last
    change per key wins. A change whose key is null in any part is a new row
    of its own and always inserted. ``changes`` carries the base columns plus
    ``seq``."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    last = latest(changes.where(keyed), keys, seq).select(*base.columns)
    new = changes.where(~keyed).select(*base.columns)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last).unionByName(new)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a snapshot as parquet, overwriting only the partitions present
    (dynamic partition overwrite), so a re-run after a lost executor or a
    failed job rewrites the same files."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# ------------------------------------------------------------ place orders --
def place_orders(carts: DataFrame, items: DataFrame, products: DataFrame, users: DataFrame,
                 requests: DataFrame, as_of, orders: DataFrame | None = None):
    """CHG-1 (flagship): check out carts for a batch of requests.

    ``requests``: request_id, user_id, seq, delivery_type, shipping_address.
    Per user, in ``seq`` order: no cart -> ``CART_NOT_FOUND``; the first
    request with a valid delivery type (null means STANDARD) takes the cart
    when it has lines, every later one finds it empty (``CART_EMPTY``);
    invalid types before that are ``INVALID_DELIVERY_TYPE``. An order:
    subtotal = sum(snapshot unit price x qty), fee PRC-1, discount 0,
    total = subtotal + fee - discount, status CONFIRMED, delivery date
    PRC-2, address SCL-5. Its id follows the largest id of the existing
    ``orders`` in order of the request id (without ``orders`` it is the
    request id). Lines copy the product name ('Unknown Product' when the
    product is gone) and the variant, where the cart lines have one; stock is
    lowered by AGG-12 and never blocks a sale; the cart is emptied.

    Returns ``(orders, order_items, products, cart_items, rejects)``.
    """
    dt = F.upper(F.coalesce(F.col("delivery_type"), F.lit("STANDARD")))
    req = requests.withColumn("_dt", dt) \
        .withColumn("_valid", F.coalesce(dt.isin(*M.DELIVERY_TYPES), F.lit(False)))
    per_cart = items.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum(F.col("unit_price") * F.col("quantity")).alias("_subtotal"))
    cart = carts.select(F.col("id").alias("cart_id"), "user_id") \
        .join(per_cart, "cart_id", "left")
    win = req.where("_valid").groupBy("user_id").agg(F.min("seq").alias("_win_seq"))
    x = req.join(cart, "user_id", "left").join(win, "user_id", "left")
    reason = (F.when(F.col("cart_id").isNull(), F.lit("CART_NOT_FOUND"))
               .when(F.coalesce(F.col("_lines"), F.lit(0)) == 0, F.lit("CART_EMPTY"))
               .when(F.col("seq") > F.col("_win_seq"), F.lit("CART_EMPTY"))
               .when(~F.col("_valid"), F.lit("INVALID_DELIVERY_TYPE")))
    x = x.withColumn("reason", reason)
    rejects = x.where(F.col("reason").isNotNull()).select("request_id", "user_id", "reason")
    won = x.where(F.col("reason").isNull())

    full = users.select(F.col("id").alias("user_id"),
                        F.concat_ws(" ", "first_name", "last_name").alias("_full"))
    fee = M.delivery_fee(F.col("_dt"))
    subtotal = F.col("_subtotal").cast("decimal(12,2)")
    discount = F.lit(0).cast("decimal(12,2)")
    new_id = F.col("request_id")
    if orders is not None:
        new_id = orders.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar() + 1 + new_id \
            - requests.agg(F.min("request_id").cast("bigint")).scalar()
    placed = won.join(full, "user_id", "left").select(
        new_id.alias("id"), "user_id", "cart_id",
        subtotal.alias("subtotal"), fee.alias("delivery_fee"), discount.alias("discount"),
        (subtotal + fee - discount).cast("decimal(12,2)").alias("total"),
        F.col("_dt").alias("delivery_type"), F.lit("CONFIRMED").alias("status"),
        M.delivery_date(F.col("_dt"), ts_lit(as_of)).alias("estimated_delivery_date"),
        M.shipping_address("shipping_address", "_full").alias("address"),
        ts_lit(as_of).alias("created_at"))

    taken = placed.select(F.col("id").alias("order_id"), "cart_id")
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("_pname"))
    lines = items.join(taken, "cart_id")
    order_items = lines.join(names, "product_id", "left").select(
        "order_id", "product_id", *(["variant_id"] if "variant_id" in items.columns else []),
        F.coalesce("_pname", F.lit("Unknown Product")).alias("product_name"), "quantity", "unit_price")
    new_products = decrement_stock(products, lines.select("product_id", "quantity"))
    new_items = items.join(taken.select("cart_id"), "cart_id", "left_anti")
    return placed, order_items, new_products, new_items, rejects


# ---------------------------------------------------------- order changes --
def cancel_orders(orders: DataFrame, users: DataFrame, requests: DataFrame):
    """CHG-2: cancel by owner or admin (JON-4), only from CONFIRMED or
    PROCESSING. Per order, the first allowed request (by ``seq``) on a
    cancellable order succeeds; later ones meet CANCELLED. Stock is not given
    back. Returns ``(orders, outcomes)`` with outcome CANCELLED, NOT_FOUND,
    FORBIDDEN or CONFLICT and the ``blocking_status``."""
    acc = authorise_order_access(requests.select("request_id", "order_id", "caller_id"),
                                 orders, users)
    x = requests.select("request_id", "seq").join(acc, "request_id") \
        .join(orders.select(F.col("id").alias("order_id"), F.col("status").alias("_status")),
              "order_id", "left")
    first_ok = x.where("allowed").groupBy("order_id").agg(F.min("seq").alias("_first"))
    x = x.join(first_ok, "order_id", "left")
    cancellable = F.col("_status").isin(*M.CANCELLABLE)
    outcome = (F.when(~F.col("found"), F.lit("NOT_FOUND"))
                .when(~F.col("allowed"), F.lit("FORBIDDEN"))
                .when((F.col("seq") == F.col("_first")) & cancellable, F.lit("CANCELLED"))
                .otherwise(F.lit("CONFLICT")))
    blocking = (F.when(outcome != "CONFLICT", F.lit(None).cast("string"))
                 .when(cancellable & (F.col("seq") > F.col("_first")), F.lit("CANCELLED"))
                 .otherwise(F.col("_status")))
    outcomes = x.select("request_id", "order_id", "caller_id", outcome.alias("outcome"),
                        blocking.alias("blocking_status"))
    done = outcomes.where(F.col("outcome") == "CANCELLED").select("order_id").distinct()
    new_orders = orders.join(done.withColumnRenamed("order_id", "id").withColumn("_c", F.lit(True)),
                             "id", "left") \
        .withColumn("status", F.when(F.col("_c"), F.lit("CANCELLED")).otherwise(F.col("status"))) \
        .drop("_c")
    return new_orders, outcomes


def set_status(orders: DataFrame, requests: DataFrame, seq: str = "seq"):
    """CHG-3: an admin sets any status from any status; the last valid
    request per order wins. Unknown status text or order is a reject.
    Returns ``(orders, rejects)``."""
    ok, bad = parse_enum(requests, "status", M.ORDER_STATUSES)
    ids = orders.select(F.col("id").alias("order_id"))
    known = ok.join(ids, "order_id", "left_semi")
    missing_order = ok.join(ids, "order_id", "left_anti").withColumn("reason", F.lit("order not found"))
    last = known.groupBy("order_id").agg(F.max_by("status", seq).alias("_new"))
    new_orders = orders.join(last.withColumnRenamed("order_id", "id"), "id", "left") \
        .withColumn("status", F.coalesce("_new", "status")).drop("_new")
    rejects = bad.select("request_id", "order_id", "reason") \
        .unionByName(missing_order.select("request_id", "order_id", "reason"))
    return new_orders, rejects


# ---------------------------------------------------------------- cart fold --
CART_ACTIONS = ("add", "set", "remove", "clear")


def judge_cart_events(items: DataFrame, events: DataFrame, products: DataFrame | None = None,
                      seq: str = "seq") -> DataFrame:
    """Every cart event, and every stored line as an ``add`` before all events,
    with the line's fate: ``reason`` (null: the event takes effect), ``_kill``
    (seq of the last remove of the line or clear of its cart), ``_set`` (the
    last set in effect after it).

    Two levels, so that a hot cart or line is no single task: events lie in
    ``CART_SLICES`` equal ranges of ``seq`` (stored lines before them). Each
    (cart, slice) and (line, slice) is summed up map-side by its last clear,
    add and remove; windows over those few summaries carry them from slice to
    slice, and windows over rows stay within one slice.
    """
    s = F.col(seq)
    # duplicate lines of one product are merged first: quantities summed,
    # lowest unit price kept
    start = items.groupBy("cart_id", "product_id").agg(
        F.sum("quantity").cast("int").alias("quantity"), F.min("unit_price").alias("price")) \
        .select(F.lit(NEVER).cast("bigint").alias(seq), "cart_id", "product_id",
                F.lit("add").alias("action"), "quantity", "price", F.lit(True).alias("_stored"))
    ev = events.select(s.cast("bigint").alias(seq), "cart_id", "product_id",
                       F.lower("action").alias("action"), "quantity", "price", F.lit(False).alias("_stored"))
    known = F.col("product_id").isNotNull()
    if products is not None:
        ids = products.select(F.col("id").alias("_pid"))
        ev = ev.join(ids, ev["product_id"] == ids["_pid"], "left")
        known = F.col("_pid").isNotNull()
    no_action = ~F.coalesce(F.col("action").isin(*CART_ACTIONS), F.lit(False))
    no_cart = F.col("cart_id").isNull()
    no_quantity = F.col("action").isin("add", "set") & ~F.coalesce(F.col("quantity") > 0, F.lit(False))
    reason = (F.when(no_action, F.lit("INVALID_ACTION")).when(no_cart, F.lit("CART_NOT_FOUND"))
               .when((F.col("action") != "clear") & ~known, F.lit("PRODUCT_NOT_FOUND"))
               .when(no_quantity, F.lit("INVALID_QUANTITY")))
    ev = ev.withColumn("reason", reason).drop("_pid")
    x = ev.unionByName(start.withColumn("reason", F.lit(None).cast("string")))
    ok = F.col("reason").isNull()
    lo, width = _slices(events, seq)
    x = x.withColumn("_slice", F.when(F.col("_stored"), F.lit(-1))
                     .otherwise(F.floor((s - lo) / width).cast("int")))
    when = lambda a: F.when(ok & (F.col("action") == a), s)
    cart, line = ["cart_id"], ["cart_id", "product_id"]
    x = _carried(x, cart, {"_clear": when("clear")})
    x = _carried(x, line, {"_add": when("add"), "_remove": when("remove")})
    here = Window.partitionBy(*cart, "_slice").orderBy(seq)
    cleared = F.max(when("clear")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_clear", F.greatest("_clear", cleared))
    before = Window.partitionBy(*line, "_slice").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda a: F.greatest(f"_{a}", F.max(when(a)).over(before))
    gone = F.coalesce(F.greatest(last("remove"), F.col("_clear")), F.lit(NEVER - 1))
    x = x.withColumn("_held", F.coalesce(last("add") > gone, F.lit(False)))
    x = x.withColumn("reason", F.when(ok & F.col("action").isin("set", "remove") & ~F.col("_held"),
                                      F.lit("LINE_NOT_FOUND")).otherwise(F.col("reason")))
    # a remove of a line that is not held kills nothing that was not gone before
    x = x.withColumn("_kill", F.coalesce(F.greatest("_remove_all", "_clear_all"), F.lit(NEVER - 1)))
    sets = x.where(F.col("reason").isNull() & (F.col("action") == "set") & (s > F.col("_kill"))) \
        .groupBy(*line).agg(F.max(s).alias("_set"))
    return _left(x, sets, line).drop("_slice", "_clear", "_add", "_remove", "_clear_all", "_add_all", "_remove_all")


CART_SLICES = 1024  # ranges of seq; a cart or line has at most that many summaries


def _slices(events: DataFrame, seq: str):
    """Start and width of the ranges of ``seq`` (as scalar subqueries)."""
    ends = events.select(F.col(seq).cast("bigint").alias("_s"))
    lo = ends.agg(F.coalesce(F.min("_s"), F.lit(0).cast("bigint"))).scalar()
    width = ends.agg(F.coalesce((F.max("_s") - F.min("_s")) / CART_SLICES + 1, F.lit(1.0))).scalar()
    return lo, width


def _carried(x: DataFrame, keys: list[str], latest: dict) -> DataFrame:
    """``x`` with, per output of ``latest``, its maximum over the earlier slices
    of the same keys, and over all slices (``_all``)."""
    sums = x.groupBy(*keys, "_slice").agg(*[F.max(v).alias(f"{n}_s") for n, v in latest.items()])
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_slice", *[c for n in latest for c in (
        F.max(f"{n}_s").over(earlier).alias(n), F.max(f"{n}_s").over(w).alias(f"{n}_all"))])
    return _left(x, carried, [*keys, "_slice"])


def _left(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which null meets null."""
    y = y.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                 *[c for c in y.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return x.join(y, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def fold_cart(items: DataFrame, events: DataFrame, seq: str = "seq", products: DataFrame | None = None):
    """CHG-4: apply add / set / remove / clear events to cart lines.

    ``events``: seq, cart_id, product_id (null for clear), action, quantity,
    price. Every event takes effect or is a reject with one of the reasons
    INVALID_ACTION, CART_NOT_FOUND, PRODUCT_NOT_FOUND (null, or not among
    ``products`` if given), INVALID_QUANTITY (null, 0 or less) or
    LINE_NOT_FOUND (set or remove of a line the cart does not hold then).
    Of a line, what comes after its last remove or its cart's last clear
    counts: quantity = last set (or 0) + the adds after it, price = price of
    the first add. Variants are ignored (merge by product). An event's cart is
    the caller's own, as the reference takes it.

    Returns ``(items, rejects)``.
    """
    x = judge_cart_events(items, events, products, seq)
    s, is_add = F.col(seq), F.col("action") == "add"
    rejects = x.where(F.col("reason").isNotNull()).select(seq, "cart_id", "product_id", "action", "reason")
    live = x.where(F.col("reason").isNull() & (s > F.col("_kill")) & F.col("action").isin("add", "set"))
    counted = F.when(F.coalesce(s >= F.col("_set"), F.lit(True)), F.col("quantity"))
    new_items = live.groupBy("cart_id", "product_id").agg(
        F.sum(counted).cast("int").alias("quantity"),
        F.min_by(F.when(is_add, F.col("price")), F.when(is_add, s)).alias("unit_price"))
    return new_items, rejects


# -------------------------------------------------------- flags and patches --
def apply_flags(base: DataFrame, changes: DataFrame, key: str, flag_col: str,
                seq: str = "seq", change_key: str | None = None, value: str = "value"):
    """CHG-5: set a boolean flag from a batch of changes; the last change per
    key wins; changes for unknown keys are rejects. Returns ``(base, rejects)``."""
    ck = change_key or key
    last = changes.groupBy(ck).agg(F.max_by(value, seq).alias("_v"))
    keys = base.select(F.col(key).alias(ck))
    rejects = changes.join(keys, ck, "left_anti").withColumn("reason", F.lit(f"unknown {key}"))
    out = base.join(last.withColumnRenamed(ck, key), key, "left") \
        .withColumn(flag_col, F.coalesce("_v", flag_col)).drop("_v")
    return out, rejects


def flag_from_body(changes: DataFrame, key: str, default: bool = True, body: str = "body"):
    """CHG-5 request bodies: the flag named ``key`` from a JSON object; a
    missing key takes ``default`` (the reference's ``getOrDefault``), other
    keys are ignored. A body that is no JSON object (UNREADABLE_BODY) and a
    value other than true or false, null included (NOT_A_BOOLEAN), are
    rejects. Returns ``(changes with value, rejects)``."""
    m = F.from_json(F.col(body), "map<string,string>")
    text = F.lower(m[key])
    value = F.when(~F.map_contains_key(m, key), F.lit(default)).when(text == "true", F.lit(True)) \
        .when(text == "false", F.lit(False))
    x = changes.withColumn("value", value).withColumn(
        "reason", F.when(m.isNull(), F.lit("UNREADABLE_BODY")).when(value.isNull(), F.lit("NOT_A_BOOLEAN")))
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull())


def verify_emails(users: DataFrame, requests: DataFrame):
    """CHG-5: set ``email_verified`` for the users of ``requests`` (caller_email).
    Returns ``(users, outcomes)``: per request VERIFIED, ALREADY_VERIFIED (the
    flag was set before the batch) or USER_NOT_FOUND."""
    known = users.select(F.col("email").alias("caller_email"), F.col("email_verified").alias("_was"))
    x = requests.join(known, "caller_email", "left")
    outcomes = x.select("request_id", "caller_email", F.when(F.col("_was").isNull(), F.lit("USER_NOT_FOUND"))
                        .when(F.col("_was"), F.lit("ALREADY_VERIFIED")).otherwise(F.lit("VERIFIED")).alias("outcome"))
    asked = requests.select(F.col("caller_email").alias("email")).distinct().withColumn("_asked", F.lit(True))
    out = users.join(asked, "email", "left") \
        .withColumn("email_verified", F.col("email_verified") | F.coalesce("_asked", F.lit(False))).drop("_asked")
    return out.select(*users.columns), outcomes


# JSON body key -> column (the four fields a profile update may change).
PROFILE_FIELDS = {"firstName": "first_name", "lastName": "last_name",
                  "phone": "phone", "avatarUrl": "avatar_url"}


# Columns of the fields above that may not be null.
PROFILE_REQUIRED = ("first_name", "last_name")


def apply_patches(base: DataFrame, patches: DataFrame, key: str, fields: dict = PROFILE_FIELDS,
                  seq: str = "seq", patch_key: str | None = None, body: str = "body",
                  required: tuple = PROFILE_REQUIRED):
    """CHG-6: sparse patches from JSON bodies. Only named fields change; a
    field present with null overwrites with null. Successive patches merge
    by ``seq``: per field, the last patch naming it wins. Rejects: patches for
    unknown keys (UNKNOWN_KEY), bodies that are no JSON object
    (UNREADABLE_BODY) and patches that set a ``required`` column to null
    (NULL_NOT_ALLOWED), which change nothing at all. Returns ``(base,
    rejects)``."""
    pk = patch_key or key
    m = F.from_json(F.col(body), "map<string,string>")
    x = patches.withColumn("_m", m)
    nulls = F.lit(False)
    for name, col in fields.items():
        if col in required:
            nulls = nulls | (F.map_contains_key("_m", name) & F.col("_m")[name].isNull())
    ids = base.select(F.col(key).alias("_id")).withColumn("_known", F.lit(True))
    x = x.join(ids, x[pk] == ids["_id"], "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), F.lit("UNKNOWN_KEY"))
        .when(F.col("_m").isNull(), F.lit("UNREADABLE_BODY")).when(nulls, F.lit("NULL_NOT_ALLOWED")))
    rejects = x.where(F.col("reason").isNotNull()).select(*patches.columns, "reason")
    p = x.where(F.col("reason").isNull()).select(F.col(pk).alias(key), F.col(seq).alias("_seq"), "_m")
    aggs = []
    for name, col in fields.items():
        aggs.append(F.max_by(F.struct(F.col("_m")[name].alias("v")),
                             F.when(F.map_contains_key("_m", name), F.col("_seq"))).alias(f"_p_{col}"))
    last = p.groupBy(key).agg(*aggs)
    out = base.join(last, key, "left")
    for col in fields.values():
        out = out.withColumn(col, F.when(F.col(f"_p_{col}").isNotNull(), F.col(f"_p_{col}.v"))
                             .otherwise(F.col(col))).drop(f"_p_{col}")
    return out, rejects


# ------------------------------------------------------- owner-filtered edits --
PRODUCT_UPDATE_FIELDS = ("name", "description", "price", "stock_qty", "status")
# Those of them that may not be null.
PRODUCT_REQUIRED = ("name", "price", "stock_qty", "status")


def owned_products(products: DataFrame, sellers: DataFrame, users: DataFrame) -> DataFrame:
    """(product id, owner e-mail) through product -> seller -> user."""
    owner = sellers.select(F.col("id").alias("seller_id"), F.col("user_id").alias("_uid")) \
        .join(users.select(F.col("id").alias("_uid"), F.col("email").alias("owner_email")), "_uid")
    return products.select(F.col("id").alias("product_id"), "seller_id") \
        .join(owner, "seller_id").select("product_id", "owner_email")


def update_products(products: DataFrame, sellers: DataFrame, users: DataFrame,
                    updates: DataFrame, seq: str = "seq"):
    """CHG-7: full patch of five fields when the caller's e-mail is the product
    owner's; the last allowed update per product wins; others are rejects
    (PRODUCT_NOT_FOUND, NOT_OWNER, or NULL_NOT_ALLOWED for a null in a column
    that takes none). Returns ``(products, rejects)``."""
    own = owned_products(products, sellers, users)
    x = updates.join(own, "product_id", "left")
    nulls = F.lit(False)
    for f in PRODUCT_REQUIRED:
        nulls = nulls | F.col(f).isNull()
    x = x.withColumn("reason", F.when(F.col("owner_email").isNull(), F.lit("PRODUCT_NOT_FOUND"))
                     .when(~F.col("owner_email").eqNullSafe(F.col("caller_email")), F.lit("NOT_OWNER"))
                     .when(nulls, F.lit("NULL_NOT_ALLOWED")))
    ok = x.where(F.col("reason").isNull())
    rejects = x.where(F.col("reason").isNotNull()).select("request_id", "product_id", "reason")
    last = ok.groupBy("product_id").agg(
        F.max_by(F.struct(*PRODUCT_UPDATE_FIELDS), seq).alias("_u"))
    out = products.join(last.withColumnRenamed("product_id", "id"), "id", "left")
    for f in PRODUCT_UPDATE_FIELDS:
        out = out.withColumn(f, F.when(F.col("_u").isNotNull(), F.col(f"_u.{f}")).otherwise(F.col(f)))
    return out.drop("_u"), rejects


def delete_authorised(base: DataFrame, authorised: DataFrame, key: str = "id",
                      auth_key: str | None = None) -> DataFrame:
    """CHG-8: remove the rows whose key was authorised for deletion."""
    a = authorised.select(F.col(auth_key or key).alias(key))
    return base.join(a, key, "left_anti")


# ----------------------------------------------------------------- erasure --
# Foreign keys that reach users, as data: (child, fk column, parent, action).
USER_FKS = (
    ("seller_profiles", "user_id", "users", "CASCADE"),
    ("addresses", "user_id", "users", "CASCADE"),
    ("carts", "user_id", "users", "CASCADE"),
    ("reviews", "user_id", "users", "CASCADE"),
    ("wishlists", "user_id", "users", "CASCADE"),
    ("helpful_votes", "user_id", "users", "CASCADE"),
    ("search_history", "user_id", "users", "CASCADE"),
    ("verification_tokens", "user_id", "users", "CASCADE"),
    ("notifications", "user_id", "users", "CASCADE"),
    ("notification_preferences", "user_id", "users", "CASCADE"),
    ("device_tokens", "user_id", "users", "CASCADE"),
    ("support_tickets", "user_id", "users", "CASCADE"),
    ("support_messages", "sender_id", "users", "CASCADE"),
    ("app_feedback", "user_id", "users", "SET NULL"),
    ("orders", "user_id", "users", "RESTRICT"),
    ("orders", "address_id", "addresses", "RESTRICT"),
    ("order_status_history", "changed_by", "users", "SET NULL"),
    ("products", "seller_id", "seller_profiles", "CASCADE"),
    ("review_responses", "seller_id", "seller_profiles", "CASCADE"),
    ("payouts", "seller_id", "seller_profiles", "CASCADE"),
    ("product_variants", "product_id", "products", "CASCADE"),
    ("cart_items", "cart_id", "carts", "CASCADE"),
    ("cart_items", "product_id", "products", "CASCADE"),
    ("cart_items", "variant_id", "product_variants", "SET NULL"),
    ("reviews", "product_id", "products", "CASCADE"),
    ("wishlists", "product_id", "products", "CASCADE"),
    ("order_items", "order_id", "orders", "CASCADE"),
    ("order_items", "product_id", "products", "SET NULL"),
    ("order_items", "variant_id", "product_variants", "SET NULL"),
    ("order_status_history", "order_id", "orders", "CASCADE"),
    ("reviews", "order_id", "orders", "SET NULL"),
    ("review_responses", "review_id", "reviews", "CASCADE"),
    ("helpful_votes", "review_id", "reviews", "CASCADE"),
    ("support_tickets", "order_id", "orders", "SET NULL"),
    ("support_messages", "ticket_id", "support_tickets", "CASCADE"),
)


class Erasure:
    """CHG-9: which rows go with a set of users, over any graph of foreign keys
    (cycles and keys of a table to itself included).

    The keys that go are found as a fixpoint, semi-naively: a round joins only
    the keys that the round before found to the tables whose CASCADE keys point
    at them, and stores what is new once, for all tables together, as
    ``(table, id, user)``. Rounds end with the first that finds nothing, after
    as many as the longest chain of keys. The user is the one asked for with
    whom the row would go; a row may go with several.

    A user is refused, and reported in ``restricted`` as ``(user_id,
    blocked_by)`` with the first tables found, when a RESTRICT key points at a
    row that would go with them; ``doomed`` has the keys ``(table, id)`` that go with the others. Tables
    absent from ``tables``, and keys without their column, are skipped.
    ``keys`` names the key column of tables where that is not ``id``.
    """

    def __init__(self, tables: dict, user_ids: DataFrame, fks=USER_FKS, keys: dict | None = None):
        self.tables, self.keys = tables, keys or {}
        self.fks = [f for f in fks if f[0] in tables and f[1] in tables[f[0]].columns]
        #: tables whose own keys others point at
        self.parents = {p for _, _, p, _ in self.fks if p in tables} | {"users"}
        asked = user_ids.select(F.lit("users").alias("table"), F.col("user_id").alias("id"), F.col("user_id").alias("user")) \
            .where(F.col("id").isNotNull()).distinct()
        found, refused, new, at = [], [], stash(asked, "erase_keys"), {"users"}
        while not new.isEmpty():
            found.append(new)
            hits = [self._pointing(c, fk, new.where(F.col("table") == p)).select(F.col("user").alias("user_id"), F.lit(c).alias("blocked_by"))
                    for c, fk, p, action in self.fks if action == "RESTRICT" and p in at]
            if hits:  # nothing more is looked for on behalf of a refused user
                refused.append(stash(stack_rows(*hits).distinct(), "erase_restricted"))
                new = new.join(refused[-1].select(F.col("user_id").alias("user")), "user", "left_anti")
            ways = [(c, fk, p) for c, fk, p, action in self.fks if action == "CASCADE" and p in at and c in self.parents]
            if not ways:
                break
            known = stack_rows(*found)
            reached = stack_rows(*[self._rows_of(c, fk, new.where(F.col("table") == p)) for c, fk, p in ways]).distinct()
            new, at = stash(reached.join(known, ["table", "id", "user"], "left_anti"), "erase_keys"), {c for c, _, _ in ways}
        closure = stack_rows(*found) if found else asked
        none = user_ids.limit(0).select("user_id", F.lit("").alias("blocked_by"))
        self.restricted = stack_rows(none, *refused).distinct()
        gone = closure.join(self.restricted.select(F.col("user_id").alias("user")), "user", "left_anti")
        self.doomed = stash(gone.select("table", "id").distinct(), "erase_doomed")

    def _pointing(self, child: str, fk: str, to: DataFrame) -> DataFrame:
        return self.tables[child].join(to.select(F.col("id").alias("_to"), "user"), F.col(fk) == F.col("_to"))

    def _rows_of(self, child: str, fk: str, to: DataFrame) -> DataFrame:
        return self._pointing(child, fk, to).select(F.lit(child).alias("table"), F.col(self.keys.get(child, "id")).alias("id"), "user")

    def _dead(self, table: str, name: str) -> DataFrame:
        return self.doomed.where(F.col("table") == table).select(F.col("id").alias(name))

    def _by(self, table: str) -> list[tuple[str, str]]:
        """(column, table whose dead keys it is looked up in): rows of ``table`` go by any of them."""
        if table in self.parents:
            return [(self.keys.get(table, "id"), table)]
        return [(fk, p) for c, fk, p, action in self.fks if c == table and action == "CASCADE"]

    def gone(self, table: str) -> DataFrame:
        """Rows of ``table`` that go."""
        df, hit = self.tables[table], F.lit(False)
        for i, (col, parent) in enumerate(self._by(table)):
            df = df.join(self._dead(parent, f"_dead{i}"), df[col] == F.col(f"_dead{i}"), "left")
            hit = hit | F.col(f"_dead{i}").isNotNull()
        return df.where(hit).select(*[self.tables[table][c] for c in self.tables[table].columns])

    def kept(self, table: str) -> DataFrame:
        """Rows of ``table`` that stay, SET NULL columns blanked."""
        df = self.tables[table]
        for i, (col, parent) in enumerate(self._by(table)):
            df = df.join(self._dead(parent, f"_dead{i}"), df[col] == F.col(f"_dead{i}"), "left_anti")
        return self._blanked(df, table)

    def _blanked(self, df: DataFrame, table: str) -> DataFrame:
        columns = df.columns
        for i, (fk, parent) in enumerate((fk, p) for c, fk, p, action in self.fks if c == table and action == "SET NULL"):
            df = df.join(self._dead(parent, f"_null{i}"), df[fk] == F.col(f"_null{i}"), "left") \
                .withColumn(fk, F.when(F.col(f"_null{i}").isNull(), F.col(fk)))
        return df.select(*columns)

    def blanked(self, table: str, fk: str) -> DataFrame:
        """Rows of ``table`` that stay and lose their ``fk``."""
        parent = next(p for c, f, p, action in self.fks if (c, f, action) == (table, fk, "SET NULL"))
        df = self.tables[table]
        for i, (col, up) in enumerate(self._by(table)):
            df = df.join(self._dead(up, f"_dead{i}"), df[col] == F.col(f"_dead{i}"), "left_anti")
        return df.join(self._dead(parent, "_null"), df[fk] == F.col("_null"), "left_semi")


def erase_users(tables: dict, user_ids: DataFrame, fks=USER_FKS, keys: dict | None = None):
    """CHG-9: delete users and follow the foreign-key actions (see
    :class:`Erasure`). Returns ``(tables, restricted)``."""
    e = Erasure(tables, user_ids, fks, keys)
    return {t: e.kept(t) for t in tables}, e.restricted


# ------------------------------------------------------------ registration --
# Fixed values from the reference's registration checks: shortest password,
# longest name; the e-mail check is a local@domain shape.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+$"
MIN_PASSWORD = 8
MAX_NAME = 100
ROLES = ("CUSTOMER", "SELLER", "ADMIN")
DEFAULT_ROLE = "CUSTOMER"


def validate_registrations(requests: DataFrame, users: DataFrame, admin_code: str | None):
    """CHG-10: field checks first (all failing fields together in
    ``field_errors``), then, in order: e-mail taken (by an existing user or an
    earlier request of the batch), admin code, store name for sellers.
    A null role is CUSTOMER. Accepted rows become users (unverified) and, for
    sellers, a row of ``profiles`` (request_id, email, store_name). Returns
    ``(accepted, rejects)``; :func:`seller_profiles` takes the profiles."""
    blank = T.is_blank
    # field -> code of the first failing check
    checks = {
        "firstName": [(blank("first_name"), "MISSING"), (F.length("first_name") > MAX_NAME, "TOO_LONG")],
        "lastName": [(blank("last_name"), "MISSING"), (F.length("last_name") > MAX_NAME, "TOO_LONG")],
        "email": [(blank("email"), "MISSING"), (~F.col("email").rlike(EMAIL_PATTERN), "NOT_AN_EMAIL")],
        "password": [(blank("password"), "MISSING"), (F.length("password") < MIN_PASSWORD, "TOO_SHORT")],
        "role": [(~F.col("role").isin(*ROLES), "UNKNOWN")],
    }
    requests = requests.withColumn("role", F.coalesce("role", F.lit(DEFAULT_ROLE)))
    entries = []
    for field, rules in checks.items():
        msg = None
        for cond, text in rules:
            c = F.coalesce(cond, F.lit(False))
            msg = F.when(c, F.lit(text)) if msg is None else msg.when(c, F.lit(text))
        entries.append(F.struct(F.lit(field).alias("k"), msg.alias("v")))
    errs = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    x = requests.withColumn("field_errors", errs)
    code_ok = (F.col("admin_code") == F.lit(admin_code)) if admin_code is not None else F.lit(False)
    admin_bad = (F.col("role") == "ADMIN") & ~F.coalesce(code_ok, F.lit(False))
    store_bad = (F.col("role") == "SELLER") & blank("store_name")
    # a request that passes every check not involving other requests is the
    # one that registers its e-mail; the first such request (by seq) wins
    alone_ok = (F.size("field_errors") == 0) & ~F.coalesce(admin_bad, F.lit(False)) \
        & ~F.coalesce(store_bad, F.lit(False))
    taken = users.select(F.col("email").alias("_e")).distinct().withColumn("_taken", F.lit(True))
    first_req = x.where(alone_ok).groupBy("email").agg(F.min("seq").alias("_first"))
    x = x.join(taken, x["email"] == taken["_e"], "left").drop("_e") \
        .join(first_req, "email", "left")
    error = (F.when(F.size("field_errors") > 0, F.lit("INVALID_FIELDS"))
              .when(F.coalesce(F.col("_taken"), F.lit(False)) | (F.col("seq") > F.col("_first")),
                    F.lit("EMAIL_TAKEN"))
              .when(admin_bad, F.lit("ADMIN_CODE_WRONG"))
              .when(store_bad, F.lit("STORE_NAME_MISSING")))
    x = x.withColumn("error", error).drop("_taken", "_first")
    accepted = x.where(F.col("error").isNull()).select(
        "request_id", "email", "first_name", "last_name", "role",
        F.lit(False).alias("email_verified"),
        F.when(F.col("role") == "SELLER", F.col("store_name")).alias("store_name"))
    rejects = x.where(F.col("error").isNotNull()).select("request_id", "email", "error", "field_errors")
    return accepted, rejects


def seller_profiles(accepted: DataFrame) -> DataFrame:
    """CHG-10: the seller profiles that accepted registrations create."""
    return accepted.where(F.col("role") == "SELLER").select(
        F.col("request_id").alias("user_request_id"), "email", "store_name", F.lit(False).alias("is_verified"))


def intake_reviews(requests: DataFrame, products: DataFrame, reviews: DataFrame | None = None):
    """CHG-11: the product must exist; rating text defaults to 5 and must be a
    whole number in 1..5, without white space. Title and text are carried
    where the requests have them. Intake never carries an order, so the (user,
    product, order) guard never fires. New ids follow the largest id of
    ``reviews`` in order of the request id (without ``reviews`` the request id
    stays the id). Returns ``(reviews, rejects)``."""
    written = F.coalesce(F.col("rating_text"), F.lit("5"))
    rating = F.when(written.rlike("^[+-]?[0-9]+$"), written.try_cast("smallint"))
    x = requests.withColumn("rating", rating) \
        .join(products.select(F.col("id").alias("product_id")).withColumn("_p", F.lit(True)),
              "product_id", "left")
    reason = (F.when(F.col("_p").isNull(), F.lit("PRODUCT_NOT_FOUND"))
               .when(F.col("rating").isNull(), F.lit("RATING_NOT_A_NUMBER"))
               .when((F.col("rating") < 1) | (F.col("rating") > 5), F.lit("RATING_OUT_OF_RANGE")))
    x = x.withColumn("reason", reason).drop("_p")
    carried = [F.col(c) if c in requests.columns else F.lit(None).cast("string").alias(c) for c in ("title", "text")]
    ok = x.where(F.col("reason").isNull()).select(
        F.col("request_id").alias("id"), F.col("caller_id").alias("user_id"), "product_id",
        F.lit(None).cast("bigint").alias("order_id"), "rating", *carried, F.lit(False).alias("is_hidden"))
    if reviews is not None:
        ok = new_ids(ok, reviews)
    return ok, x.where(F.col("reason").isNotNull()).select("request_id", "product_id", "rating", "reason")


def new_ids(rows: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """Replace the request ids in ``id_col`` by ids above the largest of
    ``table``: that id + 1 + request id - smallest request id. The order of
    requests is kept, no id is used twice, and no global rank is needed."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    low = rows.agg(F.min(id_col).cast("bigint")).scalar()
    return rows.withColumn(id_col, top + 1 + F.col(id_col) - low)


def find_or_create_users(profiles: DataFrame, users: DataFrame):
    """CHG-13: users for a batch of social sign-ins. A known e-mail finds its
    user; an unknown one creates a CUSTOMER (verified) from its first profile
    by ``seq``, names split by SCL-3. A null or blank e-mail (NO_EMAIL) and a
    suspended user (SUSPENDED) are refused. Returns ``(created, found,
    rejects)``: new users, ``(profile_id, user_id)`` of the profiles that
    found one, and refused profiles."""
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("_email"), F.col("is_suspended").alias("_out"))
    x = profiles.join(u, profiles["email"] == u["_email"], "left")
    x = x.withColumn("reason", F.when(T.is_blank("email"), F.lit("NO_EMAIL"))
                     .when(F.coalesce("_out", F.lit(False)), F.lit("SUSPENDED")))
    rejects = x.where(F.col("reason").isNotNull()).select("profile_id", "email", "reason")
    ok = x.where(F.col("reason").isNull())
    found = ok.where(F.col("user_id").isNotNull()).select("profile_id", "user_id")
    first = ok.where(F.col("user_id").isNull()).groupBy("email").agg(
        F.min_by(F.struct("profile_id", "full_name", "avatar_url"), "seq").alias("_p"))
    created = first.select(
        F.col("_p.profile_id").alias("profile_id"), "email",
        T.first_name(F.col("_p.full_name"), F.col("email")).alias("first_name"),
        T.last_name(F.col("_p.full_name")).alias("last_name"),
        F.col("_p.avatar_url").alias("avatar_url"),
        F.lit("CUSTOMER").alias("role"), F.lit(True).alias("email_verified"))
    return created, found, rejects
