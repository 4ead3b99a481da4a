"""Catalogue listing, filters, search, suggestions, ordering (FIL, PRJ, FTS-3..5,
SRT, LIM, AGG-11, AGG-13, TRD-1).

Every function takes and returns DataFrames and only adds predicates, joins
and windows to the logical plan; Catalyst pushes the predicates into the
parquet scan and prunes columns.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions.money import ORDER_STATUSES, stock_state, tracking_eta
from cartograph.functions.text import lexemes, lexemes_of, like_pattern_contains, trim
from cartograph.operators.common import cumulative_sums, page, ts_lit

# Fixed values from the reference: default page size, suggestions returned,
# shortest suggestion prefix (trimmed length).
DEFAULT_PAGE_SIZE = 20
SUGGESTION_LIMIT = 10
MIN_PREFIX = 2


# ---------------------------------------------------------------- filters --
def live_products(products: DataFrame, category_id=None) -> DataFrame:
    """FIL-1: active and LIVE. ``category_id`` is an opt-in filter (the
    reference accepts and ignores its category argument)."""
    out = products.where(F.col("is_active") & (F.col("status") == "LIVE"))
    if category_id is not None:
        out = out.where(F.col("category_id") == F.lit(category_id))
    return out


def featured_products(products: DataFrame) -> DataFrame:
    """FIL-2: FIL-1 plus ``is_featured``."""
    return live_products(products).where(F.col("is_featured"))


def price_between(df: DataFrame, lo=None, hi=None, col: str = "price") -> DataFrame:
    """FIL-5: inclusive at both ends; a missing bound is no filter."""
    if lo is not None:
        df = df.where(F.col(col) >= F.lit(Decimal(str(lo))))
    if hi is not None:
        df = df.where(F.col(col) <= F.lit(Decimal(str(hi))))
    return df


def in_stock(df: DataFrame, flag=None) -> DataFrame:
    """FIL-6: None -> no filter; True -> stock > 0; False -> no rows (the
    reference's predicate is ``:inStock = true AND stock > 0``)."""
    if flag is None:
        return df
    if flag:
        return df.where(F.col("stock_qty") > 0)
    return df.where(F.lit(False))


def in_category(products: DataFrame, categories: DataFrame, slug=None) -> DataFrame:
    """FIL-4: products of the category whose slug is ``slug``; an unknown slug
    gives no rows. AQE broadcasts the
    chosen category (one row when slugs are unique)."""
    if slug is None:
        return products
    chosen = categories.where(F.col("slug") == F.lit(slug)).select(F.col("id").alias("_cat"))
    return products.join(chosen, products["category_id"] == F.col("_cat"), "left_semi")


def optional_filters(df: DataFrame, categories: DataFrame | None = None, category=None,
                     min_price=None, max_price=None, stock=None) -> DataFrame:
    """FIL-3: each filter is added only when its argument is given."""
    if category is not None:
        df = in_category(df, categories, category)
    df = price_between(df, min_price, max_price)
    return in_stock(df, stock)


def lookup(keys: DataFrame, dim: DataFrame, on: str, dim_on: str | None = None,
           ignore_case: bool = False) -> DataFrame:
    """FIL-7: batch key lookup. Every key row comes back once per match, with
    ``found``; a missing key has ``found = false`` (the reference raises)."""
    dim_on = dim_on or on
    d = dim.withColumn("_found", F.lit(True))
    if ignore_case:
        cond = F.lower(keys[on]) == F.lower(d[dim_on])
    else:
        cond = keys[on] == d[dim_on]
    out = keys.join(d, cond, "left")
    if dim_on == on and not ignore_case:
        out = out.drop(d[dim_on])
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def orders_of(orders: DataFrame, user_id=None, status: str | None = "all") -> DataFrame:
    """FIL-8: a user's orders (all users when ``user_id`` is None) in one
    status; None or ``all`` in any case is no filter; an unknown status is an
    error, raised before any job runs."""
    out = orders if user_id is None else orders.where(F.col("user_id") == F.lit(user_id))
    if status is None or status.lower() == "all":
        return out
    wanted = status.upper()
    if wanted not in ORDER_STATUSES:
        raise ValueError(f"unknown order status: {status}")
    return out.where(F.col("status") == F.lit(wanted))


def visible_reviews(reviews: DataFrame, product_id=None) -> DataFrame:
    """FIL-9: reviews that are not hidden (of one product when given)."""
    out = reviews.where(~F.col("is_hidden"))
    if product_id is not None:
        out = out.where(F.col("product_id") == F.lit(product_id))
    return out


def sellers_with_account(sellers: DataFrame, users: DataFrame) -> DataFrame:
    """JON-3: seller profile joined to its account (for the e-mail)."""
    u = users.select(F.col("id").alias("_uid"), F.col("email"))
    return sellers.join(u, sellers["user_id"] == u["_uid"], "inner").drop("_uid")


def products_of_seller(products: DataFrame, sellers: DataFrame, users: DataFrame,
                       email=None) -> DataFrame:
    """FIL-10: products with their seller's account e-mail; every status and
    activity (no filter). With ``email``, only that seller's products."""
    acct = sellers_with_account(sellers, users).select(
        F.col("id").alias("_sid"), F.col("email").alias("seller_email"))
    if email is not None:
        acct = acct.where(F.col("seller_email") == F.lit(email))
    return products.join(acct, products["seller_id"] == acct["_sid"], "inner").drop("_sid")


# ------------------------------------------------------------- projections --
def with_stock_state(products: DataFrame) -> DataFrame:
    """PRJ-1 as a column on the products frame."""
    return products.withColumn("stock_state", stock_state("stock_qty", "low_stock_threshold"))


def tracking(orders: DataFrame) -> DataFrame:
    """PRJ-2: order id, status, estimated delivery text or ``TBD``."""
    return orders.select(F.col("id").alias("order_id"), "status",
                         tracking_eta("estimated_delivery_date").alias("estimated_delivery"))


def public_profile(users: DataFrame) -> DataFrame:
    """PRJ-3: the account without secrets; null avatar as ``''``."""
    return users.select("id", "email", "first_name", "last_name", "phone",
                        F.coalesce(F.col("avatar_url"), F.lit("")).alias("avatar_url"),
                        "role", "email_verified")


# ------------------------------------------------------------------ search --
def name_contains(df: DataFrame, q: str | None) -> DataFrame:
    """FTS-3: ``lower(name) LIKE lower('%' || q || '%')``; ``%`` and ``_`` in
    ``q`` are wildcards; ``q = ''`` keeps every row; null ``q`` no filter."""
    if q is None:
        return df
    return df.where(name_like(q))


def name_like(q: str) -> Column:
    if not any(ch in q for ch in "%_\\"):
        return F.lower(F.col("name")).contains(q.lower())
    return F.lower(F.col("name")).like(like_pattern_contains(q.lower()))


def search_vector(df: DataFrame) -> Column:
    """FTS-1 vector of a product: lexemes of ``name || ' ' || description``."""
    text = F.concat_ws(" ", F.coalesce(F.col("name"), F.lit("")),
                       F.coalesce(F.col("description"), F.lit("")))
    return lexemes(text)


def with_search_vector(products: DataFrame) -> DataFrame:
    """The products frame with its FTS-1 ``search_vector`` column, to be
    written once with the table (the reference keeps it as a stored
    generated column); :func:`search_filter` uses it when present instead of
    tokenising every product for every search."""
    return products.withColumn("search_vector", search_vector(products))


def matches_all_terms(vector: Column, q: str) -> Column:
    """FTS-2 for one query: every lexeme of ``q`` is in ``vector``; a query
    with no lexeme (only stop words) matches nothing."""
    terms = lexemes_of(q)
    if not terms:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, terms)), vector)) == 0


def search_order(sort: str | None = None) -> list[Column]:
    """SRT-2: requested order first, then rating, then id (null dates sort
    first on a descending key, as PostgreSQL does)."""
    modes = {
        "price_asc": [F.col("price").asc()],
        "price_desc": [F.col("price").desc()],
        "newest": [F.col("created_at").desc_nulls_first()],
        "rating": [],
    }
    return modes.get(sort or "relevance", []) + [F.col("rating_avg").desc(), F.col("id").asc()]


def search_filter(products: DataFrame, categories: DataFrame | None = None, q=None,
                  category=None, min_price=None, max_price=None, stock=None) -> DataFrame:
    """FTS-4 predicate: live AND (q null OR all terms OR name contains) AND
    FIL-4..6. Shared by the page and its total (AGG-11)."""
    out = live_products(products)
    if q is not None:
        vec = F.col("search_vector") if "search_vector" in products.columns else search_vector(products)
        out = out.where(matches_all_terms(vec, q) | name_like(q))
    return optional_filters(out, categories, category, min_price, max_price, stock)


def search_products(products: DataFrame, categories: DataFrame | None = None, q=None,
                    category=None, sort=None, min_price=None, max_price=None, stock=None,
                    page_no: int = 0, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """FTS-4: one page of catalogue search results."""
    hits = search_filter(products, categories, q, category, min_price, max_price, stock)
    return page(hits, search_order(sort), page_no, size)


def page_total(df: DataFrame) -> DataFrame:
    """AGG-11: COUNT(*) under the page's predicate, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def distinct_names(products: DataFrame) -> DataFrame:
    """AGG-13: distinct product names."""
    return products.select("name").distinct()


def suggest(products: DataFrame, prefixes: DataFrame, k: int = SUGGESTION_LIMIT,
            prefix_col: str = "prefix", id_col: str = "request_id") -> DataFrame:
    """FTS-5: for many prefixes at once, up to ``k`` distinct names of active
    products (drafts included) that start with the prefix, case-insensitive.
    A prefix whose trimmed length is under 2 gets nothing; the untrimmed text
    is what is matched; ``%`` and ``_`` in a prefix stay LIKE wildcards, a
    backslash stands for itself.
    Names are ranked by name (the reference has no order).

    Names and prefixes are sorted together by their lower-case bytes, over
    ranges: running counts give every name its place and every prefix the run
    of places of its names, so no prefix meets the names one by one and no name
    is taken apart. The first ``k`` by name are kept for every aligned block of
    ``SPAN``, ``SPAN`` ** 2, ... places, and a run is put together from at most
    2 * ``SPAN`` blocks of each size. Rows shuffled grow with names and
    prefixes, whatever their lengths. Prefixes with a wildcard meet the names
    that start with their literal head, verified by LIKE. Distinct prefixes are
    matched once; their top ``k`` are joined back to the requests.
    """
    reqs = prefixes.where(F.length(trim(prefix_col)) >= MIN_PREFIX) \
        .select(F.col(id_col), F.col(prefix_col), F.lower(F.col(prefix_col)).alias("_lp"))
    wanted = reqs.select("_lp").distinct() \
        .withColumn("_head", F.regexp_extract("_lp", "^([^%_]*)", 1))
    plain = F.col("_head") == F.col("_lp")
    names = products.where(F.col("is_active") & F.col("name").isNotNull()).select("name").distinct() \
        .withColumn("_ln", F.lower("name"))
    hits = _by_places(names, wanted.where(plain).select("_lp"), k) \
        .unionByName(_by_heads(names, wanted.where(~plain)))
    w = Window.partitionBy("_lp").orderBy(F.col("name"))
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return reqs.join(top, "_lp").select(id_col, prefix_col, "name", "rank")


#: Places joined into one block, and blocks into one of the next size.
SPAN = 64


def _by_places(names: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(_lp, name)``: the first ``k`` by name of the names that start with each
    ``_lp``, and some more of them."""
    low, nothing = F.col("_lp").cast("binary"), F.lit(None).cast("string")
    # no byte of UTF-8 is FF, so a prefix and FF come right after its names
    rows = names.select(F.col("_ln").cast("binary").alias("_at"), F.lit(1).alias("_one"), "name", nothing.alias("_lp")) \
        .unionByName(wanted.select(F.explode(F.array(low, F.concat(low, F.lit(b"\xff")))).alias("_at"),
                                   F.lit(0).alias("_one"), nothing.alias("name"), "_lp"))
    # a prefix that is itself a name comes before it
    placed = cumulative_sums(rows, [], ["_at", "_one", "name"], {"_n": "_one"})
    blocks = placed.where("_one = 1").select((F.col("_n") - 1).alias("_block"), "name")
    runs = placed.where("_one = 0").groupBy("_lp").agg(F.min("_n").alias("_from"), F.max("_n").alias("_to"))
    total = placed.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    first = Window.partitionBy("_block").orderBy("name")
    out = None
    while True:
        top = total <= SPAN
        inner = F.ceil(F.col("_from") / SPAN), F.floor(F.col("_to") / SPAN)
        whole = F.lit(top) | (inner[0] >= inner[1])
        ends = F.when(whole, _span("_from", F.col("_to"))) \
            .otherwise(F.concat(_span("_from", inner[0] * SPAN), _span(inner[1] * SPAN, F.col("_to"))))
        met = runs.select("_lp", F.explode(ends).alias("_block")).join(blocks, "_block").select("_lp", "name")
        out = met if out is None else out.unionByName(met)
        if top:
            return out
        runs = runs.where(~whole).select("_lp", inner[0].alias("_from"), inner[1].alias("_to"))
        blocks = blocks.withColumn("_block", F.floor(F.col("_block") / SPAN)) \
            .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
        total = -(-total // SPAN)


def _span(start, stop: Column) -> Column:
    """Whole numbers from ``start`` on and below ``stop``."""
    start = F.col(start) if isinstance(start, str) else start
    return F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def _by_heads(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(_lp, name)``: names that a prefix with wildcards matches."""
    lengths = wanted.agg(F.coalesce(F.collect_set(F.length("_head")), F.array().cast("array<int>"))).scalar()
    heads = names.withColumn("_ns", lengths) \
        .select("name", "_ln", F.explode(F.filter("_ns", lambda n: n <= F.length("_ln"))).alias("_n")) \
        .select("name", "_ln", F.expr("substring(_ln, 1, _n)").alias("_head"))
    return wanted.join(heads, "_head") \
        .where(F.like("_ln", F.concat(F.replace("_lp", F.lit("\\"), F.lit("\\\\")), F.lit("%")))).select("_lp", "name")


# ---------------------------------------------------------- ordering, top-k --
def ordered_categories(categories: DataFrame) -> DataFrame:
    """SRT-3: categories by ``sort_order`` (id breaks ties)."""
    return categories.orderBy("sort_order", "id")


def active_faqs(faqs: DataFrame) -> DataFrame:
    """SRT-5: active FAQ entries by ``sort_order``."""
    return faqs.where(F.col("is_active")).orderBy("sort_order", "id")


def top_per_category(products: DataFrame, n: int = 5) -> DataFrame:
    """SRT-4: best-rated ``n`` active products of every category (no status
    filter). Spark plans a partial ``WindowGroupLimit`` before the shuffle, so
    a category holding a third of all products sends only ``n`` rows per
    partition."""
    w = Window.partitionBy("category_id").orderBy(F.col("rating_avg").desc(), F.col("id").asc())
    return products.where(F.col("is_active")) \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trending(searches: DataFrame, as_of, window: str = "7 days", k: int = 8) -> DataFrame:
    """TRD-1 (our definition; the reference returns fixed labels): searches
    in ``[as_of - window, as_of)``, grouped by ``lower(trim(query))``, ranked by
    distinct users, then term; top ``k``."""
    end = ts_lit(as_of)
    start = end - F.expr(f"INTERVAL {window}")
    recent = searches.where((F.col("searched_at") >= start) & (F.col("searched_at") < end))
    terms = recent.select(F.lower(trim("query")).alias("term"), "user_id") \
        .where(F.col("term") != "")
    counted = terms.groupBy("term").agg(F.countDistinct("user_id").alias("users"))
    return counted.orderBy(F.col("users").desc(), F.col("term")).limit(k)
