"""SCL-2 unique slugs in bulk, and CHG-12 bulk product creation.

The reference assigns ``base``, ``base-1``, ``base-2`` ... , the first one not
taken, one product at a time, in request order. Done in bulk:

* Candidates of one base are indices ``0, 1, 2, ...`` (``base``, ``base-1``,
  ...). Two different bases share a candidate only when one is the other
  plus ``-N`` (``a-1`` is candidate 1 of ``a``). So the only contested slugs
  are such child bases: the child's first request takes it unless a request
  of the parent reached index ``N`` earlier.
* A contest is settled by counting. Let the parent's contested children,
  in order of ``N``, be i = 0, 1, ...; ``h_i = N - (existing indices below
  N) - i`` is the number of free indices below ``N`` that no child contests,
  less one if the parent lost its own index 0 to its own parent, and
  ``R_i`` the number of the parent's requests before the child's first one.
  The parent reaches ``N`` in time exactly when ``R_i > h_i + L_i``, with
  ``L_i`` the children before i that lost theirs. So with
  ``v_i = R_i - h_i`` the count runs ``L <- L + (v_i > L)``. ``R`` and
  ``h`` come from one running count; the runs are followed in rounds: a
  round takes the next ``RUN`` children of every parent whose own contest is
  settled, one row each, and stores what it settled. Rounds end when no
  parent is left, after as many as there are numbers at the end of one slug
  (``a-1-2``) and runs in one family.
* Every base then has a fixed set of blocked indices (existing slugs plus
  contests lost). The ``r``-th request of the base (by ``seq``) gets the
  ``r``-th free index, ``r + #{j : g_j <= r}`` with ``g_j = t_j - j`` over
  the blocked indices ``t_0 < t_1 < ...``. Ranks and running counts come
  from :func:`cumulative_sum`, which range-partitions rows, so a base
  holding a third of all requests is spread over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions.text import slugify
from cartograph.operators.changes import new_ids
from cartograph.operators.common import cumulative_sum, cumulative_sums, stash

# a slug ending in "-N" (N without a leading zero): candidate N of the rest
TAIL = r"^(.+)-([1-9][0-9]*)$"
#: Contested children of one parent that a round settles in one row.
RUN = 1 << 17


def _candidate(base, index):
    return F.when(index == 0, base).otherwise(F.concat(base, F.lit("-"), index.cast("string")))


def _split_tail(col):
    parent = F.regexp_extract(col, TAIL, 1)
    n = F.regexp_extract(col, TAIL, 2).try_cast("long")
    return parent, n


def _lost(values: Column, start: Column) -> Column:
    """For a run of contests ``v`` entered with ``L = start``: which are lost."""
    @F.arrow_udf("array<boolean>")
    def follow(values: pa.Array, start: pa.Array) -> pa.Array:
        out = []
        for run, count in zip(values.to_pylist(), start.to_pylist()):
            flags = []
            for v in run:
                flags.append(v > count)
                count += v > count
            out.append(flags)
        return pa.array(out, pa.list_(pa.bool_()))
    return follow(values, start)


def settle(contests: DataFrame, run: int = RUN) -> DataFrame:
    """Contests ``(parent, child, i, n, v)`` (see the module) with ``lost``:
    whether the parent took the child's first slug. ``i`` numbers a parent's
    contests by ``n``, without gaps."""
    number = F.floor(F.col("i") / run).cast("long")
    runs = stash(contests.groupBy("parent", number.alias("run"))
                 .agg(F.sort_array(F.collect_list(F.struct("i", "child", "n", "v"))).alias("members")), "slug_runs")
    # parents whose own first slug is not contested begin with a count of 0; one
    # that loses its own has one free index less, a count of -1
    ready = runs.where("run = 0").join(contests.select(F.col("child").alias("parent")), "parent", "left_anti") \
        .select("parent", "run", F.lit(0).cast("long").alias("start"))
    settled = []
    while True:
        x = runs.join(ready, ["parent", "run"])
        done = stash(x.withColumn("lost", _lost(F.transform("members", lambda m: m["v"]), F.col("start"))), "slug_settled")
        if done.isEmpty():
            break
        each = done.select("parent", F.explode(F.arrays_zip("members", "lost")).alias("e")) \
            .select("parent", "e.members.child", "e.members.n", "e.lost")
        settled.append(each)
        count = F.col("start") + F.size(F.filter("lost", lambda x: x))
        onwards = done.select("parent", (F.col("run") + 1).alias("run"), count.cast("long").alias("start"))
        own = each.select(F.col("child").alias("parent"), F.lit(0).cast("long").alias("run"),
                          F.when(F.col("lost"), -1).otherwise(0).cast("long").alias("start"))
        ready = onwards.unionByName(own)
    out = contests.select("parent", "child", "n", F.lit(False).alias("lost")).limit(0)
    for each in settled:
        out = out.unionByName(each)
    return out


def assign_slugs(new: DataFrame, existing: DataFrame, seq: str = "seq",
                 base_col: str = "base") -> DataFrame:
    """Unique slug per new row. ``new``: request_id, ``seq``, ``base`` (an
    already slugified name); ``existing``: ``slug``. Returns request_id, slug."""
    rows = stash(new.select(F.col("request_id").cast("long").alias("request_id"),
                            F.col(seq).cast("long").alias("seq"), F.col(base_col).alias("base")), "slug_requests")
    bases = stash(rows.groupBy("base").agg(F.min(F.struct("seq", "request_id")).alias("_f"), F.count(F.lit(1)).alias("requests"))
                  .select("base", "requests", F.col("_f.seq").alias("first_seq"), F.col("_f.request_id").alias("first_id")), "slug_bases")
    base_keys = bases.select("base")

    # existing slugs as (base, index): s is index 0 of s and index N of its parent
    taken = existing.select("slug").where(F.col("slug").isNotNull()).distinct()
    t_parent, t_n = _split_tail(F.col("slug"))
    t_idx = stash(taken.select(F.col("slug").alias("base"), F.lit(0).cast("long").alias("t"))
                  .unionByName(taken.select(t_parent.alias("base"), t_n.alias("t")).where(F.col("t").isNotNull()))
                  .join(base_keys, "base", "left_semi").distinct(), "slug_taken")

    # requested bases that are the "-N" of another requested base
    c_parent, c_n = _split_tail(F.col("base"))
    links = bases.select(F.col("base").alias("child"), F.col("first_seq").alias("child_first_seq"),
                         F.col("first_id").alias("child_first_id"), c_parent.alias("parent"),
                         c_n.alias("n")) \
        .where(F.col("n").isNotNull()) \
        .join(base_keys.withColumnRenamed("base", "parent"), "parent", "left_semi")
    # a child whose own slug exists has nothing to lose
    links = stash(links.join(t_idx.where(F.col("t") == 0).select(F.col("base").alias("child")), "child", "left_anti"), "slug_links")
    # a base that one request asks for has no ranks to count
    several = rows.join(bases.where("requests > 1").select("base"), "base", "left_semi")
    one = bases.where("requests = 1").select("base", F.col("first_id").alias("request_id"), "first_seq")
    parents = links.select(F.col("parent").alias("base")).distinct()
    asked = several.select("base", "seq", "request_id").unionByName(
        one.join(parents, "base", "left_semi").select("base", F.col("first_seq").alias("seq"), "request_id"))
    # One running count serves three purposes (groups ``g`` of a base):
    # g=0: existing slugs and contests of the parent below each contested n
    #      (contests, kind 0, sort before existing entries, kind 1, at equal index);
    # g=1: the rank of every request by (seq, request id), and how many of the
    #      parent's come before the child's first.
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    entry = lambda df, base, g, o1, o2, o3, w, k: df.select(
        F.col(base).alias("base"), F.lit(g).alias("g"), o1.alias("o1"), o2.alias("o2"), o3.alias("o3"),
        F.lit(w).alias("_w"), F.lit(k).alias("_k"))
    probe = entry(links, "parent", 0, F.col("n"), zero, F.col("child"), 0, 1) \
        .unionByName(entry(t_idx, "base", 0, F.col("t"), F.lit(1).cast("long"), none, 1, 0)) \
        .unionByName(entry(links, "parent", 1, F.col("child_first_seq"), F.col("child_first_id"), F.col("child"), 0, 0)) \
        .unionByName(entry(asked, "base", 1, F.col("seq"), F.col("request_id"), none, 1, 0))
    counts = cumulative_sums(probe, ["base", "g"], ["o1", "o2", "o3"], {"_c": "_w", "_i": "_k"})
    counts = stash(counts.select("base", "g", "o1", "o2", "o3", "_c", "_i"), "slug_counts")
    ranked = counts.where((F.col("g") == 1) & F.col("o3").isNull()).select(
        "base", (F.col("_c") - 1).alias("rank"), F.col("o2").alias("request_id"))
    at = counts.where(F.col("o3").isNotNull()).groupBy(F.col("base").alias("parent"), F.col("o3").alias("child")).agg(
        *[F.max(F.when(F.col("g") == g, c)).alias(name) for name, g, c in
          (("n", 0, F.col("o1")), ("below", 0, F.col("_c")), ("i", 0, F.col("_i") - 1), ("before", 1, F.col("_c")))])
    contests = at.select("parent", "child", "i", "n", (F.col("before") - (F.col("n") - F.col("below") - F.col("i"))).alias("v"))
    settled = settle(contests)
    lost = settled.select(F.when(F.col("lost"), F.col("child")).otherwise(F.col("parent")).alias("base"),
                          F.when(F.col("lost"), F.lit(0)).otherwise(F.col("n")).cast("long").alias("t"))

    # blocked indices per base, then the r-th free index for the r-th request;
    # a base without any has all its ranks free, and one that one request asks
    # for takes the first free index
    blocked = stash(t_idx.unionByName(lost).distinct(), "slug_blocked")
    gaps = cumulative_sum(blocked, ["base"], ["t"], F.lit(1), "_j") \
        .select("base", (F.col("t") - (F.col("_j") - 1)).alias("v"), F.lit(0).alias("kind"),
                F.lit(None).cast("long").alias("request_id"))
    held = base_keys.join(blocked.select("base").distinct(), "base", "left_semi")
    ranks = ranked.join(bases.where("requests > 1").select("base"), "base", "left_semi")
    free = ranks.join(held, "base", "left_anti").select("base", F.col("rank").alias("at"), "request_id")
    met = ranks.join(held, "base", "left_semi").select("base", F.col("rank").alias("v"), F.lit(1).alias("kind"), "request_id")
    counted = cumulative_sum(gaps.join(met.select("base").distinct(), "base", "left_semi").unionByName(met), ["base"], ["v", "kind", "request_id"],
                             F.when(F.col("kind") == 0, 1).otherwise(0), "_before") \
        .where(F.col("kind") == 1).select("base", (F.col("v") + F.col("_before")).alias("at"), "request_id")
    first = one.join(gaps.where("v <= 0").groupBy("base").agg(F.count(F.lit(1)).alias("at")), "base", "left") \
        .select("base", F.coalesce("at", F.lit(0)).alias("at"), "request_id")
    out = free.unionByName(counted).unionByName(first)
    return out.select("request_id", _candidate(F.col("base"), F.col("at")).alias("slug"))


def create_products(requests: DataFrame, products: DataFrame, categories: DataFrame,
                    sellers: DataFrame, users: DataFrame):
    """CHG-12: bulk product creation. The seller comes from the caller's
    e-mail (no seller profile: reject); a known ``category_slug`` replaces the
    given category, an unknown one leaves it; the slug is SCL-1 of the name,
    made unique by SCL-2 against existing products and earlier requests; a
    request without a name is rejected. Other columns of the requests that
    products have are carried, a missing or null status is LIVE and a missing
    or null ``is_active`` true. New ids follow the largest product id in order
    of the request id. Returns ``(new_products, rejects)``."""
    acct = sellers.select(F.col("id").alias("seller_id"), F.col("user_id").alias("_uid")) \
        .join(users.select(F.col("id").alias("_uid"), F.col("email").alias("caller_email")), "_uid") \
        .drop("_uid")
    x = requests.join(acct, "caller_email", "left")
    rejects = x.where(F.col("seller_id").isNull() | F.col("name").isNull()).select(
        "request_id", F.when(F.col("seller_id").isNull(), F.lit("SELLER_NOT_FOUND"))
        .otherwise(F.lit("NAME_MISSING")).alias("reason"))
    ok = x.where(F.col("seller_id").isNotNull() & F.col("name").isNotNull())
    cats = categories.select(F.col("slug").alias("category_slug"), F.col("id").alias("_cat"))
    ok = ok.join(cats, "category_slug", "left") \
        .withColumn("category_id", F.coalesce("_cat", "category_id")).drop("_cat") \
        .withColumn("base", slugify("name"))
    slugs = assign_slugs(ok.select("request_id", "seq", "base"), products.select("slug"))
    default = {"status": F.lit("LIVE"), "is_active": F.lit(True)}
    fixed = ["seller_id", "category_id", "name", "slug", "price"]
    for c, value in default.items():
        ok = ok.withColumn(c, F.coalesce(F.col(c), value) if c in ok.columns else value)
    carried = [c for c in ok.columns if c in {*products.columns, *default} and c not in fixed and c != "id"]
    new = ok.join(slugs, "request_id").select(F.col("request_id").alias("id"), *fixed, *carried)
    return new_ids(new, products), rejects
