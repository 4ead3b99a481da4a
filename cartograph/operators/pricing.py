"""PRC-5: promo quotes for a batch of requests.

Two modes:

* ``strict=False`` reproduces the reference's hard-coded quote: three codes,
  matched ignoring case (but not spaces), answered without looking at the
  promo table, the amount or the expiry; FREESHIP is a FIXED 9.99;
* ``strict=True`` (the default for analytics) applies the promo table's rules:
  code matched ignoring case, validity PRC-3 at ``as_of`` against the
  request subtotal, discount PRC-4 when valid.

The hard-coded codes are a three-row literal frame, broadcast (its size is
fixed); the promo table is joined by AQE's own choice.

Uses of a code: :func:`uses_before` counts the orders with the code before each
order, which is what the use cap of PRC-3 asks at that moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions.money import QUOTED_PROMOS, promo_discount, promo_is_valid
from cartograph.operators.common import cumulative_sum, ts_lit


def quote_promos(requests: DataFrame, promos: DataFrame | None = None, strict: bool = True,
                 as_of=None, code_col: str = "code", subtotal_col: str = "subtotal") -> DataFrame:
    """Per request: normalised code, discount value/amount, type, valid."""
    spark = requests.sparkSession
    if not strict:
        quoted = spark.createDataFrame(
            [(c, v, t) for c, v, t in QUOTED_PROMOS],
            "_code string, discount decimal(10,2), discount_type string")
        x = requests.join(F.broadcast(quoted), F.upper(F.col(code_col)) == F.col("_code"), "left")
        return x.select(*requests.columns,
                        F.when(F.col("_code").isNotNull(), F.upper(F.col(code_col))).alias("quoted_code"),
                        "discount", "discount_type",
                        F.col("_code").isNotNull().alias("valid")).drop("_code")
    if promos is None or as_of is None:
        raise ValueError("strict quotes need the promo table and as_of")
    p = promos.select(F.lower("code").alias("_lc"), F.col("code").alias("quoted_code"), "discount_type",
                      "discount_value", "min_order", "max_uses", "uses_count", "expires_at", "is_active")
    x = requests.join(p, F.lower(F.col(code_col)) == F.col("_lc"), "left")
    valid = F.coalesce(promo_is_valid(F.col(subtotal_col), ts_lit(as_of)), F.lit(False))
    return x.select(*requests.columns, "quoted_code",
                    F.when(valid, promo_discount(F.col(subtotal_col))).alias("discount"),
                    "discount_type", valid.alias("valid"))


def uses_before(orders: DataFrame) -> DataFrame:
    """Orders with a promo code, with ``uses_count``: how many orders had used
    the code before (by time, then id). A code that a third of all orders use is
    spread over ranges of time."""
    x = orders.where(F.col("promo_id").isNotNull())
    return cumulative_sum(x, ["promo_id"], ["created_at", "id"], F.lit(1), "_used") \
        .withColumn("uses_count", F.col("_used") - 1).drop("_used")
