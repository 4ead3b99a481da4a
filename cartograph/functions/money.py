"""Pricing rules as Column expressions (PRC-1..4, SCL-5, PRJ-1, PRJ-2).

Money stays ``DECIMAL`` from input to output; a percentage is applied with a
``Decimal('0.01')`` literal (a Python float literal would turn the arithmetic
into double). Every rule takes its clock as an argument (``as_of``); nothing
reads the wall clock.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference's pricing code.
EXPRESS_FEE = Decimal("9.99")
SAME_DAY_FEE = Decimal("19.99")
STANDARD_DAYS = 3
FAST_DAYS = 1
DELIVERY_TYPES = ("STANDARD", "EXPRESS")
ORDER_STATUSES = ("CONFIRMED", "PROCESSING", "SHIPPED", "OUT_FOR_DELIVERY", "DELIVERED", "CANCELLED")
PRODUCT_STATUSES = ("LIVE", "DRAFT", "DEACTIVATED")
USER_ROLES = ("CUSTOMER", "SELLER", "ADMIN")
DISCOUNT_TYPES = ("PERCENT", "FIXED")
CANCELLABLE = ("CONFIRMED", "PROCESSING")
# Hard-coded promo quote: code, discount, type (three codes, any case).
QUOTED_PROMOS = (("BABY10", Decimal("10"), "PERCENT"),
                 ("FREESHIP", Decimal("9.99"), "FIXED"),
                 ("WELCOME20", Decimal("20"), "PERCENT"))
CENT = Decimal("0.01")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def delivery_fee(delivery_type) -> Column:
    """PRC-1: EXPRESS 9.99; SAME_DAY 19.99 (unreachable after the enum
    check, kept for the rule's sake); else 0."""
    t = F.upper(_col(delivery_type))
    return (F.when(t == "EXPRESS", F.lit(EXPRESS_FEE))
             .when(t == "SAME_DAY", F.lit(SAME_DAY_FEE))
             .otherwise(F.lit(Decimal("0.00")))).cast("decimal(10,2)")


def delivery_date(delivery_type, as_of) -> Column:
    """PRC-2: ``as_of`` date + 3 days for STANDARD, else + 1."""
    days = F.when(F.upper(_col(delivery_type)) == "STANDARD", F.lit(STANDARD_DAYS)) \
        .otherwise(F.lit(FAST_DAYS))
    return F.date_add(F.to_date(_col(as_of)), days)


def promo_is_valid(total, as_of, is_active="is_active", expires_at="expires_at",
                   max_uses="max_uses", uses_count="uses_count", min_order="min_order") -> Column:
    """PRC-3: active; not expired (expiry equal to ``as_of`` is still valid,
    null never expires); under the use cap when one is set; total >= minimum."""
    return (_col(is_active)
            & (_col(expires_at).isNull() | (_col(expires_at) >= _col(as_of)))
            & (_col(max_uses).isNull() | (_col(uses_count) < _col(max_uses)))
            & (_col(total) >= _col(min_order)))


def promo_discount(subtotal, discount_type="discount_type", discount_value="discount_value") -> Column:
    """PRC-4: PERCENT -> subtotal * value / 100 rounded to cents;
    FIXED -> min(value, subtotal)."""
    sub = _col(subtotal)
    pct = F.round(sub * _col(discount_value) * F.lit(CENT), 2)
    return (F.when(_col(discount_type) == "PERCENT", pct)
             .otherwise(F.least(_col(discount_value), sub))).cast("decimal(12,2)")


def stock_state(stock, threshold) -> Column:
    """PRJ-1: OUT when stock <= 0, LOW when 0 < stock <= threshold, else OK."""
    s, t = _col(stock), _col(threshold)
    return F.when(s <= 0, F.lit("OUT")).when(s <= t, F.lit("LOW")).otherwise(F.lit("OK"))


def tracking_eta(date) -> Column:
    """PRJ-2: the date as ``yyyy-MM-dd`` text, or ``TBD``."""
    return F.coalesce(F.date_format(_col(date), "yyyy-MM-dd"), F.lit("TBD"))


def shipping_address(body_json, full_name) -> Column:
    """SCL-5: address struct from a JSON object. A key that is missing takes
    the default (full name, N/A, N/A, 00000); a key present with null stays
    null. Country is always US."""
    m = F.from_json(_col(body_json), "map<string,string>")

    def pick(key, default):
        return F.when(m.isNotNull() & F.map_contains_key(m, key), m[key]).otherwise(default)

    return F.struct(
        pick("name", _col(full_name)).alias("recipient_name"),
        pick("street", F.lit("N/A")).alias("address_line1"),
        pick("city", F.lit("N/A")).alias("city"),
        pick("zipCode", F.lit("00000")).alias("postal_code"),
        F.lit("US").alias("country"),
    )
