"""Data-quality audits: the database's constraints as batch checks (DQ-1..8).

Every check returns violations in one shape: ``table_name, rule, key, value``
(``key`` and ``value`` as text), so audits of many tables stack with
``unionByName``. Each check is one scan (plus one shuffle for UNIQUE and the
anti join for foreign keys); nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION_COLS = ("table_name", "rule", "key", "value")


def _key(cols) -> Column:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _out(df: DataFrame, table: str, rule, key: Column, value: Column) -> DataFrame:
    rule_c = rule if isinstance(rule, Column) else F.lit(rule)
    return df.select(F.lit(table).alias("table_name"), rule_c.alias("rule"),
                     key.alias("key"), value.cast("string").alias("value"))


def stack_violations(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def not_null(df: DataFrame, table: str, cols: list[str], key="id") -> DataFrame:
    """DQ-1: one row per (row, column) that is null; a single scan unpivots
    the null flags with ``stack``."""
    pairs = ", ".join(f"'{c}', `{c}` IS NULL" for c in cols)
    flagged = df.select(_key(key).alias("_k"),
                        F.expr(f"stack({len(cols)}, {pairs}) AS (_col, _null)"))
    hit = flagged.where("_null")
    return _out(hit, table, F.concat(F.lit("not_null:"), F.col("_col")), F.col("_k"),
                F.lit(None))


def check(df: DataFrame, table: str, name: str, rule: Column, key="id",
          value: Column | None = None) -> DataFrame:
    """DQ-2: rows for which ``rule`` is false (null passes, as in SQL)."""
    return _out(df.where(~F.coalesce(rule, F.lit(True))), table, f"check:{name}", _key(key),
                value if value is not None else F.lit(None))


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """DQ-3: key values held by more than one row; a key with a null part is
    exempt. Reported once per duplicated key with its row count."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dup = df.where(full).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _out(dup, table, f"unique:{','.join(keys)}", _key(keys), F.col("_n"))


def orphans(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str = "id",
            key="id", parent_table: str = "") -> DataFrame:
    """DQ-4: child rows whose non-null foreign key has no parent."""
    p = parent.select(F.col(pk).alias("_pk"))
    lost = child.where(F.col(fk).isNotNull()).join(p, child[fk] == p["_pk"], "left_anti")
    return _out(lost, table, f"fk:{fk}->{parent_table}", _key(key), F.col(fk))


def orphans_of(parent: DataFrame, parent_table: str, children: list[tuple], pk: str = "id") -> DataFrame:
    """DQ-4 for every key that points at one parent: ``children`` lists (frame,
    table, foreign key, key columns). The references are stacked (a child with
    several keys to this parent is scanned once) and meet one scan of the
    parent in one anti join. What is joined is narrow: the number of the rule
    stands for the names, and a reference of the parent's own type (or another
    width of integer) for its text."""
    of = parent.schema[pk].dataType
    whole = ("tinyint", "smallint", "int", "bigint")
    plain = all(k == of or {k.simpleString(), of.simpleString()} <= set(whole)
                for k in (df.schema[fk].dataType for df, _, fk, _ in children))
    scans: dict[str, list] = {}
    for child in children:
        scans.setdefault(child[1], []).append(child)
    stacked, names = [], []
    for table, keys in scans.items():
        refs = []
        for _, _, fk, key in keys:
            text = [] if plain else [F.col(fk).cast("string").alias("value")]
            refs.append(F.struct(F.lit(len(names)).alias("_rule"), _key(key).alias("key"),
                                 F.col(fk).cast(of).alias("ref"), *text))
            names.append((table, f"fk:{fk}->{parent_table}"))
        stacked.append(keys[0][0].select(F.inline(F.array(*refs)))
                       .where(F.col("ref" if plain else "value").isNotNull()))
    lost = stack_violations(*stacked).join(parent.select(F.col(pk).alias("ref")), "ref", "left_anti")
    name = lambda i: F.array(*[F.lit(n[i]) for n in names])[F.col("_rule")]
    return lost.select(name(0).alias("table_name"), name(1).alias("rule"), "key",
                       F.col("ref").cast("string").alias("value") if plain else "value")


def domain(df: DataFrame, table: str, col: str, values, key="id") -> DataFrame:
    """DQ-5: non-null values outside the enumerated domain."""
    bad = df.where(F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return _out(bad, table, f"domain:{col}", _key(key), F.col(col))


def max_length(df: DataFrame, table: str, col: str, n: int, key="id") -> DataFrame:
    """DQ-6: text longer than ``n`` characters."""
    bad = df.where(F.char_length(col) > n)
    return _out(bad, table, f"length:{col}>{n}", _key(key), F.char_length(col))


def decimal_fit(df: DataFrame, table: str, col: str, precision: int, scale: int,
                key="id") -> DataFrame:
    """DQ-7: values that overflow DECIMAL(precision, scale); extra decimals
    are rounded (as PostgreSQL stores them), so only overflow is reported."""
    fitted = F.col(col).try_cast(f"decimal({precision},{scale})")
    bad = df.where(F.col(col).isNotNull() & fitted.isNull())
    return _out(bad, table, f"decimal:{col}({precision},{scale})", _key(key), F.col(col))


def drift(stored: DataFrame, recomputed: DataFrame, table: str, keys: list[str],
          cols: list[str]) -> DataFrame:
    """DQ-8: stored denormalised values that differ from recomputed ones
    (a key missing on the recomputed side compares with null)."""
    r = recomputed.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols])
    x = stored.select(*keys, *cols).join(r, keys, "left")
    parts = []
    for c in cols:
        bad = x.where(~F.col(c).eqNullSafe(F.col(f"_r_{c}")))
        parts.append(_out(bad, table, f"drift:{c}", _key(keys),
                          F.concat_ws(" != ", F.col(c).cast("string"),
                                      F.coalesce(F.col(f"_r_{c}").cast("string"), F.lit("null")))))
    return stack_violations(*parts)
