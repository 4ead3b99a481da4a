"""SRC-1: typed table scans.

Each driver table is read with an explicit schema, so no file is sampled for
inference; a file that lacks a column of the contract or holds it in another
type raises an error before it is scanned. Parquet keeps column pruning and
filter pushdown, which Catalyst applies to everything built on these frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TS = T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """Read one table with its fixed schema (SRC-1)."""
    schema, path = schema or DRIVER_SCHEMAS.get(name), table_path(sf_dir, name)
    if schema is None:
        return spark.read.parquet(path)
    check_schema(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


_CHECKED: set[tuple] = set()


def check_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Raise when the files at ``path`` lack a column of ``schema`` or hold it
    in another type. Reads a footer, once per application and path; columns
    beyond the contract are allowed."""
    key = (spark.sparkContext.applicationId, path, schema.simpleString())
    if key in _CHECKED:
        return
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    wrong = [f"{f.name}: {f.dataType.simpleString()} expected, "
             f"{found[f.name].simpleString() if f.name in found else 'no column'} found"
             for f in schema if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path} does not fit its contract: " + "; ".join(wrong))
    _CHECKED.add(key)


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """Read a live database table in parallel ranges of ``partition_column``."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties or {})
