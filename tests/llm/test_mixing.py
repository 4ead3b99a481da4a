"""Weighted fair queueing against its SQL and its contract."""
import duckdb
import pytest

from cartograph.llm import mixing


def by_oracle(rows, docs=None):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?)", rows)
    got = con.execute(mixing.oracle())
    names = [c[0] for c in got.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in ("doc_id", "size", "source_size", "target", "taken"))
                   for r in got.fetchall()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


EDGE = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)] + [
    (500, None, "s0"), (501, "", "s1"), (502, "a b", None), (None, "x y z", None), (503, " ", "empty"),
    (504, None, "empty"), (7, "repeated row", "s1"), (7, "repeated row", "s1"), (505, "big " * 4000, "big")]


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], [(1, None, None)], []])
def test_matches_sql(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, row int")
    assert rows_of(mixing.mix(df)) == by_oracle(rows)


def test_contract(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most.max() * 2).all()
    assert abs(per.target.sum() - got["size"].sum()) < 1e-3
    again = mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id")
    assert (again.taken.values == got.sort_values("doc_id").taken.values).all()


def test_mixed_repeats_documents(spark):
    df = spark.createDataFrame([(*r, "x") for r in EDGE], "doc_id long, text string, source string, times string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = mixing.mix(df).where("taken > 0").selectExpr("sum(taken / size)").first()[0]
    assert out.count() == int(taken)
    assert mixing.mixed(df.limit(0)).count() == 0
