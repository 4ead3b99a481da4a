"""Deep pages, many substring searches at once, foreign keys by parent: held
against plain Python on hand-made rows."""
import datetime as dt
import random
import re

import pytest

from cartograph.operators import catalog as C
from cartograph.operators import quality as Q
from cartograph.operators.common import deep_page
from cartograph.operators.search import names_containing


def _order(rows, keys):
    """Sort as PostgreSQL does: nulls rank above every value."""
    rows = list(rows)
    for at, down in reversed(keys):
        rows.sort(key=lambda r: (r[at] is None, 0 if r[at] is None else r[at]), reverse=down)
    return rows


@pytest.mark.parametrize("most", [5, 200])
def test_deep_page_equals_sorted_slice(spark, most):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1.5, 2.0, float(i % 17)]), rng.choice([None, "a", "b", "ab", ""]),
             None if i % 9 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10 ** 12)))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, price double, kind string, at timestamp_ntz").repartition(5)
    for keys in ([("price", True), ("kind", False), ("id", True)], [("at", True), ("id", False)],
                 [("kind", True), ("at", False), ("id", False)]):
        expect = _order(rows, [(["id", "price", "kind", "at"].index(k), d) for k, d in keys])
        for no in (3, 149):
            got = [r.id for r in deep_page(df, keys, no, 20, most=most).collect()]
            assert got == [r[0] for r in expect[no * 20:(no + 1) * 20]], (keys, no)
    assert deep_page(df, [("id", False)], 150, 20, most=most).count() == 0
    assert [r.id for r in deep_page(df, [("id", False)], 1, 1999, most=most).collect()] == list(range(1999, 3000))


def test_deep_page_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "id long, price double")
    assert deep_page(none, [("price", True), ("id", False)], 0).count() == 0
    same = spark.range(500).selectExpr("1 AS price", "id")
    assert deep_page(same, [("price", True)], 3, 100, most=10).count() == 100  # ties no cut divides
    with pytest.raises(ValueError):
        deep_page(none, [("id", False)], -1)


def test_names_containing_equals_like(spark):
    names = ["Red Ring", "red ring", "Green  Tea", "", None, "a", "ab", "100% cotton", "back\\slash", "Ärmel ÄRA",
             "ringring", "x_y", "\U0001f37c bottle"]
    texts = ["ring", "RI_G", "r%g", "", "%", "_", "____", "a", "AB", "ä", "är", "0% c", "\\", "k\\s", "zzz", "re%ing",
             "_\U0001f37c", "\U0001f37c", "  ", None, "ring", "e_n%t", "%%a", "n" * 40]
    products = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.q, r.id) for r in names_containing(
        products, spark.createDataFrame([(t,) for t in texts], "q string"), "q").collect()}

    def like(name, text):
        pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in text.lower())
        return re.fullmatch(f".*{pattern}.*", name.lower(), re.S) is not None
    want = {(t, i) for t in set(texts) - {None} for i, n in enumerate(names) if n is not None and like(n, t)}
    assert got == want
    empty = spark.createDataFrame([], "q string")
    assert names_containing(products, empty, "q").count() == 0


def test_orphans_of_equals_orphans_per_key(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(1, 1, 9), (2, None, 2), (3, 8, None), (3, 8, 7)], "id int, up int, down long")
    b = spark.createDataFrame([("x", "y", 5), ("x", "z", 1)], "k string, l string, up long")
    got = Q.orphans_of(parents, "p", [(a, "a", "up", "id"), (a, "a", "down", ["id"]), (b, "b", "up", ["k", "l"])])
    want = Q.stack_violations(Q.orphans(a, "a", "up", parents, parent_table="p"),
                              Q.orphans(a, "a", "down", parents, parent_table="p"),
                              Q.orphans(b, "b", "up", parents, key=["k", "l"], parent_table="p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 5


def test_orphans_of_joins_no_names_and_keeps_texts_of_other_types(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(1, 1, 9), (2, None, 2), (3, 8, None)], "id int, up int, down long")
    got = Q.orphans_of(parents, "p", [(a, "a", "up", "id"), (a, "a", "down", "id")])
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1]
    assert "fk:" not in below
    assert sorted(map(tuple, got.collect())) == [("a", "fk:down->p", "1", "9"), ("a", "fk:up->p", "3", "8")]
    b = spark.createDataFrame([(1, "07"), (2, "1"), (3, None)], "id int, up string")
    got = Q.orphans_of(parents, "p", [(b, "b", "up", "id"), (a, "a", "down", "id")])
    assert sorted(map(tuple, got.collect())) == [("a", "fk:down->p", "1", "9"), ("b", "fk:up->p", "1", "07")]


@pytest.mark.parametrize("span", [2, 64])
def test_suggest_by_places_equals_reading_every_name(spark, monkeypatch, span):
    monkeypatch.setattr(C, "SPAN", span)
    rng = random.Random(11)
    names = {"".join(rng.choice("aAbBé\U0010ffff_ ") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    names |= {"ab", "AB", "aB" + "x" * 50, "b\U0010ffff\U0010ffffz"}
    asked = {"".join(rng.choice("aAbBé\U0010ffff") for _ in range(rng.randrange(2, 5))) for _ in range(60)}
    asked |= {"ab", "AB", "zz", "a_b", "%b", "b\U0010ffff", "  ", "a"}
    asked = sorted(asked)
    products = spark.createDataFrame([(n, i % 7 > 0) for i, n in enumerate(sorted(names))] + [(None, True), ("ab", True), ("ab", True)],
                                     "name string, is_active boolean")
    live = {r.name for r in products.where("is_active").collect()} - {None}
    got = {}
    for r in C.suggest(products, spark.createDataFrame(list(enumerate(asked)) + [(-1, None), (-2, "AB")],
                                                       "request_id long, prefix string"), 4).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.name))
    for i, p in [*enumerate(asked), (-1, None), (-2, "AB")]:
        hits = []
        if p is not None and len(p.strip()) >= 2:
            like = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in p.lower()) + ".*", re.S)
            hits = sorted((n for n in live if like.fullmatch(n.lower())), key=lambda n: n.encode())[:4]
        assert sorted(got.get(i, [])) == list(enumerate(hits, 1)), p


def test_suggest_without_names_or_prefixes(spark):
    products = spark.createDataFrame([], "name string, is_active boolean")
    asked = spark.createDataFrame([(1, "ab"), (2, "a%")], "request_id long, prefix string")
    assert C.suggest(products, asked).count() == 0
    some = spark.createDataFrame([("abc", True)], "name string, is_active boolean")
    assert C.suggest(some, asked.limit(0)).count() == 0
