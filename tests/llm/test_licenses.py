"""License scan against exact containment in every window and region."""
from pathlib import Path

import duckdb
import pytest

from cartograph.llm import licenses

T = licenses.TEMPLATES


def rows_of(df):
    return sorted((r.doc_id, r.license, round(r.containment, 9), r.at_word) for r in df.collect())


def by_oracle(rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted((a, b, round(c, 9), d) for a, b, c, d in con.execute(
        f"select doc_id, license, containment, at_word from ({licenses.oracle()})").fetchall())


def sample():
    filler = " ".join(f"word{i}" for i in range(300))
    words = T["mit"].split()
    rows = [(i, f"{filler[:37 * i]} {t} {filler}") for i, t in enumerate(T.values())]
    edited = words[:]
    edited[20], edited[50] = "changed", "altered"
    half = words[: len(words) // 2]
    return rows + [(100, " ".join(edited)), (101, " ".join(half)), (102, None), (103, ""), (104, "Released under the MIT"),
                   (105, (T["mit-line"] + " ") * 50), (106, "RELEASED   under;the\n mit LICENSE"), (107, filler * 20 + T["bsd"]),
                   (108, "a " * 20000)]


def test_matches_every_window(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, w int")
    got = rows_of(licenses.scan(df))
    assert got == by_oracle(rows)
    found = {(i, k) for i, k, *_ in got}
    assert {(i, k) for i, k in enumerate(T)} <= found and (100, "mit") in found and (105, "mit-line") in found
    assert not {i for i, *_ in got} & {101, 102, 103, 104, 108}
    assert (106, "mit-line") in found and (107, "bsd") in found


def test_inserted_words_at_every_offset(spark):
    """The MIT notice with 30 foreign words in its middle still holds 94 % of its shingles, wherever the windows begin."""
    words, foreign = T["mit"].split(), [f"foreign{i}" for i in range(60)]
    rows = []
    for n in (10, 30, 60):
        text = " ".join(words[:35] + foreign[:n] + words[35:])
        rows += [(1000 * n + off, f"{' '.join(f'w{i}' for i in range(off))} {text} {' '.join(f'v{i}' for i in range(200))}") for off in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(licenses.scan(df))
    assert [(r[0], r[1]) for r in got] == [(i, "mit") for i, _ in rows]
    assert got == by_oracle(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, T["isc"]), (None, T["isc"]), (1, T["isc"]), (1, "x")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.license)) for r in licenses.scan(df).collect()) == ["(1, 'isc')", "(None, 'isc')"]
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, texts_by_name={"short": "four words are few"})


def test_query_finds_parts_and_variants_of_common_licenses(spark, tmp_path):
    from cartograph.llm.queries import op7_license_scan
    known = licenses.common_texts()
    gpl = (Path(licenses.__file__).parent / "license_texts/gpl-3.txt").read_text().split()
    filler = " ".join(f"word{i}" for i in range(300))
    docs = ["This program is free software: " + known["agpl-3.0"], "This library is free software; " + known["lgpl-2.1"],
            known["cc-by-sa-4.0"], known["cc-by-nc-nd-4.0"], filler + " " + known["mit-warranty"], known["bsd-2-clause"],
            known["bsd-2-clause"] + " 3. Neither the name of Example " + known["bsd-3-clause"],
            filler + " " + " ".join(gpl[2000:2600]) + " " + filler, filler]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_license_scan(spark, str(tmp_path))
    rows = rows_of(got)
    con = duckdb.connect()
    want = con.execute(f"select * from ({licenses.oracle(f"'{tmp_path}/documents.parquet/*.parquet'", known)})").fetchall()
    assert rows == sorted((a, b, round(c, 9), d) for a, b, c, d in want)
    found = {i: {k for j, k, *_ in rows if j == i} for i in range(len(docs))}
    assert all(k in found[i] for i, k in enumerate(["agpl-3.0", "lgpl-2.1", "cc-by-sa-4.0", "cc-by-nc-nd-4.0", "mit-warranty",
                                                    "bsd-2-clause", "bsd-3-clause"]))
    assert "bsd-3-clause" not in found[5] and any(k.startswith("gpl-3/") for k in found[7]) and not found[8]


def test_templates_from_a_table(spark):
    known = spark.createDataFrame([("own", "these are the words of our own license")], "license string, text string")
    df = spark.createDataFrame([(1, "x these are the words of our own license y"), (2, T["isc"])], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(df, texts_by_name=known).collect()] == [(1, "own")]


def test_notices_tell_kinds_and_versions_apart(spark):
    known = {k: v for k, v in (licenses.TEMPLATES | licenses.NOTICES).items() if k.startswith(("gpl", "lgpl", "agpl", "cc-"))}
    end = ", or (at your option) any later version."
    docs = [(k, f"This program is free software: you can redistribute it and/or modify it {v}{end}") for k, v in known.items()]
    df = spark.createDataFrame(docs, "name string, text string")
    got = licenses.scan(df, "name", texts_by_name=known).collect()
    assert {(r.name, r.license) for r in got} == {(k, k) for k in known}
