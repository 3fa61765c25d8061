from oracle import connect, differences

from costlens.llm import licenses as L
from costlens.llm import queries


def found(df, known=None):
    rows = L.scan(df, known).collect()
    return sorted(((r.doc_id, r.license, tuple(r.notices)) for r in rows), key=repr)


def test_canonical_forms(docs):
    mit = L.KNOWN["MIT"]
    dressed = "Copyright (c) 2020 Somebody\n© 2021 Else\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  \n").replace(",", " ;")
    texts = [
        (1, dressed.replace("SUBLICENSE", "SUBLICENCE")),
        (2, mit + " One more word."),
        (3, "words\nLicensed under the Apache Licence, version 2.0! and more\nreleased under the MIT license"),
        (4, "Licensed under the Apache License, Version 2.0 or later."),
        (5, None),
        (6, "!!! ..."),
    ]
    assert found(docs(*texts)) == [
        (1, "MIT", ()),
        (2, None, ()),
        (3, None, ("Apache-2.0 notice", "MIT notice")),
        (4, None, ()),
        (5, None, ()),
        (6, None, ()),
    ]


def test_the_way_without_broadcast_is_the_same(table, monkeypatch):
    near = found(table("documents"))
    monkeypatch.setattr(L, "MAX_BROADCAST", 0)
    assert found(table("documents")) == near and any(n for *_, n in near)


def test_odd_rows(spark, odd, odd_rows, none):
    known = spark.createDataFrame([("b", "One."), ("a", "one"), ("c", None), ("d", "..")], "license string, text string")
    rows = found(odd, known)
    assert len(rows) == len(odd_rows)
    assert [r for r in rows if r[1]] == [(3, "a", ("a", "b"))] * 2 + [(9, "a", ("a", "b"))]
    assert found(none) == [] and all(r[1:] == (None, ()) for r in found(odd, known.limit(0)))


def test_no_python_on_executors(table):
    plan = L.scan(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_licence_files_with_titles(docs):
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "Zlib": "zlib License"}
    titles |= {"BSD-3-Clause": "BSD 3-Clause License"}
    texts = [(i, f"{t}\n\nCopyright (c) 2020 Somebody\n\n{L.KNOWN[k]}") for i, (k, t) in enumerate(titles.items())]
    assert [r[1] for r in found(docs(*texts))] == list(titles)


def test_titled_rows_equal_sql(spark, tmp_path):
    """The SQL of the registered query drops title lines, and only those, as the scan does."""
    titles = ["MIT License", "The MIT Licence (MIT)", "ISC license", "MIT License and more", "*** BSD 3-Clause License ***", "zlib LICENSE", "License"]
    rows = [(i, f"{t}\n\nCopyright (c) 2020 Somebody\n\n{text}") for i, (t, text) in enumerate((t, x) for t in titles for x in L.KNOWN.values())]
    rows += [(1000, None), (1001, ""), (1002, "MIT License"), (1003, "mit license " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert differences(queries.op4_licenses(spark, str(tmp_path)), connect(str(tmp_path)), queries.OP4_SQL) == []
    named = {r[1] for r in found(spark.read.parquet(f"{tmp_path}/documents.parquet"))}
    assert {"MIT", "ISC", "BSD-3-Clause", "Zlib"} <= named
