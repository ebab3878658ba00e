"""Delimited files and review operators on odd inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import review
from millrace.sources import delimited


def test_delimited_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffname;note\n Jörg ;\"x;\"\"y\"\"\"\n\n#N/A;3\n;\n \n".encode())
    (tmp_path / "b.txt").write_bytes("n|v|w\n€1|2\n".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"a\tb\n\x81\t\xe9\n")
    (tmp_path / "d.txt").write_bytes(b"a,b;c\nd,e;f\n")
    (tmp_path / "e.txt").write_bytes(b"one\ntwo\n")
    (tmp_path / "f.txt").write_bytes(b"")
    (tmp_path / "g.txt").write_bytes(b"a|b|c\n1|2|\n")
    rows, files = delimited.read(spark, str(tmp_path))
    name = F.element_at(F.split("file", "/"), -1)
    held = {r.f: (r.encoding, r.separator, r.ties, r.width) for r in files.withColumn("f", name).collect()}
    assert held == {
        "a.csv": ("utf-8", ";", [], 2), "b.txt": ("cp1252", "|", [], 3), "c.txt": ("latin-1", "\t", [], 2), "d.txt": ("utf-8", ",", [";"], 2), "e.txt": ("utf-8", ",", [], 1), "g.txt": ("utf-8", "|", [], 3)}
    cells: dict[str, list] = {}
    for r in rows.withColumn("f", name).orderBy("f", "at").collect():
        cells.setdefault(r.f, []).append(r.cells)
    assert cells == {
        "a.csv": [["name", "note"], ["Jörg", 'x;"y"'], [None, None], [None, "3"]], "b.txt": [["n", "v", "w"], ["€1", "2", None]], "c.txt": [["a", "b"], ["\x81", "é"]],
        "d.txt": [["a", "b;c"], ["d", "e;f"]], "e.txt": [["one"], ["two"]], "g.txt": [["a", "b", "c"], ["1", "2", None]]}


def test_statistics_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", "x", True, 1), ("a", "y", False, 2), ("a", None, None, 3), ("b", None, None, 4)], "g string, v string, ok boolean, at int")
    assert [tuple(r) for r in review.most_common(rows, "v", "at", ["g"]).collect()] == [("a", "x", 1)]
    assert sorted(map(tuple, review.fitness(rows, "ok", ["g"]).collect())) == [("a", 2, 50.0), ("b", 0, None)]
    assert sorted(map(tuple, review.null_findings(rows).collect())) == [("ok", 2, 0.5), ("v", 2, 0.5)]
    assert review.null_findings(rows.limit(0)).count() == 0
    assert sorted(map(tuple, review.fill_mode(rows, ["v", "ok"], ["g"]).collect())) == [("a", 2)]
    assert sorted((r.g, r.rows) for r in review.status_counts(rows, "g").collect()) == [("a", 3), ("b", 1)]


def test_schemas_candidates_and_divisions(spark):
    tables = spark.createDataFrame([("p", 1, ["a", "b"], 5), ("q", 2, ["b", "a"], 1), ("r", 3, ["a", "c"], 2), ("s", 4, ["z"], 0)], "label string, position int, columns array<string>, rows long")
    found = sorted((r.labels, r.rows, r.appended, r.is_reference, r.missing, r.extra) for r in review.append_report(tables).collect())
    assert found == [(["p", "q"], 6, True, True, [], []), (["r"], 2, False, False, ["b"], ["c"])]
    assert review.append_report(tables.limit(0)).count() == 0
    votes = spark.createDataFrame([("c", "x", 0.9), ("c", "x", 0.2), ("c", "y", 0.5), ("d", "x", 0.9), ("d", "y", 0.9), ("e", "x", 0.4), ("f", "x", None)], "of string, target string, score double")
    assert [(r.of, r.target, r.score) for r in review.candidates(votes, ["of"], "target", "score", 0.5, 0.1).collect()] == [("c", "x", 0.9)]
    table = spark.createDataFrame([(1, " East ", "94"), (2, "West", "PC0094"), (3, "East", "0094_01"), (4, None, "95")], "position int, division string, profit_center string")
    facts = spark.createDataFrame([("PC0094_02",), ("95",), (None,)], "code string")
    assert {r.code: r.divisions for r in review.divisions(facts, "code", table).collect()} == {"PC0094_02": ["East", "West"], "95": [], None: []}


def test_names_and_texts(spark):
    df = spark.sql("SELECT 1 AS a, DATE'2024-01-02' AS `b c`, TIMESTAMP'2024-01-02 03:04:05.6' AS t")
    assert review.renamed(df, {"a": " A b "}).columns == ["A b", "b c", "t"]
    for bad in ({"a": " "}, {"a": "T"}, {"a": "x" * 129}, {"a": "x\ny"}, {"no": "x"}):
        with pytest.raises(ValueError, match="column"):
            review.renamed(df, bad)
    assert tuple(review.as_text(df).first()) == ("1", "2024-01-02", "2024-01-02 03:04:05")
    with pytest.raises(ValueError, match="remain"):
        review.without(df, df.columns)
    assert review.without(df, ["a"]).columns == ["b c", "t"]
