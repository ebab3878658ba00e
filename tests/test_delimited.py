"""Quoted line breaks: the same records whatever the size of a split, and as a reader of whole files gives them."""

from __future__ import annotations

import csv
import io
import random

import pytest

from millrace.sources import delimited

PLAIN = ["a", "b c", "5", "", "x;y", 'say ""hi""', "line\nbreak", "two\n\nbreaks", "comma, inside", '""', "\n"]


def field(text: str, r: random.Random) -> str:
    return f'"{text}"' if any(c in text for c in '\n,"') or r.random() < 0.2 else text


def table(seed: int, rows: int) -> str:
    r = random.Random(seed)
    return "\n".join(",".join(field(r.choice(PLAIN), r) for _ in range(4)) for _ in range(rows)) + "\n"


def expected(text: str) -> list[list[str | None]]:
    read = [[(c.strip() or None) for c in row] or [None] for row in csv.reader(io.StringIO(text))]
    while read and not any(read[-1]):
        read.pop()
    width = max(map(len, read), default=0)
    return [row + [None] * (width - len(row)) for row in read]


def read(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows, _ = delimited.read(spark, str(path))
        out = {}
        for r in sorted(rows.collect(), key=lambda r: (r.file, r["at"])):
            out.setdefault(r.file.rsplit("/", 1)[1], []).append(r.cells)
        return out
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", ["37b", "300b", "1m"])
def test_records_do_not_depend_on_splits(spark, tmp_path, split):
    files = {f"f{seed}.csv": "h1,h2,h3,h4\n" * 3 + table(seed, 25) for seed in range(3)}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    assert read(spark, tmp_path, split) == {name: expected(text) for name, text in files.items()}


@pytest.mark.parametrize("split", ["11b", "1m"])
def test_quotes_that_open_nothing(spark, tmp_path, split):
    (tmp_path / "inch.csv").write_text('size,name\n5" pipe,x\n6" pipe,y\n"a\nb",z\n')
    (tmp_path / "open.csv").write_text('k,v\n"one\nline",1\n"never,closed\n3,4\n5,6\n')
    (tmp_path / "tab.csv").write_text('k\tv\n"a\n1,2\nb"\t7\nc\t8\nd\t9\n')
    found = read(spark, tmp_path, split)
    assert found["inch.csv"] == [["size", "name"], ['5" pipe', "x"], ['6" pipe', "y"], ["a\nb", "z"]]
    assert found["open.csv"] == [["k", "v"], ["one\nline", "1"], ['"never', "closed"], ["3", "4"], ["5", "6"]]
    assert found["tab.csv"] == [["k", "v"], ["a\n1,2\nb", "7"], ["c", "8"], ["d", "9"]]


@pytest.mark.parametrize(("line", "outside", "inside"), [
    ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('a,"b', True, False), ('"a""b', True, False), ('x",y', False, False), ('x","y', True, True), ("", False, True), ('"a"b,"c', True, False)])
def test_states_of_a_line(line, outside, inside):
    assert (delimited.ends_inside(line, ",", False), delimited.ends_inside(line, ",", True)) == (outside, inside)
