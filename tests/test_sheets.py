import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from stockfair.sources import sheets


def test_lines_and_cells(spark, scratch):
    with open(os.path.join(scratch, "x.csv"), "wb") as fh:
        fh.write(b'a,b,c\r\n1,"two, 2",\r\n\r\n"say ""hi""",5,6\r\n')
    lines = sheets.read_sheet_lines(spark, scratch)
    got = [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()]
    assert got == [(0, "a,b,c"), (1, '1,"two, 2",'), (2, ""), (3, '"say ""hi""",5,6')]
    cells = {(r.line_no, r.col): r.cell for r in sheets.sheet_cells(lines).collect()}
    assert cells[(1, 1)] == "two, 2" and cells[(1, 2)] is None
    assert cells[(2, 0)] is None
    assert cells[(3, 0)] == 'say "hi"' and cells[(3, 2)] == "6"


def test_spreadsheet_names():
    assert sheets.spreadsheet_names(["EXPO", "Nome", "EXPO", "", "EXPO"]) == \
        ["EXPO", "Nome", "EXPO.1", "Unnamed: 3", "EXPO.2"]


def test_event_sheets_keep_their_own_headers(spark, scratch):
    for name, body in (("a.csv", "Nome,Incassi\nX,1\n"), ("b.csv", "Incassi,Nome,Km\n2,Y,3\n")):
        with open(os.path.join(scratch, name), "w") as fh:
            fh.write(body)
    rows = {r.Nome: (r.Incassi, r.Km) for r in sheets.read_event_sheet(spark, scratch).collect()}
    assert rows == {"X": ("1", None), "Y": ("2", "3")}


def test_lines_of_a_file_in_many_splits(spark, scratch):
    with open(os.path.join(scratch, "long.csv"), "w") as fh:
        fh.write("".join(f"line {i},{'x' * (i % 90)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = sheets.read_sheet_lines(spark, scratch).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.line_no, r.line.split(",")[0]) for r in rows) == [(i, f"line {i}") for i in range(3000)]


def _csv_rows(body):
    """A one-process CSV reader's rows, line ends inside cells as \\n; a blank line is a row."""
    rows = list(csv.reader(io.StringIO(body.replace("\r\n", "\n"), newline="")))
    return [r or [""] for r in rows]


PIECES = ["a", "bc", "", "x y", "5\" pipe", '"q"', '"two, 2"', '"say ""hi"""', '"over\nlines"', '"a,\nb,\n\nc"', '""', '"\n"',
          'no"quote', '"end"x', "é"]


@pytest.mark.parametrize("split", ["64", "300", "1m"])
def test_rows_equal_a_csv_reader(spark, scratch, split):
    """Random files with cells over lines and stray quotes, read in splits."""
    rng = random.Random(int(split.rstrip("m")))
    want = {}
    for f in range(4):
        end = rng.choice(["\n", "\r\n"])
        body = end.join(",".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 5))) for _ in range(60)) + end
        with open(os.path.join(scratch, f"{f}.csv"), "w", newline="") as fh:
            fh.write(body)
        want[f"{f}.csv"] = _csv_rows(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = sheets.read_sheet_lines(spark, scratch)
        got = lines.select("file", "line_no", sheets.csv_cells(F.col("line")).alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for file, rows in want.items():
        mine = {r.line_no: r.c for r in got if r.file == file}
        assert [mine[i] for i in range(len(mine))] == rows


def test_unclosed_cell_takes_the_rest(spark, scratch):
    with open(os.path.join(scratch, "x.csv"), "w") as fh:
        fh.write('a,b\n1,"open\n2,3\n4,5')
    got = sheets.read_sheet_lines(spark, scratch).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "a,b"), (1, '1,"open\n2,3\n4,5')]


def test_event_sheet_cell_over_lines(spark, scratch):
    with open(os.path.join(scratch, "e.csv"), "w") as fh:
        fh.write('Nome,Località,Incassi\n"x\ny",Roma,5\nz,"Milano, nord",6\n\n')
    rows = sheets.read_event_sheet(spark, scratch).collect()
    assert sorted((r.Nome, r["Località"], r.Incassi) for r in rows) == [("x\ny", "Roma", "5"), ("z", "Milano, nord", "6")]


def test_header_over_lines_and_empty_folder(spark, scratch):
    with open(os.path.join(scratch, "e.csv"), "w") as fh:
        fh.write('"Nome\nEvento",Incassi\nx,5\n')
    (row,) = sheets.read_event_sheet(spark, scratch).collect()
    assert row.asDict() == {"Nome\nEvento": "x", "Incassi": "5"}
    empty = os.path.join(scratch, "none")
    os.mkdir(empty)
    with open(os.path.join(empty, "x.csv"), "w"):
        pass
    assert sheets.read_event_sheet(spark, empty).columns == []
