"""Readers for supplier price lists and event sheets landed as text (CSV).

A workbook is decoded upstream into one CSV file per sheet; the jobs here
read a whole folder of them at once.  Rows keep their position in the file
(``line_no``), because header detection and "first n rows" rules depend on it.

Files are read in splits, so neither their number nor their size meets in one
task.  A quoted cell may hold line breaks, so a line may go on with the row
before it.  Whether it does follows from the quotes of all lines before: each line
turns "inside a quoted cell or not" at its start into the same at its end, which is one
of four maps, and maps compose.  Every split reports the map of its lines (only lines
with quotes count), a prefix over the splits of a file, one small row each, tells every
split its state at the start, and rows of several lines are put together, across splits
too.  As in a CSV reader, a quote opens a cell only as its first character, and
a quoted cell that never ends takes the rest of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.session import cut_lineage

def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, at, k, line): ``at`` is where the line's split of the file
    begins, ``k`` grows by one from line to line of a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"),
        F.regexp_replace("value", "\r$", "").alias("line"))


def _open_after(part: Column, is_open: Column) -> Column:
    """Whether a quoted cell is open behind a comma's part of a line."""
    odd = (F.length(part) - F.length(F.replace(part, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(is_open, ~odd).otherwise(part.startswith('"') & odd)


def _line_map(line: Column, is_open: bool) -> Column:
    """Whether a quoted cell is open at the line's end, given whether at its start."""
    folded = F.aggregate(F.split(line, ","), F.lit(is_open), lambda state, part: _open_after(part, state))
    return F.when(line.contains('"'), folded).otherwise(F.lit(is_open))


def _composed(by: list[str], order: str, first: Column | None = None):
    """Columns (``_in``, ``_out``): the state before and behind each row when the rows'
    maps (``g0``, ``g1``: state behind it from closed and from open) are applied in
    ``order``.  A map turns the state round, keeps it, or sets it: the state is what was
    set last, turned by the number of turns since; ``first`` before anything is set."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.col("g0") & ~F.col("g1")).cast("int")
    turned = F.sum(turn).over(upto) % 2
    sets = F.when(F.col("g0") == F.col("g1"), (F.col("g0").cast("int") + turned) % 2)
    start = F.lit(0) if first is None else first.cast("int")

    def state(window, turns):
        return ((F.coalesce(F.last("_sets", ignorenulls=True).over(window), start) + turns) % 2 == 1)

    def add(df):
        df = df.withColumn("_turned", turned).withColumn("_sets", sets)
        return df.withColumn("_out", state(upto, F.col("_turned"))).withColumn(
            "_in", state(before, (F.col("_turned") + turn) % 2)).drop("_turned", "_sets")
    return add


def read_sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1/S2.  (file, line_no, line) for every row of every file under ``path``;
    ``file`` is the file name, ``line_no`` counts the rows from 0, ``line`` has the line
    breaks of quoted cells as ``\\n``."""
    return _rows(spark, path).select("file", "line_no", "line")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line_no, line), see ``read_sheet_lines``."""
    lines = _split_lines(spark, path)
    mapped = lines.withColumns({"g0": _line_map(F.col("line"), False), "g1": _line_map(F.col("line"), True)})
    quoted = mapped.where(F.col("g0") | ~F.col("g1")).select("path", "at", "k", "g0", "g1")
    # the map of a split: where its quoted lines lead from closed and from open
    ends = [_composed(["path", "at"], "k", F.lit(x))(quoted).groupBy("path", "at").agg(
        F.max_by("_out", "k").alias(f"g{x}")) for x in (0, 1)]
    splits = lines.groupBy("path", "at").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    splits = splits.join(ends[0], ["path", "at"], "left").join(ends[1], ["path", "at"], "left") \
        .withColumn("quoted", F.col("g0").isNotNull()) \
        .withColumns({"g0": F.coalesce("g0", F.lit(False)), "g1": F.coalesce("g1", F.lit(True))})
    splits = cut_lineage(_composed(["path"], "at")(splits).select("path", "at", "first", "n", "quoted", F.col("_in").alias("open")))
    # lines of splits with quotes get their own state; elsewhere a split is all closed or all open
    inside = mapped.join(splits.where("quoted"), ["path", "at"])
    inside = _composed(["path", "at"], "k", F.col("open"))(inside).select(
        "path", "file", "at", "k", "line", F.col("_in").alias("on"), F.col("_out").alias("goes_on"))
    plain = lines.join(splits.where("NOT quoted"), ["path", "at"]).select(
        "path", "file", "at", "k", "line", F.col("open").alias("on"), F.col("open").alias("goes_on"), "first")
    # rows begin at lines that are not inside a cell: number them over the splits
    begun = inside.groupBy("path", "at").agg(F.count_if(~F.col("on")).alias("rows"))
    counts = splits.join(begun, ["path", "at"], "left").withColumn(
        "rows", F.coalesce("rows", F.when(F.col("open"), F.lit(0)).otherwise(F.col("n"))))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "at", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"))
    here = Window.partitionBy("path", "at").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("row", F.sum((~F.col("on")).cast("long")).over(here) - 1)
    plain = plain.withColumn("row", F.when(F.col("on"), F.lit(-1)).otherwise(F.col("k") - F.col("first"))).drop("first")
    numbered = inside.unionByName(plain).join(offsets, ["path", "at"]) \
        .withColumn("line_no", (F.col("row") + F.col("off")).cast("long"))
    # rows of one line stay where they are; only parts of longer ones are grouped
    part = F.col("on") | F.col("goes_on")
    whole = numbered.where(part).groupBy("path", "file", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("at", "k", "line"))).alias("p")).select(
        "path", "file", "line_no", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("line"))
    return numbered.where(~part).select("path", "file", "line_no", "line").unionByName(whole)


def csv_cells(line: Column) -> Column:
    """The cells of a row as a CSV reader gives them, as text."""
    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit(False).alias("open"))

    def put(state, part):
        cells = F.when(state["open"], F.concat(
            F.slice(state["cells"], F.lit(1), F.size(state["cells"]) - 1),
            F.array(F.concat(F.element_at(state["cells"], -1), F.lit(","), part)))) \
            .otherwise(F.concat(state["cells"], F.array(part)))
        return F.struct(cells.alias("cells"), _open_after(part, state["open"]).alias("open"))

    joined = F.aggregate(F.split(line, ","), start, put)["cells"]
    return F.when(line.contains('"'), F.transform(joined, unquote)).otherwise(F.split(line, ","))


def unquote(c) -> Column:
    """A quoted cell without its quotes, doubled ones undone; others unchanged."""
    inner = F.replace(F.substring(c, 2, 1 << 30), F.lit('""'), F.lit("\0"))
    return F.when(c.startswith('"'), F.replace(F.replace(inner, F.lit('"'), F.lit("")), F.lit("\0"), F.lit('"'))).otherwise(c)


def sheet_cells(lines: DataFrame) -> DataFrame:
    """(file, line_no, col, cell): one row per cell, ``col`` from 0; an empty
    cell is NULL (an empty spreadsheet cell)."""
    exploded = lines.select("file", "line_no", F.posexplode(csv_cells(F.col("line"))).alias("col", "cell"))
    return exploded.select("file", "line_no", F.col("col").cast("long"), F.nullif("cell", F.lit("")).alias("cell"))


def spreadsheet_names(headers: list[str]) -> list[str]:
    """Column names as a spreadsheet reader gives them: an empty header is
    'Unnamed: <i>', a repeated one gets '.1', '.2' ... ('EXPO', 'EXPO.1')."""
    out, seen = [], {}
    for i, h in enumerate(headers):
        name = h if h not in (None, "") else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}.{n}")
    return out


def read_event_sheet(spark: SparkSession, path: str, max_layouts: int = 200) -> DataFrame:
    """S4 / S5.  Event sheets under ``path``, every cell as text (types are
    assigned by the import, with failures reported rather than guessed; empty cells are
    NULL, rows without any cell are left out).  Each file has its own header, its first
    row: layouts are put together by column name, missing columns NULL.  The driver sees
    one row per layout, at most ``max_layouts``."""
    import csv

    rows = cut_lineage(_rows(spark, path))
    heads = rows.where("line_no = 0").select("path", F.col("line").alias("header"))
    layouts = [r.header for r in heads.select("header").distinct().orderBy("header").limit(max_layouts + 1).collect()]
    if len(layouts) > max_layouts:
        raise ValueError(f"more than {max_layouts} different headers under {path}")
    if not layouts:
        return spark.createDataFrame([], T.StructType([]))
    names = [spreadsheet_names([h.strip() for h in next(csv.reader([x]), [])]) for x in layouts]
    places: dict[str, dict[int, int]] = {}
    for k, of_layout in enumerate(names):
        for i, name in enumerate(of_layout):
            places.setdefault(name, {})[k] = i
    known = spark.createDataFrame(list(enumerate(layouts)), "layout long, header string")
    heads = heads.join(F.broadcast(known), "header").select("path", "layout")     # max_layouts rows
    body = rows.where((F.col("line_no") > 0) & (F.col("line") != "")).join(heads, "path").select(
        "layout", csv_cells(F.col("line")).alias("cells"))

    def column(name):
        at = None
        for k, i in places[name].items():
            here = F.get("cells", F.lit(i))
            at = F.when(F.col("layout") == k, here) if at is None else at.when(F.col("layout") == k, here)
        return F.nullif(at, F.lit("")).alias(name)

    return body.select(*[column(n) for n in places])
