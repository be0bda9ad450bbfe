"""Grids, headers and CSV files on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.errors import SourceError
from ledgerspark.plans.rollup import plan_rollup
from ledgerspark.plans.rules import Rule, RuleBundle, SheetSpec
from ledgerspark.schemas import CELLS, GRID, MERGE_RANGES
from ledgerspark.sources import files, grid as G


def grid_of(spark, rows, source="bills/a.xlsx", sheet="S"):
    data = [(source, sheet, i + 1, cells) for i, cells in enumerate(rows)]
    return spark.createDataFrame(data, GRID)


def header_of(grid, spec):
    found = G.resolve_header(G.pick_sheet(grid, spec), spec).orderBy("col_idx").collect()
    return [(r["col_idx"], r["category"], r["field"]) for r in found]


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_bytes(content.encode(encoding))
    return path


def cells_of(grid):
    rows = grid.orderBy("source_file", "row_no").collect()
    return [(r["row_no"], r["cells"]) for r in rows]


def test_two_level_header(spark):
    grid = grid_of(spark, [["A", "A", "B", "shop"], ["x", "y", "x", "shop"]])
    assert header_of(grid, SheetSpec("S", field_row=2, category_row=1)) == [
        (-1, None, "FILE_NAME"),
        (0, "A", "x"),
        (1, "A", "y"),
        (2, "B", "x"),
        (3, None, "shop"),
    ]


def test_upper_text_stands_in_for_an_empty_field(spark):
    grid = grid_of(spark, [["A", " "], [None, "y"]])
    spec = SheetSpec("S", field_row=2, category_row=1)
    assert header_of(grid, spec)[1:] == [(0, None, "A"), (1, None, "y")]


def test_physical_file_name_column_wins(spark):
    grid = grid_of(spark, [["FILE_NAME", "v"], ["given", "1"]])
    assert header_of(grid, SheetSpec("S")) == [(0, None, "FILE_NAME"), (1, None, "v")]


@pytest.mark.parametrize(
    "last_row, resolved, message",
    [
        (-1, 10, None),
        (-2, 9, None),
        (-4, 7, None),
        (0, 0, "last_row cannot be zero."),
        (99, 99, "last_row exceeds the actual file row count."),
        (-20, -9, "field_row and last_row must resolve to positive row numbers."),
        (1, 1, "The data range is empty after applying category_row, field_row, and last_row."),
    ],
)
def test_row_range(spark, last_row, resolved, message):
    grid = grid_of(spark, [["h"]] + [[str(i)] for i in range(9)])
    found = G.sheet_bounds(grid, SheetSpec("S", 1, last_row)).first()
    assert (found["resolved_last_row"], found["message"]) == (resolved, message)


def test_header_only_sheet_is_empty_but_valid(spark):
    grid = grid_of(spark, [["A", "B"], ["x", "y"]])
    spec = SheetSpec("S", field_row=2, last_row=-1)
    assert G.sheet_bounds(grid, spec).first()["message"] is None
    assert G.data_rows(G.pick_sheet(grid, spec), spec).isEmpty()


def test_default_sheet_needs_a_single_sheet(spark):
    one = grid_of(spark, [["h"], ["1"]], source="a.xlsx")
    two = grid_of(spark, [["h"], ["1"]], source="b.xlsx").unionByName(
        grid_of(spark, [["h"]], source="b.xlsx", sheet="T")
    )
    spec = SheetSpec("DEFAULT")
    found = {
        r["source_file"]: r["message"] for r in G.sheet_bounds(one.unionByName(two), spec).collect()
    }
    assert found == {"a.xlsx": None, "b.xlsx": G.DEFAULT_NEEDS_ONE}
    picked = G.pick_sheet(one.unionByName(two), spec).select("source_file").distinct().collect()
    assert [r[0] for r in picked] == ["a.xlsx"]


def test_csv_only_has_the_default_sheet(spark):
    grid = grid_of(spark, [["h"], ["1"]], source="a.csv", sheet="DEFAULT")
    assert G.sheet_bounds(grid, SheetSpec("S")).first()["message"] == G.CSV_NEEDS_DEFAULT


def test_merged_ranges(spark):
    cells = spark.createDataFrame(
        [("f", "S", 1, 1, "A"), ("f", "S", 1, 2, None), ("f", "S", 2, 1, "x"), ("f", "S", 2, 2, "y")],
        CELLS,
    )
    ranges = spark.createDataFrame([("f", "S", 1, 1, 1, 2)], MERGE_RANGES)
    grid = G.grid_from_cells(G.expand_merged(cells, ranges))
    assert cells_of(grid) == [(1, ["A", "A"]), (2, ["x", "y"])]


def test_long_and_holed_merged_ranges(spark):
    """A long range with all its cells, one over cells that are missing, and a sheet without ranges."""
    long = [("f", "S", r, c, f"{r}/{c}") for r in range(1, 1201) for c in (1, 2, 3)]
    cells = spark.createDataFrame([*long, ("g", "S", 5, 2, "corner"), ("h", "S", 1, 1, "x")], CELLS)
    ranges = [("f", "S", 200, 900, 2, 3), ("f", "S", 1, 1, 1, 3), ("g", "S", 5, 6, 2, 4), ("i", "S", 1, 2, 1, 1)]
    found = {tuple(r)[:4]: r["value"] for r in G.expand_merged(cells, spark.createDataFrame(ranges, MERGE_RANGES)).collect()}
    expected = {(f, s, r, c): v for f, s, r, c, v in long} | {("h", "S", 1, 1): "x"}
    for f, s, r1, r2, c1, c2 in ranges:
        corner = {("f", 200): "200/2", ("f", 1): "1/1", ("g", 5): "corner"}.get((f, r1))
        expected |= {(f, s, r, c): corner for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
    assert found == expected


def test_rollup_over_differing_files(spark):
    a = grid_of(spark, [["shop", "v"], ["A", "`1.5"], [None, None], ["", ""]], "x/one.xlsx")
    b = grid_of(spark, [["v", "shop"], ["2", "A"], ["4", "B"]], "x/two.xlsx")
    rules = (
        Rule("shop", "GROUP", "S", "shop"),
        Rule("source", "GROUP", "S", "FILE_NAME"),
        Rule("v", "SUM", "S", "v", condition="`shop` <=> 'A'"),
    )
    spec = SheetSpec("S")
    given = G.sheet_input(a.unionByName(b), spec, rules)
    plan = plan_rollup({"S": given}, RuleBundle("p", (spec,), rules), "202605", ordered=True)
    found = [(r["shop"], r["source"], float(r["v"])) for r in plan.release().collect()]
    assert found == [("A", "one", 1.5), ("A", "two", 2.0), ("B", "two", 0.0)]


def test_white_space_rows_are_data(spark):
    grid = grid_of(spark, [["shop", "v"], [" ", "1"], ["", None]])
    rules = (Rule("shop", "GROUP", "S", "shop"), Rule("v", "SUM", "S", "v", optional=True))
    given = G.sheet_input(grid, SheetSpec("S"), rules)
    assert [r["__row"] for r in given.frame.collect()] == [2]


def test_csv_back_ticks_and_file_name(spark, tmp_path):
    write(tmp_path, "wechat-demo.csv", "id,shop,v\n`1001,`蔡林记中南店,`12.50\n", "utf-8-sig")
    grid = files.read_grid(spark, str(tmp_path))
    spec = SheetSpec("DEFAULT")
    header = G.resolve_header(grid, spec)
    cells = G.long_cells(G.data_rows(grid, spec), header).orderBy("col_idx").collect()
    assert [(r["field"], r["value"]) for r in cells] == [
        ("FILE_NAME", "wechat-demo"),
        ("id", "1001"),
        ("shop", "蔡林记中南店"),
        ("v", "12.50"),
    ]


def test_blank_csv_lines_do_not_count(spark, tmp_path):
    text = "one\n\ntwo\n , \nthree\n\nfour\nshop,v\nA,1\n"
    write(tmp_path, "a.csv", text)
    rows = cells_of(files.read_grid(spark, str(tmp_path)))
    assert [n for n, _ in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[4] == (5, ["shop", "v"])


def test_quotes_and_line_breaks(spark, tmp_path):
    write(tmp_path, "a.csv", 'a,"say ""x"", y"\nb,"two\nlines"\n')
    rows = cells_of(files.read_grid(spark, str(tmp_path)))
    assert rows == [(1, ["a", 'say "x", y']), (2, ["b", "two\nlines"])]


def test_encodings(spark, tmp_path):
    write(tmp_path, "a.csv", "日期,门店\n2026-05-01,蔡林记\n", "gb18030")
    write(tmp_path, "b.CSV", "日期,门店\n2026-05-02,蔡林记\n", "utf-8")
    write(tmp_path, "~$b.csv", "x\n")
    found = {
        r["path"].rsplit("/", 1)[-1]: r["encoding"]
        for r in files.file_encodings(spark, str(tmp_path)).collect()
    }
    assert found == {"a.csv": "GB18030", "b.CSV": "UTF-8"}
    grid = files.read_grid(spark, str(tmp_path))
    assert [cells for _, cells in cells_of(grid)] == [
        ["日期", "门店"],
        ["2026-05-01", "蔡林记"],
        ["日期", "门店"],
        ["2026-05-02", "蔡林记"],
    ]


def test_file_types(spark, tmp_path):
    with pytest.raises(SourceError):
        files.require_one_type(files.file_inventory(spark, str(tmp_path)))
    write(tmp_path, "a.csv", "x\n")
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep", "b.csv", "x\n")
    write(tmp_path, "c.txt", "x\n")
    inventory = files.file_inventory(spark, str(tmp_path))
    assert files.require_one_type(inventory) == ".csv" and inventory.count() == 2
    picks = {files.sample_file(inventory, "seed").first()[0] for _ in range(2)}
    assert len(picks) == 1
    write(tmp_path, "d.xlsx", "x\n")
    with pytest.raises(SourceError):
        files.require_one_type(files.file_inventory(spark, str(tmp_path)))


def test_row_numbers_across_blocks(spark, tmp_path):
    """A file in several read tasks is numbered as if one task had read it."""
    lines = "".join(f"{i},x\n" if i % 7 else "\n" for i in range(5000))
    write(tmp_path, "a.csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        grid = files.read_grid(spark, str(tmp_path))
        blocks = grid.rdd.getNumPartitions()
        rows = [(r["row_no"], r["cells"][0]) for r in grid.orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 1
    expected = [str(i) for i in range(5000) if i % 7]
    assert rows == [(i + 1, value) for i, value in enumerate(expected)]


def test_header_is_found_in_one_pass(spark):
    grid = grid_of(spark, [["a", "b"], ["1", "2"]])
    header = G.resolve_header(grid, SheetSpec("S"))
    bound = G.bind_header(header, [G.matches(None, "a"), G.called("b"), G.called("none")]).first()
    assert [bound["n0"], bound["n1"], bound["n2"]] == [1, 1, 0]
    assert [bound["x0"], bound["x1"], bound["x2"]] == [0, 1, None]
    assert grid.select(F.size("cells")).first()[0] == 2


def test_wide_rows_broken_files_and_odd_names(spark, tmp_path):
    import pytest

    from ledgerspark.errors import SourceError
    from ledgerspark.sources import files

    def folder(name, data):
        (tmp_path / name).mkdir()
        for file, content in data.items():
            (tmp_path / name / file).write_bytes(content)
        return str(tmp_path / name)

    named = folder("named", {"门店 1+2.csv": b"a,b\n1,2\n"})
    found = files.read_grid(spark, named).select("source_file").distinct().collect()
    assert len(found) == 1 and found[0][0].endswith("/门店 1+2.csv")
    wide = folder("wide", {"a.csv": b"1,2,,9\n1\n,,,,5\n"})
    assert [c for _, c in cells_of(files.read_grid(spark, wide))] == [["1", "2", "", "9"], ["1"], ["", "", "", "", "5"]]
    broken = folder("broken", {"a.csv": b"\xff\xff\xfe,2\n"})
    with pytest.raises(Exception, match="fits no encoding"):
        files.read_grid(spark, broken).collect()
    with pytest.raises(SourceError):
        files.read_grid(spark, folder("books", {"a.xlsx": b"x"}))


def test_repeated_keys_are_valid_json(spark):
    from ledgerspark.sources import jsonl

    lines = spark.createDataFrame([('{"type":"a","type":"b"}',), ("{bad",)], "raw string")
    assert [r["raw"] for r in jsonl.good_lines(lines).collect()] == ['{"type":"a","type":"b"}']


TRICKY = [
    'a,"b,""c"" d",e',
    '5" pipe,"x"',
    '"open\nline, two\r\nthree","after"',
    '"closed"tail,"",""""',
    '""',
    ' "not quoted",y"z"',
    '"a""\n""b"',
    "plain,row,,,",
    '"",,"\n\n\n"',
    "  ,\t",
    '"ends with comma,\n",1',
    '"蔡林记,\n中南店",2',
    '"' + "long line\n" * 60 + '",end',
]


def read_like_csv(data, encoding):
    import csv
    import io

    rows = csv.reader(io.StringIO(data.decode(encoding), newline=""))
    return [row for row in rows if any(c.strip() for c in row)]


@pytest.mark.parametrize("encoding, block", [("utf-8", 90), ("gb18030", 300), ("utf-8-sig", 500), ("utf-8", 1 << 20)])
def test_records_in_many_blocks_equal_one_reading(spark, tmp_path, encoding, block):
    """A quote that is never closed takes in the rest of the file, all but its last line feed."""
    import numpy as np

    from ledgerspark.session import settings

    rng = np.random.default_rng(block)
    data = {}
    for name in ("a", "b"):
        lines = [TRICKY[i] for i in rng.integers(0, len(TRICKY), 25)]
        text = "".join(x + ("\r\n" if i % 3 == 0 else "\n") for i, x in enumerate(lines))
        data[name] = (text + ('"never closed,\nat all' if name == "b" else "last,row")).encode(encoding)
        (tmp_path / f"{name}.csv").write_bytes(data[name])
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "0"}):
        grid = files.read_grid(spark, str(tmp_path))
        found = cells_of(grid.where(F.col("source_file").endswith("/a.csv")))
        other = cells_of(grid.where(F.col("source_file").endswith("/b.csv")))
    kind = "utf-8-sig" if encoding.startswith("utf") else encoding
    assert found == list(enumerate(read_like_csv(data["a"], kind), 1))
    assert other == list(enumerate(read_like_csv(data["b"], kind), 1))


def test_hidden_and_empty_files(spark, tmp_path):
    (tmp_path / "_deep").mkdir()
    for name, content in (
        ("a.csv", b"shop,v\nA,1\n"), ("_b.csv", b"shop,v\nB,2\n"), (".c.csv", b"shop,v\nC,3\n"), ("_deep/d.csv", b"shop,v\nD,4\n"),
        ("e.csv", b""), ("f.csv", b" , \n\n"), ("~$g.csv", b"x\n"),
    ):
        (tmp_path / name).write_bytes(content)
    inventory = files.file_inventory(spark, str(tmp_path))
    names = lambda df: sorted(r[0].rsplit("/", 1)[-1] for r in df.collect())
    assert names(inventory.select("path")) == [".c.csv", "_b.csv", "a.csv", "d.csv", "e.csv", "f.csv"]
    grid = files.read_grid(spark, str(tmp_path))
    assert names(grid.select("source_file").distinct()) == [".c.csv", "_b.csv", "a.csv", "d.csv"]
    assert grid.select("source_file").distinct().join(inventory, F.col("path") == F.col("source_file")).count() == 4
    bounds = G.sheet_bounds(grid, SheetSpec("DEFAULT"), inventory)
    found = {r["source_file"].rsplit("/", 1)[-1]: (r["total_rows"], r["message"]) for r in bounds.collect()}
    empty = {n: (0, f"No rows were found in {p}.") for n, p in ((n, r[0]) for r in inventory.select("path").collect() for n in [r[0].rsplit("/", 1)[-1]]) if n in ("e.csv", "f.csv")}
    assert found == {n: (2, None) for n in (".c.csv", "_b.csv", "a.csv", "d.csv")} | empty
    one = files.read_grid(spark, str(tmp_path / "_b.csv"))
    assert [c for _, c in cells_of(one)] == [["shop", "v"], ["B", "2"]]


def test_large_files_are_read_in_a_few_hundred_blocks():
    from ledgerspark.registry import grids

    for length in (0, 1, 100_000, 10 << 20, 1 << 30, 10**12 + 1):
        size = grids.block_bytes(length)
        assert size >= grids.LEAST_BLOCK and -(-length // size) <= grids.BLOCKS
    # Small files are still cut anywhere.
    assert -(-200_000 // grids.block_bytes(200_000)) > 8


def test_names_that_spark_escapes_are_found_once_per_block(spark, tmp_path):
    from ledgerspark.session import settings

    folder = tmp_path / "a b%20+c"
    folder.mkdir()
    for name in ("x y.csv", "_h+%41.csv", "~$x.csv"):
        (folder / name).write_bytes(b'1,"two\nlines"\n' * 400)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}):
        lines, _ = files.csv_lines(spark, str(folder))
        # No name is worked out per line.
        assert "url_decode" not in lines._jdf.queryExecution().optimizedPlan().toString().lower()
        found = files.read_grid(spark, str(folder)).groupBy("source_file").count().collect()
    assert sorted((r["source_file"].rsplit("/", 1)[-1], r["count"]) for r in found) == [("_h+%41.csv", 400), ("x y.csv", 400)]
    assert all("/a b%20+c/" in r["source_file"] for r in found)
