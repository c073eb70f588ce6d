import csv
import random
from contextlib import contextmanager

import pytest

from delaylake.sources.csv_records import (
    files_by_line_breaks,
    read_csv_records,
    source_row_count,
)
from delaylake.sources.csv_split import split_records, split_starts
from delaylake.sources import csv_split

HEADER = ["A", "B", "C", "D"]


@contextmanager
def splits_of(spark, n_bytes):
    """Files are split after so many bytes, however few there are."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, *lines):
    path.write_text("\n".join([",".join(HEADER), *lines]) + "\n", encoding="utf-8")


def as_csv_module(*paths):
    rows = []
    for path in paths:
        with open(path, encoding="utf-8", newline="") as f:
            rows += [tuple(r[h] for h in HEADER) for r in csv.DictReader(f)]
    return rows


LINES = [
    "1,,x,",
    '2,"p,q"',
    '3,"he said ""hi""","",z,extra',
    "",
    "4,b, c ,d",
    '5,,"a,""b"",c"',
    "6,,,",
    "7",
]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*HEADER).collect())


def same(left, right):
    assert sorted(map(repr, left)) == sorted(map(repr, right))


@pytest.mark.parametrize("line_breaks", [None, True, False])
def test_cells(spark, tmp_path, line_breaks):
    write(tmp_path / "a.csv", *LINES)
    read = read_csv_records(spark, str(tmp_path), line_breaks=line_breaks)
    same([tuple(r) for r in read.collect()], as_csv_module(tmp_path / "a.csv"))


def test_line_breaks_in_quotes(spark, tmp_path):
    write(tmp_path / "a.csv", *LINES)
    write(tmp_path / "b.csv", '8,"two\nlines",x,y', "9,b,c,d", '10,"a\n\nb ""\nc""",x')
    single, spanning = files_by_line_breaks(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in single] == ["a.csv"]
    assert [f.rsplit("/", 1)[1] for f in spanning] == ["b.csv"]
    read = read_csv_records(spark, str(tmp_path))
    expected = as_csv_module(tmp_path / "a.csv", tmp_path / "b.csv")
    same([tuple(r) for r in read.collect()], expected)
    assert source_row_count(read).first().n == len(expected) == 10


def test_marks_in_unquoted_cells_are_plain_text(spark, tmp_path):
    write(tmp_path / "a.csv", '1,5",x,y', '2,"a","b",c"d', "3,x,y", '4,6",7",z')
    assert len(files_by_line_breaks(spark, str(tmp_path))[0]) == 1
    read = read_csv_records(spark, str(tmp_path))
    same([tuple(r) for r in read.collect()], as_csv_module(tmp_path / "a.csv"))


def test_doubled_mark_at_the_end_of_a_line_does_not_close_the_cell(spark, tmp_path):
    write(tmp_path / "a.csv", '1,"say ""yes""', 'or no",x,y', f'2,"{"long " * 20000}",x,y')
    assert len(files_by_line_breaks(spark, str(tmp_path))[1]) == 1
    read = read_csv_records(spark, str(tmp_path))
    same([tuple(r) for r in read.collect()], as_csv_module(tmp_path / "a.csv"))


def test_header_decides_names_and_a_different_one_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X,Y\n1,2\n")
    assert read_csv_records(spark, str(tmp_path)).columns == ["X", "Y"]
    (tmp_path / "b.csv").write_text("Y,X\n1,2\n")
    with pytest.raises(Exception, match="header|Header"):
        read_csv_records(spark, str(tmp_path)).collect()


def test_positions_follow_the_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, first in (("a", 0), ("b", 500)):
        write(tmp_path / f"{name}.csv", *[f"{first + i},{'x' * (i % 40)},y,z" for i in range(500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_csv_records(spark, str(tmp_path), with_position=True)
        read.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("src_file", "src_block").distinct().count() > 5
    ordered = stored.orderBy("src_file", "src_block", "src_row").collect()
    assert [int(r.A) for r in ordered] == list(range(1000))


@pytest.mark.parametrize("line_breaks", [None, True, False])
def test_the_answer_does_not_depend_on_the_columns_asked_for(spark, tmp_path, line_breaks):
    write(tmp_path / "a.csv", *LINES)
    read = read_csv_records(spark, str(tmp_path), line_breaks=line_breaks)
    for i, name in enumerate(HEADER):
        alone = [r[0] for r in read.select(name).collect()]
        same(alone, [r[i] for r in read.select(*HEADER).collect()])
    assert source_row_count(read).first()[0] == len(read.collect())


def test_names_with_spaces_and_brackets(spark, tmp_path):
    home = tmp_path / "my dir"
    home.mkdir()
    for name in ("a[1].csv", "b c.csv", "d{x}*.csv", "e%20f.csv"):
        write(home / name, *LINES, f"{name[0]},x,y,z", '8,"two\nlines",x,y' if name[0] == "b" else "9")
    same(
        rows_of(read_csv_records(spark, str(home))),
        as_csv_module(*sorted(home.iterdir())),
    )


def random_cell(rng):
    """As text in the file: bare, in quotes, with stray marks, with breaks."""
    bare = "".join(rng.choices('ab \té漢"', k=rng.randrange(6)))
    if rng.random() < 0.5:
        return bare if not bare.startswith('"') else "x" + bare
    inner = "".join(rng.choices(["a", "b,", "\n", "\n\n", '""', " ", "é", "x" * 30], k=rng.randrange(8)))
    return f'"{inner}"'


@pytest.mark.parametrize("seed", range(4))
def test_records_over_the_ends_of_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    for name in "ab":
        lines = [
            ",".join([f"{name}{i}", *(random_cell(rng) for _ in range(rng.randrange(5)))])
            for i in range(300)
        ]
        lines.insert(150, '"' + "\nlong, " * 400 + '",after')
        write(tmp_path / f"{name}.csv", *lines)
    expected = [
        tuple(r[h] for h in HEADER)
        for name in "ab"
        for r in csv.DictReader(open(tmp_path / f"{name}.csv", encoding="utf-8"))
    ]
    with splits_of(spark, (97, 300, 1000, 1 << 20)[seed]):
        read = read_csv_records(spark, str(tmp_path), with_position=True)
        read.write.parquet(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out")).orderBy("src_file", "src_block", "src_row")
    found = [tuple(r)[:4] for r in stored.collect()]
    assert found == expected
    if seed < 3:
        assert stored.select("src_file", "src_block").distinct().count() > 15


def test_line_ends_and_blank_lines(spark, tmp_path):
    text = 'A,B,C,D\r\n\r\n1,"x\r\n\r\n \ny",z,w\r\n   \n"2"tail,"a"",\n",c\n3,"never closed,\nmore'
    (tmp_path / "a.csv").write_bytes(text.encode())
    with open(tmp_path / "a.csv", encoding="utf-8") as f:
        expected = [tuple(r[h] for h in HEADER) for r in csv.DictReader(f) if r["A"].strip()]
    with splits_of(spark, 13):
        found = rows_of(read_csv_records(spark, str(tmp_path)))
    # Text after the closing mark makes it a plain cell, with its marks, as in Spark's reader.
    plain = {"2tail": '"2"tail'}
    assert found == sorted((plain.get(r[0], r[0]), *r[1:]) for r in expected)


def test_a_header_with_a_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"A\nB",C\n1,"x\ny"\n')
    with splits_of(spark, 5):
        read = read_csv_records(spark, str(tmp_path))
        assert read.columns == ["A\nB", "C"]
        assert [tuple(r) for r in read.collect()] == [("1", "x\ny")]
        (tmp_path / "b.csv").write_text('C,A\n1,"x\ny"\n')
        with pytest.raises(Exception, match="another header"):
            read_csv_records(spark, str(tmp_path)).collect()


def test_where_splits_begin(spark, tmp_path):
    """Against a state machine over the characters before each split."""
    rng = random.Random(8)
    lines = [",".join(random_cell(rng) for _ in range(3)) for _ in range(200)]
    write(tmp_path / "a.csv", *lines)
    content = (tmp_path / "a.csv").read_bytes()
    with splits_of(spark, 60):
        starts = split_starts(csv_split._lines(spark, str(tmp_path))).collect()
    assert len(starts) > 20
    for row in starts:
        # A line that begins with a split belongs to the split before.
        cut = content.find(b"\n", row.src_block) + 1 if row.src_block else 0
        state, before = "start", ""
        for c in content[:cut].decode():
            if state == "inside":
                state = "closed" if c == '"' else state
            elif state == "closed" and c == '"':
                state = "inside"
            elif c in ",\n":
                state = "start"
            elif state == "start" and c == '"':
                state = "inside"
            else:
                state = "plain"
        assert row.begins_inside == (state == "inside"), row


def test_whole_records_stay_in_the_task_that_reads_them(spark, tmp_path):
    write(tmp_path / "a.csv", *[f'{i},"x\ny, {"z" * 50}",,' for i in range(2000)])
    with splits_of(spark, 20_000):
        records = split_records(spark, str(tmp_path))
        files = len(records.select("src_file", "src_block").distinct().collect())
        cut = [
            n for n in records.where("src_row >= 0").select("record").collect() if n[0].endswith(",,")
        ]
        plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert files > 4 and len(cut) == 2000
    # Only the lines at the ends of splits are grouped, and nothing is put in order.
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Aggregate") == 1


def test_an_empty_source_is_refused_and_one_record_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n"x\n",y')
    found = split_records(spark, str(tmp_path)).orderBy("src_row").collect()
    assert [(r.record, r.is_header) for r in found] == [("A,B", True), ('"x\n",y', False)]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no text|PATH|UNABLE"):
        read_csv_records(spark, str(tmp_path / "none"))
