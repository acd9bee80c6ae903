"""Lines over many splits, and records over many lines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from wellspark.operators import records as rec
from wellspark.sources.lines import read_lines


def lines_of(spark, files):
    rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string").repartition(3)


def delimiters(spark, files):
    return spark.createDataFrame([(f, d) for f, d in files.items()], "file string, delimiter string")


def some_csv(seed, delimiter):
    r, out, want, row = random.Random(seed), io.StringIO(), [], 0
    for _ in range(60):
        cells = ["".join(r.choice(["a", "b,", ";", "\t", "|", '"', '""', "\n", "\n\n", " x ", "é", ""]) for _ in range(r.randrange(6))) for _ in range(4)]
        cells[0] = "k" + cells[0]  # pandas and csv drop blank lines; a key keeps them apart here
        before = out.tell()
        csv.writer(out, delimiter=delimiter, lineterminator="\n").writerow(cells)
        want += [(row, col, c.strip(" ")) for col, c in enumerate(cells)]
        row += out.getvalue()[before:].count("\n")
    return out.getvalue().removesuffix("\n"), want


@pytest.mark.parametrize("chunk", [1, 7, 65536])
def test_cells_with_line_breaks_equal_a_csv_reader(spark, chunk):
    texts, want, found = {}, [], {}
    for i, d in enumerate(",;\t|"):
        texts[f"f{i}"], cells = some_csv(i, d)
        found[f"f{i}"] = d
        want += [(f"f{i}", *c) for c in cells]
    d = delimiters(spark, found)
    got = rec.record_cells(rec.to_records(lines_of(spark, texts), d, chunk), d).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_quotes_inside_a_field_are_text_and_a_file_left_open_is_read_by_line(spark):
    texts = {"inch": 'a,5" disk\nb,3"\nc,"x ""y""\nz"', "open": 'a,"b\nc,d\ne,f', "closed": '"a"b,c\n"a"\n"",""', "blank": 'a,"1\n\n2"\n\nb,3', "long": 'a,"' + "x\n" * 30_000 + '"\nb,2'}
    d = delimiters(spark, dict.fromkeys(texts, ","))
    rows = {(r.file, r.row): (r.n_lines, r.record) for r in rec.to_records(lines_of(spark, texts), d, 2).collect()}
    assert [rows["inch", i][0] for i in (0, 1, 2)] == [1, 1, 2] and rows["inch", 2][1] == 'c,"x ""y""\nz"'
    assert [rows["open", i] for i in range(3)] == [(1, 'a,"b'), (1, "c,d"), (1, "e,f")]
    assert len([k for k in rows if k[0] == "closed"]) == 3
    assert rows["blank", 0] == (3, 'a,"1\n\n2"') and rows["blank", 3] == (1, "") and rows["blank", 4] == (1, "b,3")
    assert rows["long", 0][0] == 30_001 and ("long", 30_001) in rows
    cells = {(r.file, r.row, r.col): r.cell for r in rec.record_cells(rec.to_records(lines_of(spark, texts), d), d).collect()}
    assert cells["inch", 0, 1] == '5" disk' and cells["inch", 2, 1] == 'x "y"\nz' and cells["blank", 0, 1] == "1\n\n2"


def test_lines_are_numbered_over_splits(spark, tmp_path):
    r = random.Random(2)
    big = "\n".join("" if r.random() < 0.2 else f"line {i} " + "x" * r.randrange(200) for i in range(20_000))
    texts = {"big.txt": big.encode() + b"\n", "small.txt": b"a\r\nb\n\nc", "latin.txt": "é\nü\nabc".encode("latin-1"), "wide.txt": "ab\né\nc".encode("utf-16"), "empty.txt": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.text(f"{tmp_path}/big.txt").select("_metadata.file_block_start").distinct().count() > 5
        got = {}
        for row in read_lines(spark, [f"{tmp_path}/{n}" for n in texts]).collect():
            got.setdefault(row.file.rsplit("/", 1)[1], []).append((row.line_no, row.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    lines = {n: [line for _, line in sorted(v)] for n, v in got.items()}
    assert all(sorted(i for i, _ in v) == list(range(len(v))) for v in got.values())
    assert lines == {"big.txt": big.split("\n"), "small.txt": ["a", "b", "", "c"], "latin.txt": ["é", "ü", "abc"], "wide.txt": ["ab", "é", "c"]}
