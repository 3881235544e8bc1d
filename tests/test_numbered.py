"""Row numbers of split CSV files against a sequential read."""

import csv
import io
import random

import pytest

from fieldloom.sources import numbered


def made(r, n):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["path", "class_name", "class_index"])
    for k in range(n):
        w.writerow([f"p{k}", r.choice(["plain", 'with "quotes"', "two\nlines", "\n\n\nblank ones", "a,b", "é ü", '"', "tail\n"]), k])
        for _ in range(r.choice([0] * 9 + [1, 3])):
            out.write("\n")
    return out.getvalue()


def sequential(text):
    """(line, row, cells) as Python's csv module counts them, blank rows left out."""
    lines = io.StringIO(text, newline="")
    reader = csv.reader(lines)
    rows, line = [], 1
    for cells in reader:
        if cells:
            rows.append((line, len(rows) + 1, tuple(cells)))
        line = reader.line_num + 1
    return rows


@pytest.mark.parametrize("size", ["90", "777", "64m"])
def test_numbers_equal_a_sequential_read(spark, tmp_path, size):
    texts = {f"f{k}.csv": made(random.Random(k), n) for k, n in enumerate((1, 0, 60, 150))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        rows = numbered.numbered(spark, str(tmp_path))
        got = sorted((r.file.rpartition("/")[2], r.line, r.row, r.value) for r in rows.collect())
        cells = sorted((r.file.rpartition("/")[2], r.line, r.row, (r.path, r.class_name, r.class_index)) for r in numbered.parsed(rows, ["path", "class_name", "class_index"]).collect())
        whole = sorted((r.file.rpartition("/")[2], r.number) for r in numbered.across_files(rows).select("file", "number").collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = sorted((name, line, row, c) for name, text in texts.items() for line, row, c in sequential(text))
    assert [(*g[:3], tuple(next(csv.reader(io.StringIO(g[3], newline="")))) ) for g in got] == want
    assert cells == [w for w in want if w[2] > 1]
    assert [n for _, n in whole] == list(range(1, 1 + sum(w[2] > 1 for w in want)))


def test_errors_name_the_row_and_the_first_rule(spark, tmp_path):
    lines = ["path,class_name,class_index", "a,Leaf,0", "b,Leaf,0", "a,Leaf,0", "c,Corn,9", "d,Moss,1", "", "e,Rust,x", "f,Rust,2", "g,Rust,1", "h,Rare,3", "gone,Leaf,0", "a,Corn,0"]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "m.csv")
    assert numbered.header(spark, path, ["path", "class_index"]) == ["path", "class_name", "class_index"]
    with pytest.raises(ValueError, match="sha256"):
        numbered.header(spark, path, ["path", "sha256"])
    name = lambda *c: spark.createDataFrame([(x,) for x in c], "class_name string")
    classes = spark.createDataFrame([("Leaf", 0), ("Rust", 1), ("Corn", 9)], "class_name string, class_index int")
    files = spark.createDataFrame([(x,) for x in "abcdefgh"], "path string")
    rows = numbered.parsed(numbered.numbered(spark, path), ["path", "class_name", "class_index"])
    got = sorted((e.row, e.path, e.rule) for e in numbered.manifest_errors(rows, classes, name("Leaf", "Rust", "Rare"), name("Corn"), files, ["row"]).collect())
    assert got == [(4, "a", "duplicate_path"), (5, "c", "excluded_class"), (6, "d", "class_out_of_scope"), (7, "e", "index_not_integer"), (8, "f", "index_mismatch"), (10, "h", "class_unknown"), (11, "gone", "file_missing"), (12, "a", "duplicate_path")]
