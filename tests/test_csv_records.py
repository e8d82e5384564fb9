import csv
import random

import pytest
from grid_rows import attempt

from attempt_grid import ATTEMPT_COLUMNS, ContractError, read_attempts_csv
from attempt_grid.sources.csv_records import read_attempts_csv_parts, read_csv_records

NAMES = ["a", "b", "c"]


def random_text(draw):
    return draw.choice(
        ["", "x", "plain text", 'say "so"', "two\nlines", "three\n\nlines,", "comma, comma", '"', '""\n"', "é\nü", " padded ", "\n", "7"]
    ) + draw.choice(["", "y" * draw.randrange(60)])


def write(path, rows, names=NAMES, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([names, *rows])


@pytest.fixture
def small_parts(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    yield
    spark.conf.set(key, before)


def whole(spark, path, names=NAMES):
    """The rows of the reader that takes a file as a whole."""
    frame = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    return sorted(map(str, frame.select(*names).collect()))


def in_parts(spark, path, names=NAMES):
    return sorted(map(str, read_csv_records(spark, path, names).collect()))


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_parts_of_a_file_give_the_rows_of_the_whole(spark, small_parts, tmp_path, seed, end):
    draw, path = random.Random(seed), str(tmp_path / "t.csv")
    rows = [[random_text(draw) for _ in NAMES] for _ in range(1500)]
    write(path, rows, end=end)
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 10
    found = in_parts(spark, path)
    assert len(found) > 1400 and found == whole(spark, path)


def test_a_part_may_lie_inside_one_field(spark, small_parts, tmp_path):
    path = str(tmp_path / "t.csv")
    write(path, [["1", "line\n" * 3000, "x"], ["2", 'quote " and\nbreak', "y"], ["3", "", "z"]])
    assert in_parts(spark, path) == whole(spark, path)
    with pytest.raises(Exception, match="never closed"):
        read_csv_records(spark, path, NAMES, max_record_lines=1000).collect()


def test_headers_are_mapped_file_by_file(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    write(folder / "1.csv", [["1", "2", "3"]])
    write(folder / "2.csv", [["6", "break\nhere", "extra", "5"]], ["c", "b", "surplus", "a"])
    found = sorted(map(tuple, read_csv_records(spark, str(folder), NAMES).collect()))
    assert found == [("1", "2", "3"), ("5", "break\nhere", "6")]
    write(folder / "3.csv", [["1", "2"]], ["a", "b"])
    with pytest.raises(ContractError, match="lacks the columns c"):
        read_csv_records(spark, str(folder), NAMES)


def test_blank_files_and_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    write(path, [])
    assert in_parts(spark, str(path)) == []
    path.write_text("﻿a,b,c\n\n1,,\"\"\n\n", encoding="utf-8")
    assert in_parts(spark, str(path)) == whole(spark, str(path)) and len(in_parts(spark, str(path))) == 1


def test_attempts(spark, small_parts, tmp_path):
    path, draw = str(tmp_path / "attempts.csv"), random.Random(4)
    rows = [attempt(user_id=f"u{i}\n{draw.choice(['', 'x'])}", traffic_type=draw.choice(['a "b"', "c\r\nd", "e"])) for i in range(300)]
    write(path, [[row[c] for c in ATTEMPT_COLUMNS] for row in rows], ATTEMPT_COLUMNS)
    found = sorted(map(str, read_attempts_csv_parts(spark, path).collect()))
    assert len(found) == 300 and found == sorted(map(str, read_attempts_csv(spark, path, multi_line=True).collect()))
