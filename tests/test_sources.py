from datetime import date, datetime

import pytest
from grid_rows import attempt, plan

from attempt_grid import (
    ATTEMPT_COLUMNS,
    ProjectSource,
    source_registry,
    contract_rejects,
    load_attempts,
    read_attempts_csv,
    read_attempts_projected,
    read_attempts_sql,
    read_attempts_table,
)
from attempt_grid.plans.grid_request import project_options, project_statistics
from attempt_grid.sources.attempts import attempt_source, validate_table_identifier


def write_csv(path, columns, *rows):
    lines = [",".join(columns)] + [",".join(str(row[c]) for c in columns) for row in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_is_matched_by_name_and_typed(spark, tmp_path):
    columns = [*reversed(ATTEMPT_COLUMNS), "extra"]
    path = write_csv(
        tmp_path / "a.csv",
        columns,
        attempt(extra="x", traffic_type="NULL", super_ball="True", balance_id="7.0"),
    )
    frame = read_attempts_csv(spark, path)
    assert frame.columns == list(ATTEMPT_COLUMNS)
    row = frame.first()
    assert row["client_time"] == datetime(2026, 1, 1, 12)
    assert row["partition_date"] == date(2026, 1, 1)
    assert (row["traffic_type"], row["super_ball"], row["balance_id"]) == ("NULL", True, 7)


def test_csv_empty_text_is_a_violation(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ATTEMPT_COLUMNS, attempt(payer_type=""), attempt())
    rejects = contract_rejects(spark.read.option("header", True).csv(path))
    assert [r["reject_reasons"] for r in rejects.collect()] == [["payer_type is empty"]]
    assert read_attempts_csv(spark, path).count() == 2
    with pytest.raises(ValueError, match="payer_type is empty"):
        read_attempts_csv(spark, path, strict=True)


def test_csv_folder_with_differing_headers_fails(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ATTEMPT_COLUMNS, attempt())
    write_csv(tmp_path / "b.csv", list(reversed(ATTEMPT_COLUMNS)), attempt())
    with pytest.raises(Exception, match="(?i)header"):
        read_attempts_csv(spark, str(tmp_path)).collect()


def test_csv_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_attempts_csv(spark, tmp_path / "nothing.csv")


def test_csv_missing_columns(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ["user_id"], attempt())
    with pytest.raises(ValueError, match="need the columns"):
        read_attempts_csv(spark, path)


def test_table_sql_and_projected_scans(spark, attempts):
    from pyspark.sql import functions as F

    attempts(attempt(), attempt(failed=1)).withColumn("extra", F.lit(1)).createOrReplaceTempView("src")
    assert read_attempts_table(spark, "src").columns == list(ATTEMPT_COLUMNS)
    assert read_attempts_projected(spark, "src").count() == 2
    assert read_attempts_sql(spark, "select * from src where failed = 1").count() == 1


def test_projected_scan_reads_only_needed_columns(spark, attempts, tmp_path):
    attempts(attempt()).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("stored")
    text = plan(read_attempts_projected(spark, "stored").groupBy("level_cohort").count())
    assert "ReadSchema: struct<level_cohort:int>" in text


@pytest.mark.parametrize("name", ["t", "db.t", "cat.db.t", "_a.B_1"])
def test_legal_identifiers(name):
    assert validate_table_identifier(name) == name


@pytest.mark.parametrize("name", ["", "a.b.c.d", "1a", "a b", "a;drop", "a.", ".a", "a-b", "a\n"])
def test_illegal_identifiers(name):
    with pytest.raises(ValueError, match="not a plain table name"):
        validate_table_identifier(name)


def test_routing(spark, attempts):
    attempts(attempt()).createOrReplaceTempView("first_project")
    attempts(attempt(level_cohort=3), attempt(level_cohort=5)).createOrReplaceTempView("second_project")
    registry = {
        "one": ProjectSource("table", "first_project"),
        "two": ProjectSource("sql", "select * from second_project"),
        "odd": ProjectSource("carrier pigeon", "coop"),
        "blank": ProjectSource("table", " "),
    }
    assert load_attempts(spark, registry, "one").count() == 1
    assert load_attempts(spark, registry, "two").count() == 2
    assert project_options(spark, registry, "two").levels.last == 5
    cells = project_statistics(spark, registry, "two").collect()
    assert [c["level_group"] for c in cells] == [3, 5]
    with pytest.raises(ValueError, match="no source for project"):
        attempt_source(registry, "three")
    with pytest.raises(ValueError, match="no reader for source kind"):
        attempt_source(registry, "odd")
    with pytest.raises(ValueError, match="has no location"):
        attempt_source(registry, "blank")


def test_default_project(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(ATTEMPT_COLUMNS) + "\n")
    registry = source_registry({"one": ("csv", str(tmp_path / "a.csv"))}, default="one")
    assert load_attempts(spark, registry).columns == list(ATTEMPT_COLUMNS)
    with pytest.raises(ValueError):
        source_registry({"one": ("csv", "x")}, default="two")
    with pytest.raises(ValueError):
        load_attempts(spark, source_registry({"one": ("csv", "x")}))


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    row = {**{c: "" for c in ATTEMPT_COLUMNS}, "user_id": '"u ""x"", 1"', "traffic_type": '"two\nlines"', "level_cohort": "7"}
    path = tmp_path / "quoted.csv"
    path.write_text(",".join(ATTEMPT_COLUMNS) + "\n" + ",".join(row[c] for c in ATTEMPT_COLUMNS) + "\n")
    (found,) = read_attempts_csv(spark, path, multi_line=True).collect()
    assert (found.user_id, found.traffic_type, found.level_cohort) == ('u "x", 1', "two\nlines", 7)
