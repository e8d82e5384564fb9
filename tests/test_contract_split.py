import pytest
from grid_rows import attempt
from pyspark.sql import functions as F

from attempt_grid import ATTEMPT_COLUMNS, ContractError, contract_rejects, read_accepted, read_rejected, to_contract, write_checked
from attempt_grid.operators.contract import ATTEMPT_SCHEMA


def untidy(spark, *changes):
    """Attempts as text, one row for each change of a good one, with a surplus column."""
    good = {k: str(v) for k, v in attempt().items()}
    rows = [tuple({**good, **change}[c] for c in ATTEMPT_COLUMNS) + ("x",) for change in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*ATTEMPT_COLUMNS, "surplus")))


CHANGES = [
    {}, {"user_id": " u2 "}, {"user_id": "  "}, {"attempt": "3.9"}, {"attempt": "many", "super_ball": "perhaps"},
    {"client_time": "2026-13-01"}, {"client_time": "  2026-01-02 03:04:05\t"}, {"partition_date": None}, {"super_ball": "YES"},
]


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_accepted_and_rejected_side_by_side(spark, tmp_path):
    frame, path = untidy(spark, *CHANGES), str(tmp_path / "checked")
    counts = write_checked(frame, path)
    assert (counts.accepted, counts.rejected) == (5, 4)
    assert counts.reasons == {
        "user_id is empty": 1, "attempt is not a number": 1, "super_ball is not a boolean": 1,
        "client_time is not a timestamp": 1, "partition_date is not a date": 1,
    }
    accepted, rejected = read_accepted(spark, path), read_rejected(spark, path)
    assert accepted.schema == ATTEMPT_SCHEMA
    whole = to_contract(frame)
    assert rows_of(accepted) == rows_of(whole.dropna())
    assert rows_of(rejected) == rows_of(contract_rejects(frame))


def test_the_input_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = untidy(spark, *CHANGES)
    write_checked(frame.mapInArrow(run, frame.schema), str(tmp_path / "checked"))
    assert read.value == len(CHANGES)


def test_each_part_opens_its_own_files(spark, tmp_path):
    path = str(tmp_path / "checked")
    write_checked(untidy(spark, *CHANGES), path)
    verdicts = lambda f: {n.split("verdict=")[1].split("/")[0] for (n,) in f.select(F.input_file_name()).collect()}
    assert verdicts(read_accepted(spark, path)) == {"accepted"}
    assert verdicts(read_rejected(spark, path)) == {"rejected"}


def test_strict_raises_and_keeps_what_was_written(spark, tmp_path):
    path = str(tmp_path / "checked")
    with pytest.raises(ContractError, match=r"1 rows rejected: user_id is empty \(1\)"):
        write_checked(untidy(spark, *CHANGES[:3]), path, strict=True)
    assert read_accepted(spark, path).count() == 2
    assert write_checked(untidy(spark, *CHANGES[:2]), path, strict=True).rejected == 0
    assert read_rejected(spark, path).count() == 0


def test_nothing_to_check(spark, tmp_path):
    counts = write_checked(untidy(spark, {}).limit(0), str(tmp_path / "checked"))
    assert (counts.accepted, counts.rejected, counts.reasons) == (0, 0, {})
    with pytest.raises(ContractError):
        write_checked(untidy(spark, {}).drop("attempt"), str(tmp_path / "other"))
