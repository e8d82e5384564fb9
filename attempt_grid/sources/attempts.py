"""Scans that produce contract rows, and per-project routing between them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from attempt_grid.operators.contract import ATTEMPT_COLUMNS, require_columns, to_contract

# Fixed value: the form of a plain table name, one to three identifiers.
_IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
_TABLE_NAME = re.compile(rf"{_IDENTIFIER}(\.{_IDENTIFIER}){{0,2}}")


def validate_table_identifier(name: str) -> str:
    """The name itself when it is one to three plain identifiers joined by dots."""
    if not _TABLE_NAME.fullmatch(name):
        raise ValueError(f"{name!r} is not a plain table name such as catalog.schema.table")
    return name


def read_attempts_csv(
    spark: SparkSession, path: str | PurePath, *, strict: bool = False, multi_line: bool = False
) -> DataFrame:
    """Contract rows from CSV files with a header line, matched by column name.

    Everything is read as text and coerced, so a reordered file stays correct and
    a bad value becomes NULL (see ``contract_rejects``) instead of failing a task.
    ``strict`` looks for bad values first and raises. Files whose headers differ
    from each other are an error. A quote inside quotes is written twice; line breaks
    inside quotes need ``multi_line``, with which a file is no longer read in parts.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    try:
        raw = reader.csv(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(path)) from error
        raise
    return to_contract(raw, strict=strict)


def read_attempts_table(spark: SparkSession, name: str) -> DataFrame:
    """Contract rows from a catalog table or view.

    Columns that already have their contract type stay bare references, so
    filters and column pruning reach the table's files.
    """
    return to_contract(spark.table(validate_table_identifier(name)), trim_text=False)


def read_attempts_sql(spark: SparkSession, query: str) -> DataFrame:
    """Contract rows from the result of a Spark SQL query."""
    return to_contract(spark.sql(query), trim_text=False)


def read_attempts_projected(spark: SparkSession, name: str) -> DataFrame:
    """The 17 columns of a table that is known to be typed already, nothing else."""
    table = spark.table(validate_table_identifier(name))
    require_columns(table)
    return table.select(*ATTEMPT_COLUMNS)


READERS = {
    "csv": read_attempts_csv,
    "table": read_attempts_table,
    "sql": read_attempts_sql,
    "projected": read_attempts_projected,
}


@dataclass(frozen=True, slots=True)
class ProjectSource:
    """How one project's attempts are read: a reader kind and its path, table or query."""

    kind: str
    location: str


def source_registry(
    sources: Mapping[str, tuple[str, str]], default: str | None = None
) -> dict[str, ProjectSource]:
    """Registry of (kind, location) by project; the default project is also the source of ``""``."""
    registry = {project: ProjectSource(*source) for project, source in sources.items()}
    if default is not None:
        registry[""] = attempt_source(registry, default)
    return registry


def attempt_source(registry: Mapping[str, ProjectSource], project: str) -> ProjectSource:
    """The source registered for a project; unknown projects and kinds raise."""
    if project not in registry:
        raise ValueError(f"no source for project {project!r}, only for {sorted(registry)}")
    source = registry[project]
    if source.kind not in READERS:
        raise ValueError(f"no reader for source kind {source.kind!r}, only for {sorted(READERS)}")
    if not source.location.strip():
        raise ValueError(f"the source of project {project!r} has no location")
    return source


def load_attempts(
    spark: SparkSession, registry: Mapping[str, ProjectSource], project: str = ""
) -> DataFrame:
    """Contract rows of one project, by default the registry's default project."""
    source = attempt_source(registry, project)
    return READERS[source.kind](spark, source.location)
