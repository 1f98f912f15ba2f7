from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestra.session import local_session  # noqa: E402


# The unit tests run many small plans once: compiling them takes longer than running them.
FAST = {"spark.ui.showConsoleProgress": "false", "spark.sql.codegen.wholeStage": "false"}


@pytest.fixture(scope="session")
def spark():
    session = local_session("attestra-tests", cores="4", shuffle_partitions=2, **FAST)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """``table("a string, b int", rows)`` -> DataFrame with a constant project in front."""

    def make(schema: str, rows, project="p"):
        ddl = f"project_id string, {schema}"
        return spark.createDataFrame([(project, *(r if isinstance(r, tuple) else (r,))) for r in rows], ddl)

    return make


def rows_of(df, *columns):
    """Rows as a set of tuples of the named columns."""
    return {tuple(r[c] for c in columns) for r in df.collect()}


def list_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def aggregated_scans(df, column):
    """Whether each scan that reads ``column`` has an aggregate before its rows are exchanged."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = []
    for at, line in enumerate(lines):
        if "FileScan" in line and f"{column}#" in line:
            depth, above = len(line) - len(line.lstrip(" :+-")), []
            for upper in reversed(lines[:at]):
                if len(upper) - len(upper.lstrip(" :+-")) < depth:
                    depth = len(upper) - len(upper.lstrip(" :+-"))
                    above.append(upper)
            found.append(any("Aggregate" in node for node in above[:next(i for i, node in enumerate(above) if "Exchange" in node)]))
    return found
