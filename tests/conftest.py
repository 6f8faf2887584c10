from __future__ import annotations

import contextlib
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rollcall.session import local_session  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, "tests", **{"spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse")}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    if not Path(SMALL).is_dir():
        pytest.skip("no tables")
    return SMALL


@pytest.fixture
def settings(spark):
    """Change session settings for one block."""

    @contextlib.contextmanager
    def change(**values):
        changed = {key.replace("__", "."): str(value) for key, value in values.items()}
        old = {key: spark.conf.get(key, None) for key in changed}
        try:
            for key, value in changed.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in old.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return change


def rows(df, *cols):
    """The rows as a sorted list of tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def final_plan(df) -> str:
    """Run a query and return the plan that was really used."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
