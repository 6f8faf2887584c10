"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracles import compare  # noqa: E402

from rollcall.plans.catalogue import ORACLES, QUERIES  # noqa: E402

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for path in sorted(Path(small).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    verdict = compare(spark, con, small, name)
    assert verdict.startswith("ok"), verdict


def test_contract(spark, small):
    assert set(ORACLES) == set(QUERIES)
    assert set(contract.queries()) >= set(QUERIES)
    assert set(contract.oracle_sql()) >= set(QUERIES)
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("module", ["xxhash", "rollcall.llm.common", "rollcall.llm.queries"])
def test_entry_without_a_library_of_the_training_data_part(module):
    """Whatever the training-data part cannot import, the other queries stay."""
    code = (
        f"import sys, warnings; sys.modules[{module!r}] = None; warnings.simplefilter('ignore')\n"
        "import __spark_entry__ as e; from rollcall.plans.catalogue import QUERIES\n"
        "assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(QUERIES)"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
