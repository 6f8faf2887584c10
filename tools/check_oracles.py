"""Compare registered queries with their SQL on one directory of tables.

    python tools/check_oracles.py [directory] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from rollcall.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from rollcall.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


def normal(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, directory: str, name: str) -> str:
    df = QUERIES[name](spark, directory)
    ours = normal(df.columns, [tuple(row) for row in df.collect()])
    if name not in ORACLES:
        return f"rows only ({len(ours)})"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = normal(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    if ours != theirs:
        only = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
        return f"ROWS {len(ours)} vs {len(theirs)}: {only}"
    return f"ok ({len(ours)})"


def main() -> int:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for path in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, directory, name)
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:400]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:40s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
