"""Compare a query with its SQL on a directory of tables."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import duckdb
from check_oracles import normal


def same(df, sql: str, tables: dict[str, object]) -> None:
    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"create view {name} as select * from '{source}'")
        else:
            con.register(name, source)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = normal(columns, result.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:5] == []
