"""Compares a query with its SQL twin in DuckDB: columns, then rows without order."""

from pathlib import Path

import duckdb


def _value(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.9g}"
    return x if x is None else str(x)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_value(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=str)


def check(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, wanted = query(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(wanted.column_names)
    assert rows(got) == rows(wanted)
