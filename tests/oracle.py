"""Runs registered queries beside their SQL and compares whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool):
        return int(value)
    return value if isinstance(value, (int, str)) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = _rows([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first extra {sorted(set(got) - set(want), key=repr)[:2]} / {sorted(set(want) - set(got), key=repr)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_cols}: got {g} want {w}"
        if [type(x) for x in g] != [type(x) for x in w]:
            return f"{got_cols}: types of {g} and {w}"
    return None if got else "no rows on either side"
