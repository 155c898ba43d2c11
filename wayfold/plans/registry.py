"""Registers queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def sql_filled(src: str, key: str, order: str, v: str) -> str:
    """src plus f: v with inner gaps on a straight line over row numbers."""
    return f"""SELECT *, CASE WHEN {v} IS NOT NULL THEN {v} ELSE _y0 + (_y1 - _y0) * ((_i - _i0) / nullif(CAST(_i1 - _i0 AS DOUBLE), 0)) END AS f FROM (
 SELECT *, last_value({v} IGNORE NULLS) OVER b AS _y0, first_value({v} IGNORE NULLS) OVER a AS _y1, max(CASE WHEN {v} IS NOT NULL THEN _i END) OVER b AS _i0, min(CASE WHEN {v} IS NOT NULL THEN _i END) OVER a AS _i1
 FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _i FROM {src})
 WINDOW b AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def sql_ma(src: str, key: str, order: str, v: str, n: int, out: str) -> str:
    return f"""SELECT * EXCLUDE (f, _i, _y0, _y1, _i0, _i1), CASE WHEN count(f) OVER w = {n} THEN avg(f) OVER w END AS {out} FROM ({sql_filled(src, key, order, v)})
 WINDOW w AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {(n - 1) // 2} PRECEDING AND {n // 2} FOLLOWING)"""


def sql_linear(x: str, lo: str | float, hi: str | float, rising: bool = True) -> str:
    share = f"CASE WHEN {x} < {lo} THEN 0.0::DOUBLE WHEN {x} > {hi} THEN 1.0::DOUBLE WHEN {x} IS NOT NULL THEN coalesce(({x} - {lo}) / nullif(CAST({hi} - {lo} AS DOUBLE), 0), 0) END"
    return f"round({share if rising else f'1.0::DOUBLE - ({share})'}, 3)"


def sql_steps(x: str, at: tuple[float, ...], rising: bool = True) -> str:
    k = len(at)
    level = [i / k if rising else 1 - i / k for i in range(k + 1)]
    out = "".join(f" WHEN {x} < {at[i]} THEN {level[i]}::DOUBLE" for i in range(k)) + f" WHEN {x} >= {at[-1]} THEN {level[-1]}::DOUBLE"
    return f"round(coalesce(CASE{out} END, 0), 3)"


def sql_window(src: str, h: int, agg: str, v: str = "v") -> str:
    """agg over (dx, dy, v) of the window of half-width h at each cell of src."""
    return f"""SELECT cx, cy, {agg} AS v FROM (SELECT cx - dx AS cx, cy - dy AS cy, dx, dy, {v} AS v FROM {src},
 (SELECT CAST(a AS INT) AS dx, CAST(b AS INT) AS dy FROM range(-{h}, {h + 1}) t(a), range(-{h}, {h + 1}) u(b))) GROUP BY cx, cy HAVING bool_or(dx = 0 AND dy = 0)"""


def at(dx: int, dy: int) -> str:
    return f"sum(v) FILTER (WHERE dx = {dx} AND dy = {dy})"
