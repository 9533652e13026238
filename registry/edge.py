"""Plain result types at the edge, the same on both sides of a check.

Dates become ISO text, booleans 0/1, decimals and doubles are rounded, sums are
64-bit. The oracle text is wrapped by asking DuckDB for its column types over
empty tables, so no type list is kept by hand.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, DoubleType, FloatType, TimestampNTZType, TimestampType,
)

DIGITS = 6

TABLES = {
    "region": "r_regionkey integer, r_name varchar",
    "nation": "n_nationkey integer, n_name varchar, n_regionkey integer",
    "customer": "c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double, c_mktsegment varchar",
    "supplier": "s_suppkey bigint, s_name varchar, s_nationkey integer, s_acctbal double",
    "part": "p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size integer, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority varchar",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, "
                "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar",
    "pages": "page_id bigint, url varchar, html varchar",
}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, BooleanType):
            c = c.cast("int")
        elif isinstance(t, (DecimalType, DoubleType, FloatType)):
            c = F.round(c.cast("double"), DIGITS)
        out.append(c.alias(f.name))
    return df.select(*out)


@functools.cache
def _connection():
    import duckdb

    con = duckdb.connect()
    for name, columns in TABLES.items():
        con.execute(f"create table {name} ({columns})")
    return con


def plain_sql(body: str) -> str:
    columns = _connection().execute(f"describe {body}").fetchall()
    out = []
    for name, kind, *_ in columns:
        c = f'"{name}"'
        if kind == "DATE":
            c = f"strftime({c}, '%Y-%m-%d')"
        elif kind.startswith("TIMESTAMP"):
            c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "BOOLEAN":
            c = f"cast({c} as integer)"
        elif kind == "HUGEINT":
            c = f"cast({c} as bigint)"
        elif kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
            c = f"round(cast({c} as double), {DIGITS})"
        out.append(f'{c} as "{name}"')
    return f"select {', '.join(out)} from ({body}) plain"
