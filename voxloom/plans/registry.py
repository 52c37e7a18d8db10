"""Derived tables and the register of queries with their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.plans.durable import durable

#: Derived tables; the same text runs in Spark and in an ANSI engine, {name} being a table.
DERIVED = {
    "fx_em": """select cast(l_linenumber - 1 + 7 * floor(l_orderkey / 15000.0) as int) z, cast(l_suppkey % 25 as int) y, cast(l_partkey % 50 as int) x,
        cast(sum(cast(l_quantity as bigint)) * 37 % 256 as int) v, cast(sum(l_partkey * 7 + l_suppkey * 13) % 128 as int) n
        from {lineitem} group by 1, 2, 3""",
    "fx_pt": """select z, y, x, cast(v as double) / cast(255 as double) p, case when v + n - 64 >= 128 then 1 else 0 end t from {fx_em}""",
    "fx_lbl": """select z, y, x, case when v < 40 then cast(0 as bigint)
        else cast(1000 * z + floor((y + z % 2) / 5.0) * 11 + floor((x + z % 3) / 5.0) + 1 as bigint) end label from {fx_em}""",
    "fx_fg": "select z, y, x from {fx_em} where v >= 240",
    "fx_edges": "select o_orderkey src, o_orderkey + 1 + o_custkey % 7 dst from {orders} where o_custkey % 5 = 0",
    "fx_stream": "select ts, user_id src, event_id % 1000 dst from {events} where event_type = 'purchase'",
}
#: A slice's extent: the moduli above. The number of slices grows with the orders.
SLICE = {"y": 25, "x": 50}


class Tables:
    """The tables of a folder, given or derived, by attribute. ``keep``: the volume is derived once, then read from the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark, self.sf_dir, self.keep = spark, sf_dir, keep

    def __getattr__(self, name: str) -> DataFrame:
        if name == "fx_em" and self.keep:
            self.fx_em = durable(self.sql(DERIVED[name]))
            return self.fx_em
        if name in DERIVED:
            return self.sql(DERIVED[name])
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, keep: bool = False):
    """Register ``fn(tables)`` under ``name``, with its oracle in the derived tables' terms. ``keep``: it passes over the volume again and again."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, keep))
        if sql:
            SQL[name] = oracle(sql)
        return fn

    return register


def oracle(sql: str) -> str:
    """``sql`` with the derived tables that it names, and those that they name, put before it."""
    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for n in DERIVED:
            if re.search(rf"\b{n}\b", text):
                if n in need:
                    need.remove(n)
                need.insert(0, n)
                todo.append(DERIVED[n])
    parts = [f"{n} as ({re.sub(r'[{}]', '', DERIVED[n])})" for n in DERIVED if n in need]
    recursive = "recursive " if re.match(r"\s*with recursive\b", sql) else ""
    body = re.sub(r"^\s*with (recursive )?", "", sql) if re.match(r"\s*with\b", sql) else None
    if not parts:
        return sql
    return f"with {recursive}{', '.join(parts)}{', ' + body if body else ' ' + sql}"
