"""Queries that one SQL text states for both engines."""

from __future__ import annotations

import importlib
import re

from ..functions.expressions import render
from . import scaled_queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_MODULES = ("geometry_queries", "text_queries", "relational_queries", "planning_queries")
_TABLE = re.compile(r"(\bFROM\s+|\bJOIN\s+)(" + "|".join(TABLES) + r")\b")


def texts() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in _MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").SQL
    return out


def _runner(text: str):
    sql = render(text, "spark")
    used = sorted({m[2] for m in _TABLE.finditer(sql)})
    sql = _TABLE.sub(r"\1{\2}", sql.replace("{", "{{").replace("}", "}}"))

    def run(spark, sf_dir, **given):
        return spark.sql(sql, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run


def queries():
    return {k: _runner(scaled_queries.SQL.get(k, v)) for k, v in texts().items()}


def oracle_sql():
    return {k: render(v, "duckdb") for k, v in texts().items()}
