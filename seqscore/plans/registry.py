"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from seqscore.plans.oracle import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
SMALL = re.compile(r"p_|.*_p$|p$|.*_adj$|e_?val", re.IGNORECASE)

_FLOAT_COLS_PATH = os.path.join(os.path.dirname(__file__), "float_columns.json")
FLOAT_COLUMNS: dict[str, list[str]] = json.load(open(_FLOAT_COLS_PATH)) if os.path.exists(_FLOAT_COLS_PATH) else {}


def _round_sql(name: str, body: str, digits: int | None) -> str:
    """Round the oracle's floating columns the way ``rounded`` rounds the Spark ones."""
    cols = FLOAT_COLUMNS.get(name)
    if not cols or digits is None:
        return body
    rep = ", ".join(f'round("{c}", {digits}) as "{c}"' for c in cols)
    return f"select * replace ({rep}) from (\n{body.strip()}\n) _q"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so both engines compare equal after summation-order noise.
    p- and E-values keep all digits: their small values are what matters."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)) and not SMALL.match(f.name):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, ctes: str = "", round_digits: int | None = DIGITS):
    """Register a query builder; ``sql`` is the oracle body run after the fixture CTEs."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return rounded(df, round_digits) if round_digits is not None else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_fixtures(_round_sql(name, sql, round_digits), ctes)
        return run
    return deco
