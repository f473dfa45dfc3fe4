"""Registration helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from backline.binding import Views, oracle_text
from backline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed dates: the end of the two binding periods.
DAY = "2024-01-31"
DAY_LONG = "2001-08-01"


def flat(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, so both engines hash alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(out)


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its oracle text."""

    def wrap(fn: Callable[[Views], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return flat(fn(Views(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_text(sql)
        return fn

    return wrap


# --- SQL text for the rounding rules ---------------------------------------------------


def even(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round_even(cast({x} as double), 0)"
    return f"(round_even(cast({x} as double) * 1e{digits}, 0) / 1e{digits})"


def up(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"floor(cast({x} as double) + 0.5)"
    return f"(floor(cast({x} as double) * 1e{digits} + 0.5) / 1e{digits})"


def money(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(24,4))) as double)"


def clamp_sql(x: str, low: float, high: float) -> str:
    return f"greatest({low}::double, least({high}::double, {x}))"


def eq_case(x: str, table: dict, default: str = "null") -> str:
    """CASE over exact keys."""
    arms = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"case {x} {arms} else {default} end"


def in_case(x: str, table: dict, default: str = "null") -> str:
    """CASE over contained keys, first hit wins."""
    arms = " ".join(f"when contains({x}, {lit(k)}) then {lit(v)}" for k, v in table.items())
    return f"case {arms} else {default} end"


def any_in(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v}::double" if isinstance(v, float) else str(v)
