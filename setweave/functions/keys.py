"""Deterministic pseudo-random keys: md5 of "seed:key", so that any engine can repeat them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str | Column, *keys: Column) -> Column:
    """A whole number from 0 to 2^32 - 1. A seed that is a column differs by row."""
    text = F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number of [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)


def draw_sql(seed: int | str, *keys: str) -> str:
    """draw() in DuckDB's SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def uniform_sql(seed: int | str, *keys: str) -> str:
    return f"({draw_sql(seed, *keys)} / CAST(4294967296.0 AS DOUBLE))"
