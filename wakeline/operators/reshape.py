"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """Wide form with the values given, so the data is read once."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.first(value, True))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Long form, nulls kept (R2)."""
    return df.unpivot(list(keys), [F.col(f"`{c}`") for c in columns], name, value)


def magnitudes_long(df: DataFrame, keys: Sequence[str], magnitudes: Sequence[str]) -> DataFrame:
    """`{magnitude}_{confidence}` columns to rows of confidence and magnitudes."""
    columns = [c for c in df.columns if c.rpartition("_")[0] in magnitudes]
    long = unpivot(df, keys, columns)
    long = long.withColumns({"magnitude": F.regexp_extract("name", "^(.*)_", 1), "confidence": F.regexp_extract("name", "_([^_]*)$", 1).cast("double")})
    return pivot(long, [*keys, "confidence"], "magnitude", magnitudes, "value")


def expand(df: DataFrame, keys: Sequence[str], column: str, step: str = "time_step") -> DataFrame:
    """A row for every element of an array column."""
    return df.select(*keys, F.posexplode(column).alias(step, column))


def full_index(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All combinations of the keys' distinct values, which are few, with nulls where a row was missing."""
    grid = df.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.join(F.broadcast(df.agg(F.collect_set(k).alias("_v")))).withColumn(k, F.explode("_v")).drop("_v")
    return grid.join(df, list(keys), "left")


def merge(*bundles: DataFrame) -> DataFrame:
    """Result bundles under each other, columns that one lacks null."""
    out = bundles[0]
    for b in bundles[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def group_sum(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Sum of a group of columns, nulls as zero."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn(out, total)


def past_future_difference(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """encoder_future_diff_x and its absolute value."""
    out = df
    for name, (past, future) in pairs.items():
        d = F.col(past) - F.col(future)
        out = out.withColumns({f"encoder_future_diff_{name}": d, f"encoder_future_diff_abs_{name}": F.abs(d)})
    return out
