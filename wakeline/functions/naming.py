"""Names and labels of features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_parts(name: Column) -> Column:
    """Struct of period (future, encoder_future_diff, encoder_future_diff_abs or empty), base name, statistic and the pair of a correlation."""
    period = F.regexp_extract(name, r"^(encoder_future_diff_abs|encoder_future_diff|future)_", 1)
    rest = F.regexp_replace(name, r"^(encoder_future_diff_abs|encoder_future_diff|future)_", "")
    stat = F.regexp_extract(rest, r"_(loc|scale)$", 1)
    base = F.regexp_replace(rest, r"_(loc|scale)$", "")
    pair = F.regexp_extract(base, r"^([^_]+)_(.+)-(.+)$", 2), F.regexp_extract(base, r"^([^_]+)_(.+)-(.+)$", 3)
    return F.struct(period.alias("period"), base.alias("base"), stat.alias("statistic"), pair[0].alias("first"), pair[1].alias("second"))


def plain_markup(label: Column) -> Column:
    """Sub- and superscript tags as underscore and caret."""
    return F.regexp_replace(F.regexp_replace(label, "<sub>(.*?)</sub>", "_{$1}"), "<sup>(.*?)</sup>", "^{$1}")


def with_interval(value: Column, lo: Column, hi: Column, digits: int = 2) -> Column:
    """'value ([lo, hi])' (X3)."""
    return F.format_string(f"%.{digits}f ([%.{digits}f, %.{digits}f])", value, lo, hi)


def without_unit(label: Column) -> Column:
    """A label without its trailing unit in brackets."""
    return F.regexp_replace(label, r"\s*[\[(][^\])]*[\])]\s*$", "")


def file_token(path: Column, token: int = 3) -> Column:
    """A token of a file's name, underscores between, without its extension."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.get(F.split(name, "_"), F.lit(token - 1))


def all_strings(df: DataFrame) -> DataFrame:
    """Every column as a string."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def has_columns(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def columns_like(df: DataFrame, part: str, prefix: bool = False) -> list[str]:
    """Columns whose name starts with or contains a text."""
    return [c for c in df.columns if (c.startswith(part) if prefix else part in c)]


def bin_label(lo: Column, hi: Column) -> Column:
    return F.format_string("p%d - p%d", lo, hi)


def chunk_label(ident: Column, chunk: Column) -> Column:
    return F.concat_ws("__", ident, chunk)


def with_future(categoricals: Sequence[str], future: Sequence[str], groups: Mapping[str, Sequence[str]]) -> list[str]:
    """Flat names of categorical features and of the future ones, a group's name standing for its members."""
    return [*categoricals, *(c for f in future for c in groups.get(f, [f]))]


def levels_with_future(levels: Mapping[str, Sequence], future: Sequence[str]) -> dict[str, Sequence]:
    """Levels of each categorical feature; a future one has those of the feature it is the future of."""
    return {**levels, **{f: levels[f.replace("future_", "")] for f in future}}


def may_be_missing(levels: Mapping[str, Sequence]) -> list[str]:
    """Categorical features that have a level for missing values."""
    return [c for c, own in levels.items() if None in own]
