"""Named expressions in stages, so that long formulas build on columns instead of on themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stages = list[dict[str, str]]


def num(x: float) -> str:
    """A DOUBLE literal in either SQL dialect."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def apply(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns({n: F.expr(e) for n, e in stage.items()})
    return df


def sql(source: str, stages: Stages) -> str:
    """A nested SELECT of the same stages over a table or a subquery."""
    for stage in stages:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {source})"
    return source
