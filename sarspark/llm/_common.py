"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import Written, shared_dir

__all__ = ["Written", "shared_dir", "spare", "text_of"]


def text_of(name: str = "text") -> Column:
    """A text column, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spare(taken: list[str], name: str) -> str:
    """``name``, or a variant of it that no column in ``taken`` has (case is ignored)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
