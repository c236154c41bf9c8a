"""Names of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """A name that none of ``taken`` has, whatever their case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
