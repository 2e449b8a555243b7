"""Names of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores before it as it takes to differ from all of ``taken``."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The top-level column of just this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
