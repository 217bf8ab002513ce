"""Finding a column under any of its historical spellings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_name(name: str) -> str:
    """Spelling-independent key: lower case, letters a-z and digits only."""
    return re.sub(r"[^0-9a-z]", "", name.casefold())


def quoted(name: str) -> Column:
    return F.col(quoted_sql(name))


def quoted_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def physical_names(columns: Iterable[str], aliases: Sequence[str]) -> list[str]:
    """Physical columns answering to the aliases, in alias order; first physical column wins."""
    by_key: dict[str, str] = {}
    for column in columns:
        by_key.setdefault(fold_name(column), column)
    hits = (by_key.get(fold_name(alias)) for alias in aliases)
    return list(dict.fromkeys(hit for hit in hits if hit is not None))


def typed_sql(
    columns: Sequence[str], aliases: Sequence[str], dtype: str, *, per_row: bool = False
) -> str:
    """SQL for the aliased column cast to ``dtype``, or a typed null when no alias exists.

    Text rather than ``Column`` objects: a canonical projection has some forty of these, and one
    ``selectExpr`` is a single round trip to the JVM.

    ``per_row`` is for frames that hold several families side by side: the first alias that is
    filled in on the row is taken instead of the first that exists in the schema.
    """
    found = [
        f"try_cast({quoted_sql(name)} AS {dtype})" for name in physical_names(columns, aliases)
    ]
    if not found:
        return f"CAST(NULL AS {dtype})"
    return f"coalesce({', '.join(found)})" if per_row and len(found) > 1 else found[0]


def require_column(df: DataFrame, aliases: Sequence[str], purpose: str) -> str:
    hits = physical_names(df.columns, aliases)
    if not hits:
        raise ValueError(f"no column for {purpose}: looked for {list(aliases)} in {df.columns}")
    return hits[0]


def optional_column(df: DataFrame, aliases: Sequence[str]) -> str | None:
    hits = physical_names(df.columns, aliases)
    return hits[0] if hits else None


def present_sql(columns: Sequence[str], names: Sequence[str], default: str, dtype: str) -> str:
    """SQL coalescing those of ``names`` that exist exactly; the default when none exists."""
    found = [f"try_cast({quoted_sql(n)} AS {dtype})" for n in names if n in columns]
    return f"coalesce({', '.join(found)})" if found else f"try_cast({default} AS {dtype})"
