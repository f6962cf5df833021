"""Role resolution: which columns hold the text, the level and the time.

Pure schema inspection on the driver - no Spark job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate names of the time column, tried in this order.
TIMESTAMP_NAMES = [
    "timestamp",
    "date",
    "created_at",
    "created",
    "time",
    "datetime",
    "date_time",
    "submitted_at",
    "received_at",
    "feedback_date",
    "entry_date",
]


@dataclass(frozen=True)
class Roles:
    text: str | None
    level: str | None
    timestamp: str | None

    def require(self, *names: str) -> "Roles":
        for n in names:
            if getattr(self, n) is None:
                raise ValueError(f"no {n} column found")
        return self


def _best(columns: list[str], names: list[str]) -> str | None:
    """The column that fits ``names`` best: an exact spelling beats another case; among exact
    ones the earlier name wins, among the others the earlier column."""
    rank = {name: i for i, name in enumerate(names)}
    fits = [((c not in rank, rank.get(c, place)), c) for place, c in enumerate(columns) if c.lower() in rank]
    return min(fits)[1] if fits else None


def resolve_roles(df: DataFrame, text: str | None = None, level: str | None = None, timestamp: str | None = None) -> Roles:
    """Roles by name; explicit arguments win.  ``ts`` is the last choice for the time."""
    cols = df.columns
    return Roles(
        text=text or _best(cols, ["text"]),
        level=level or _best(cols, ["level"]),
        timestamp=timestamp or _best(cols, TIMESTAMP_NAMES) or _best([c for c in cols if c == "ts"], ["ts"]),
    )


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(df: DataFrame, name: str) -> str:
    """Case-insensitive column lookup; ``ValueError`` naming the column when absent."""
    found = _best(df.columns, [name]) or _best(df.columns, [name.lower()])
    if found is None:
        raise ValueError(f"the table has no column {name!r}, only {', '.join(df.columns)}")
    return found


def canonical(df: DataFrame, roles: Roles | None = None, keep_others: bool = True) -> DataFrame:
    """Project to canonical aliases ``text``, ``level``, ``ts`` followed by the other columns."""
    r = roles or resolve_roles(df)
    out = []
    used = set()
    for alias, src in (("text", r.text), ("level", r.level), ("ts", r.timestamp)):
        if src is not None:
            out.append(quoted(src).alias(alias))
            used.add(src)
    if keep_others:
        out += [quoted(c) for c in df.columns if c not in used and c.lower() not in {"text", "level", "ts"}]
    return df.select(*out)


def project(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Select columns by case-insensitive name, in the requested order; None = all."""
    if not names:
        return df
    return df.select(*[quoted(find_column(df, n)) for n in names])
