"""Report sinks: filtered rows and category reports as UTF-8 CSV with a header."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame

from feedlake.operators.categories import with_summary_row


def _slug(value) -> str:
    """Letters and digits of any script, runs of anything else as one hyphen."""
    return re.sub(r"[\W_]+", "-", str(value)).strip("-").lower()


def report_name(criteria: dict, today: _dt.date | None = None, kind: str = "rows") -> str:
    """``<kind>.<yyyymmdd>[.<column>=<value>+<value>]*.csv``, columns in alphabetical order, so
    equal criteria give equal names."""
    day = (today or _dt.date.today()).strftime("%Y%m%d")
    parts = []
    for column in sorted(criteria, key=str.lower):
        value = criteria[column]
        values = value if isinstance(value, (list, tuple, set)) else [value]
        parts.append(f"{_slug(column)}={'+'.join(sorted(map(_slug, values)))}")
    return ".".join([kind, day, *parts, "csv"])


def ensure_csv_suffix(name: str) -> str:
    return name if name.endswith(".csv") else name + ".csv"


def write_report(df: DataFrame, path: str, single_file: bool = False) -> bool:
    """Write ``df`` as CSV (header, UTF-8) into folder ``path``; nothing is written for an
    empty result.  Returns whether anything was written.  Cells keep their white space; an empty
    cell and the null spellings of the CSV source read back as null.

    Files are written in parallel, one per partition; ``single_file`` coalesces to one task
    first and is meant for small reports only."""
    if df.isEmpty():
        return False
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return True


def write_category_report(tagged: DataFrame, path: str, single_file: bool = False) -> bool:
    """Category report: all columns as text plus the summary row of category sums; nothing is
    written when no row is tagged, since sums alone say nothing."""
    return not tagged.isEmpty() and write_report(with_summary_row(tagged), path, single_file)
