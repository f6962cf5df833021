"""Trends by calendar period and comparison of two periods.

All aggregations group on low-cardinality keys (period, level), so Spark's partial
(map-side) aggregation collapses the data before the shuffle: the exchange carries at most
``#periods x #levels`` rows per input partition, whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.numbers import change, direction, pct
from feedlake.functions.timeparts import canonical_unit, date_bound, period_label, period_start
from feedlake.operators.filters import between_dates  # noqa: F401  (re-exported)


def with_period(df: DataFrame, unit: str = "month", ts: str = "ts") -> DataFrame:
    """Add ``period_start`` (DATE); rows without a time are dropped.  Grouping is on the date;
    its label is formatted once per group (:func:`labelled`), not per row."""
    return df.filter(F.col(ts).isNotNull()).withColumn("period_start", period_start(F.col(ts), canonical_unit(unit)))


def labelled(grouped: DataFrame, unit: str) -> DataFrame:
    """Add the label ``period`` after ``period_start``."""
    rest = [F.col(c) for c in grouped.columns if c != "period_start"]
    return grouped.select("period_start", period_label(F.col("period_start"), canonical_unit(unit)).alias("period"), *rest)


def trend(df: DataFrame, unit: str = "month", ts: str = "ts", level: str | None = "level") -> DataFrame:
    """Per period: entries and mean / min / max level (level stats omitted without a level)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if level is not None:
        aggs += [
            F.avg(F.col(level).cast("double")).alias("avg_level"),
            F.min(level).alias("min_level"),
            F.max(level).alias("max_level"),
        ]
    # one row per period: sorting the result is cheap
    return labelled(with_period(df, unit, ts).groupBy("period_start").agg(*aggs), unit).orderBy("period_start")


def level_trend_long(df: DataFrame, unit: str = "month", ts: str = "ts", level: str = "level") -> DataFrame:
    """(period_start, period, level, n) for every observed period x level; null levels dropped."""
    rated = with_period(df, unit, ts).filter(F.col(level).isNotNull())
    return labelled(rated.groupBy("period_start", F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n")), unit)


def level_trend_pivot(df: DataFrame, levels: list[int], unit: str = "month", ts: str = "ts", level: str = "level") -> DataFrame:
    """One row per period with a 0-filled count column ``level_<v>`` per given level.

    The level values are a parameter (no extra job to discover them); ``other_levels`` counts
    the rows of all others, so the counts add up.  Periods whose levels are all null do not
    appear."""
    aggs = [F.count_if(F.col(level) == F.lit(v)).alias(f"level_{v}") for v in levels]
    aggs.append(F.count_if(~F.col(level).isin(levels)).alias("other_levels"))
    rated = with_period(df, unit, ts).filter(F.col(level).isNotNull())
    return labelled(rated.groupBy("period_start").agg(*aggs), unit)


def period_changes(trend_df: DataFrame, value: str = "avg_level") -> DataFrame:
    """Every observed period with the previous observed period's value, the change and its
    direction (first period: null previous, Stable).

    The window has no partition key, but it runs on the trend table - one row per period -
    so its size is the number of periods, not of input rows."""
    w = Window.orderBy("period_start")
    prev = F.lag(F.col(value)).over(w)
    prev_period = F.lag(F.col("period")).over(w)
    return trend_df.select(
        "period_start",
        "period",
        "n",
        F.col(value),
        prev_period.alias("previous_period"),
        prev.alias(f"previous_{value}"),
        change(F.col(value), prev).alias("change"),
    ).withColumn("direction", direction(F.col("change")))


def latest_change(trend_df: DataFrame, value: str = "avg_level") -> DataFrame:
    """The last two observed periods compared (not calendar neighbours); empty with < 2."""
    changes = period_changes(trend_df, value)
    last = changes.orderBy(F.col("period_start").desc()).limit(1)
    return last.filter(F.col("previous_period").isNotNull())


def _in_range(ts, start, end):
    lo, hi = date_bound(start), date_bound(end)
    cond = F.col(ts).isNotNull()
    if lo is not None:
        cond = cond & (F.col(ts) >= lo)
    if hi is not None:
        cond = cond & (F.col(ts) <= hi)
    return cond


def compare_periods(df: DataFrame, p1: tuple[str, str], p2: tuple[str, str], ts: str = "ts", level: str | None = "level") -> DataFrame:
    """One row: entries and mean level of two (possibly overlapping) periods, the volume change
    (absolute and % of period 1), the mean change and its direction.  One pass of
    conditional aggregates; the ranges are pushed to the scan as an OR of the two."""
    in1, in2 = _in_range(ts, *p1), _in_range(ts, *p2)
    aggs = [F.count_if(in1).alias("n_p1"), F.count_if(in2).alias("n_p2")]
    if level is not None:
        lv = F.col(level).cast("double")
        aggs += [F.avg(F.when(in1, lv)).alias("avg_level_p1"), F.avg(F.when(in2, lv)).alias("avg_level_p2")]
    agg = df.filter(in1 | in2).agg(*aggs)
    out = agg.withColumn("volume_change", F.col("n_p2") - F.col("n_p1")).withColumn(
        "volume_change_pct", pct(F.col("n_p2") - F.col("n_p1"), F.col("n_p1"))
    )
    if level is not None:
        out = out.withColumn("level_change", change("avg_level_p2", "avg_level_p1")).withColumn(
            "direction", direction(F.col("level_change"))
        )
    return out


def compare_level_share(df: DataFrame, p1: tuple[str, str], p2: tuple[str, str], ts: str = "ts", level: str = "level") -> DataFrame:
    """(period, level, n, pct): level counts inside each period, % of all the period's rows
    (rows with a null level count in the total but get no row of their own)."""
    in1, in2 = _in_range(ts, *p1), _in_range(ts, *p2)
    tagged = df.filter(in1 | in2).select(
        F.explode(F.array_compact(F.array(F.when(in1, F.lit("p1")), F.when(in2, F.lit("p2"))))).alias("period"),
        F.col(level).alias("level"),
    )
    counts = tagged.groupBy("period", "level").agg(F.count(F.lit(1)).alias("n"))
    # window over the aggregated counts only (#periods x #levels rows)
    total = F.sum("n").over(Window.partitionBy("period"))
    return counts.withColumn("pct", pct(F.col("n"), total)).filter(F.col("level").isNotNull())


def period_samples(df: DataFrame, start: str, end: str, n: int = 10, ts: str = "ts", order: str = "row_id") -> DataFrame:
    """First ``n`` rows of a period in table order."""
    return df.filter(_in_range(ts, start, end)).orderBy(order).limit(n)
