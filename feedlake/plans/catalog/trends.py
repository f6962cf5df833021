"""Trend, level-trend, change and period-comparison queries over ``rated_orders``."""

from __future__ import annotations

from feedlake.operators import trends as T
from feedlake.plans.catalog.views import RATED_ORDERS
from feedlake.plans.registry import register
from feedlake.sources.tables import rated_orders

_LABEL_SQL = {
    "day": "strftime(ps, '%Y-%m-%d')",
    "week": "strftime(ps, '%Y-%m-%d') || '/' || strftime(ps + interval 6 day, '%Y-%m-%d')",
    "month": "strftime(ps, '%Y-%m')",
    "quarter": "cast(year(ps) as varchar) || 'Q' || cast(quarter(ps) as varchar)",
    "year": "cast(year(ps) as varchar)",
}


def _trend_sql(unit: str) -> str:
    return f"""
select ps as period_start, {_LABEL_SQL[unit]} as period, n, avg_level, min_level, max_level
from (select cast(date_trunc('{unit}', ts) as date) as ps, count(*) as n,
             avg(cast(level as double)) as avg_level, min(level) as min_level, max(level) as max_level
      from {RATED_ORDERS} o where ts is not null group by 1) t
"""


def _make_trend(unit: str):
    def q(spark, sf_dir):
        return T.trend(rated_orders(spark, sf_dir), unit)

    return q


for _unit in ("day", "week", "month", "quarter", "year"):
    register(f"trend_{_unit}", _trend_sql(_unit), "C6 E9 F7")(_make_trend(_unit))


@register(
    "level_trend_long",
    f"""
select ps as period_start, strftime(ps, '%Y-%m') as period, level, n
from (select cast(date_trunc('month', ts) as date) as ps, level, count(*) as n
      from {RATED_ORDERS} o where ts is not null and level is not null group by 1, 2) t
""",
    "E10",
)
def level_trend_long(spark, sf_dir):
    return T.level_trend_long(rated_orders(spark, sf_dir), "month")


@register(
    "level_trend_pivot",
    f"""
select ps as period_start, cast(year(ps) as varchar) || 'Q' || cast(quarter(ps) as varchar) as period,
       count(*) filter (where level = 1) as level_1, count(*) filter (where level = 2) as level_2,
       count(*) filter (where level = 3) as level_3, count(*) filter (where level = 4) as level_4,
       count(*) filter (where level = 5) as level_5, count(*) filter (where level not in (1, 2, 3, 4, 5)) as other_levels
from (select cast(date_trunc('quarter', ts) as date) as ps, level
      from {RATED_ORDERS} o where ts is not null and level is not null) t
group by ps
""",
    "E10",
)
def level_trend_pivot(spark, sf_dir):
    return T.level_trend_pivot(rated_orders(spark, sf_dir), [1, 2, 3, 4, 5], "quarter")


@register(
    "level_trend_pivot_some",
    f"""
select ps as period_start, cast(year(ps) as varchar) as period,
       count(*) filter (where level = 1) as level_1, count(*) filter (where level = 2) as level_2,
       count(*) filter (where level not in (1, 2)) as other_levels
from (select cast(date_trunc('year', ts) as date) as ps, level
      from {RATED_ORDERS} o where ts is not null and level is not null) t
group by ps
""",
    "E10",
)
def level_trend_pivot_some(spark, sf_dir):
    return T.level_trend_pivot(rated_orders(spark, sf_dir), [1, 2], "year")


_CHANGES_SQL = f"""
with t as (select cast(date_trunc('month', ts) as date) as period_start, count(*) as n,
                  avg(cast(level as double)) as avg_level
           from {RATED_ORDERS} o where ts is not null group by 1),
c as (select period_start, strftime(period_start, '%Y-%m') as period, n, avg_level,
             lag(strftime(period_start, '%Y-%m')) over (order by period_start) as previous_period,
             lag(avg_level) over (order by period_start) as previous_avg_level
      from t)
select period_start, period, n, avg_level, previous_period, previous_avg_level,
       avg_level - previous_avg_level as change,
       case when avg_level - previous_avg_level > 0 then 'Improvement'
            when avg_level - previous_avg_level < 0 then 'Decline' else 'Stable' end as direction
from c
"""


@register("all_changes", _CHANGES_SQL, "F3 C7")
def all_changes(spark, sf_dir):
    tr = T.trend(rated_orders(spark, sf_dir), "month").select("period_start", "period", "n", "avg_level")
    return T.period_changes(tr)


@register(
    "latest_change",
    f"select * from ({_CHANGES_SQL}) x where previous_period is not null order by period_start desc limit 1",
    "F3 C7",
)
def latest_change(spark, sf_dir):
    tr = T.trend(rated_orders(spark, sf_dir), "month").select("period_start", "period", "n", "avg_level")
    return T.latest_change(tr)


# the two compared periods overlap in 1997-06
P1 = ("1996-01-01", "1997-06-30")
P2 = ("1997-06-01", "1998-12-31")


def _in(p):
    return f"(ts >= timestamp '{p[0]}' and ts <= timestamp '{p[1]}')"


@register(
    "compare_periods",
    f"""
select n_p1, n_p2, avg_level_p1, avg_level_p2, n_p2 - n_p1 as volume_change,
       case when n_p1 > 0 then cast(n_p2 - n_p1 as double) / n_p1 * 100 else 0.0 end as volume_change_pct,
       avg_level_p2 - avg_level_p1 as level_change,
       case when avg_level_p2 - avg_level_p1 > 0 then 'Improvement'
            when avg_level_p2 - avg_level_p1 < 0 then 'Decline' else 'Stable' end as direction
from (select count(*) filter (where {_in(P1)}) as n_p1, count(*) filter (where {_in(P2)}) as n_p2,
             avg(case when {_in(P1)} then cast(level as double) end) as avg_level_p1,
             avg(case when {_in(P2)} then cast(level as double) end) as avg_level_p2
      from {RATED_ORDERS} o where {_in(P1)} or {_in(P2)}) a
""",
    "E11 C7",
)
def compare_periods(spark, sf_dir):
    return T.compare_periods(rated_orders(spark, sf_dir), P1, P2)


@register(
    "compare_level_share",
    f"""
with tagged as (select 'p1' as period, level from {RATED_ORDERS} o where {_in(P1)}
                union all
                select 'p2' as period, level from {RATED_ORDERS} o where {_in(P2)}),
c as (select period, level, count(*) as n from tagged group by 1, 2)
select period, level, n, cast(n as double) / sum(n) over (partition by period) * 100 as pct
from c qualify level is not null
""",
    "E11",
)
def compare_level_share(spark, sf_dir):
    return T.compare_level_share(rated_orders(spark, sf_dir), P1, P2)
