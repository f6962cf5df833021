"""Profile queries: level distribution / summary, text and time coverage, column stats."""

from __future__ import annotations

from feedlake.operators import profile as E
from feedlake.plans.catalog.views import FEEDBACK
from feedlake.plans.registry import register
from feedlake.sources.tables import feedback, table


@register("level_distribution", f"select level, count(*) as n from {FEEDBACK} f where level is not null group by 1", "E1 F7")
def level_distribution(spark, sf_dir):
    return E.level_distribution(feedback(spark, sf_dir))


@register(
    "level_summary",
    f"select avg(cast(level as double)) as avg_level, min(level) as min_level, max(level) as max_level from {FEEDBACK} f",
    "E2",
)
def level_summary(spark, sf_dir):
    return E.level_summary(feedback(spark, sf_dir))


@register(
    "text_summary",
    f"select count(text) as n_text, avg(cast(length(text) as double)) as avg_length from {FEEDBACK} f",
    "E3 C10",
)
def text_summary(spark, sf_dir):
    return E.text_summary(feedback(spark, sf_dir))


@register(
    "time_coverage",
    f"""select min(ts) as first_ts, max(ts) as last_ts, count(ts) as n_valid,
       case when count(*) > 0 then cast(count(ts) as double) / count(*) * 100 else 0.0 end as pct_valid
from {FEEDBACK} f""",
    "E4 C5",
)
def time_coverage(spark, sf_dir):
    return E.time_coverage(feedback(spark, sf_dir))


@register(
    "table_shape",
    f"select count(*) as n_rows, 6 as n_columns, 'row_id,text,level,ts,lang,source' as columns from {FEEDBACK} f",
    "E5",
)
def table_shape(spark, sf_dir):
    return E.table_shape(feedback(spark, sf_dir))


def _numeric_sql(col: str, dtype: str) -> str:
    return f"""select '{col}' as column_name, '{dtype}' as dtype, count({col}) as n_non_null,
       cast(count({col}) as double) / count(*) * 100 as pct_non_null,
       cast(min({col}) as double) as min, cast(max({col}) as double) as max,
       avg(cast({col} as double)) as mean, count(distinct cast({col} as double)) as n_distinct
from events"""


@register(
    "profile_numeric",
    " union all ".join(_numeric_sql(c, t) for c, t in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))),
    "E6",
)
def profile_numeric(spark, sf_dir):
    return E.profile_numeric(table(spark, sf_dir, "events"))


def _string_sql(col: str) -> str:
    return f"""select '{col}' as column_name, 'string' as dtype, count({col}) as n_non_null,
       cast(count({col}) as double) / count(*) * 100 as pct_non_null, count(distinct {col}) as n_distinct
from documents"""


@register("profile_strings", " union all ".join(_string_sql(c) for c in ("lang", "source")), "E6 E7")
def profile_strings(spark, sf_dir):
    return E.profile_strings(table(spark, sf_dir, "documents"))


@register(
    "profile_top_values",
    """
with v as (select 'lang' as column_name, lang as value from documents union all
           select 'source' as column_name, source as value from documents),
c as (select column_name, value, count(*) as n from v where value is not null group by 1, 2),
d as (select column_name from c group by 1 having count(*) <= 20),
r as (select column_name, row_number() over (partition by column_name order by n desc, value) as rank, value, n
      from c where column_name in (select column_name from d))
select column_name, rank, value, n, cast(n as double) / (select count(*) from documents) * 100 as pct
from r where rank <= 10
""",
    "E7",
)
def profile_top_values(spark, sf_dir):
    return E.profile_top_values(table(spark, sf_dir, "documents"))


@register(
    "profile_samples",
    """
with v as (select event_id as rid, 'event_type' as column_name, event_type as value from events union all
           select event_id as rid, 'props' as column_name, props as value from events),
c as (select column_name, value, min(rid) as first_row from v where value is not null group by 1, 2),
d as (select column_name from c group by 1 having count(*) > 20),
r as (select column_name, row_number() over (partition by column_name order by first_row) as rank, value
      from c where column_name in (select column_name from d))
select column_name, rank, value from r where rank <= 5
""",
    "E8",
)
def profile_samples(spark, sf_dir):
    return E.profile_samples(table(spark, sf_dir, "events"), order="event_id")
