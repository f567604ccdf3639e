"""Worked queries of the streaming SQL surface, as batch SQL over requests and feedback.

A window of s seconds is its start in seconds since 1970, `epoch_s - pmod(epoch_s, s)`: the text reads alike in both
dialects. Doubles are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ordered
from ..sources.tables import feedback, requests
from .registry import both, query

HOUR, SIX_HOURS, DAY = 3600, 21600, 86400


def start(seconds: int, column: str = "epoch_s") -> str:
    return f"({column} - {column} % {seconds})"


both("q01_request_rate", f"select model_id, {start(HOUR)} as window_start, count(*) as n, round(count(*) / cast({HOUR} as double), 6) as per_second from requests group by model_id, {start(HOUR)}")
both(
    "q02_latency_percentiles",
    f"""select model_id, {start(DAY)} as window_start, round(percentile_cont(0.5) within group (order by latency_ms), 6) as p50,
    round(percentile_cont(0.95) within group (order by latency_ms), 6) as p95, round(percentile_cont(0.99) within group (order by latency_ms), 6) as p99
    from requests group by model_id, {start(DAY)}""",
)
both(
    "q03_error_rate",
    f"""select model_id, {start(DAY)} as window_start, count(*) as n, sum(case when not success then 1 else 0 end) as errors,
    round(sum(case when not success then 1 else 0 end) * cast(100 as double) / count(*), 6) as error_pct
    from requests group by model_id, {start(DAY)} having count(*) >= 5""",
)
both("q04_hourly_cost", f"select model_id, {start(HOUR)} as hour_start, count(*) as n, round(sum(cost_usd), 6) as cost, round(avg(cost_usd) + cast(0.000000001 as double), 6) as mean_cost, sum(prompt_tokens + completion_tokens) as tokens from requests group by model_id, {start(HOUR)}")
both(
    "q05_cost_anomaly",
    f"""with hourly as (select model_id, {start(HOUR)} as hour_start, sum(cost_usd) as cost from requests group by model_id, {start(HOUR)}),
    framed as (select *, avg(cost) over (partition by model_id order by hour_start rows between 24 preceding and 1 preceding) as moving from hourly)
    select model_id, hour_start, round(cost, 6) as cost, round(moving + cast(0.000000001 as double), 6) as moving_cost, round(cost / moving, 5) as ratio from framed where cost > 1.5 * moving""",
)
both(
    "q06_user_sessions",
    f"""with stepped as (select *, lag(epoch_s) over (partition by user_id order by epoch_s, request_id) as before from requests),
    flagged as (select *, sum(case when before is null or epoch_s - before > {SIX_HOURS} then 1 else 0 end) over (partition by user_id order by epoch_s, request_id rows between unbounded preceding and current row) as session from stepped)
    select user_id, session, min(epoch_s) as started, max(epoch_s) as ended, count(*) as n, count(distinct model_id) as models, round(sum(cost_usd), 6) as cost from flagged group by user_id, session""",
)
both(
    "q07_journey_with_feedback",
    """select r.request_id, r.user_id, r.model_id, round(r.latency_ms, 6) as latency_ms, f.rating, f.epoch_s - r.epoch_s as seconds_to_feedback
    from requests r join feedback f on r.request_id = f.request_id and f.epoch_s between r.epoch_s and r.epoch_s + 300""",
)
both(
    "q08_moving_average",
    f"""with d as (select model_id, {start(DAY)} as day_start, avg(latency_ms) as latency, count(*) as n from requests group by model_id, {start(DAY)})
    select model_id, day_start, round(latency, 6) as latency, round(avg(latency) over (partition by model_id order by day_start rows between 6 preceding and current row), 6) as moving_latency,
    sum(n) over (partition by model_id order by day_start rows between unbounded preceding and current row) as running_n from d""",
)
both(
    "q09_top_models_per_window",
    f"""with d as (select {start(DAY)} as window_start, user_id, sum(cost_usd) as cost, count(*) as n from requests group by {start(DAY)}, user_id),
    r as (select *, row_number() over (partition by window_start order by cost desc, user_id) as place from d)
    select window_start, place, user_id, n, round(cost, 6) as cost from r where place <= 3""",
)
both(
    "q10_grouping_sets",
    """select model_id, endpoint, variant, grouping(model_id) as g_model, grouping(endpoint) as g_endpoint, count(*) as n, round(sum(cost_usd), 6) as cost
    from requests group by grouping sets ((model_id, endpoint), (model_id), (variant), ())""",
)
both("q10b_rollup", "select model_id, endpoint, count(*) as n, round(avg(latency_ms), 6) as latency from requests group by rollup (model_id, endpoint)")
both("q10c_cube", "select variant, success, count(*) as n, round(avg(latency_ms), 6) as latency from requests group by cube (variant, success)")
both(
    "q11_late_data",
    f"""with seen as (select request_id, epoch_s, max(epoch_s) over (partition by model_id order by request_id rows between unbounded preceding and 1 preceding) - 300 as mark from requests)
    select {start(DAY)} as window_start, count(*) as n, sum(case when epoch_s < mark then 1 else 0 end) as late from seen group by {start(DAY)}""",
)
both(
    "q12_throughput_vs_capacity",
    f"""with capacity as (select model_id, max(n) as most from (select model_id, {start(DAY)} as d, count(*) as n from requests group by model_id, {start(DAY)}) x group by model_id),
    d as (select model_id, {start(DAY)} as day_start, count(*) as n from requests group by model_id, {start(DAY)})
    select d.model_id, day_start, n, most, round(n * cast(100 as double) / most, 6) as used_pct from d join capacity c on d.model_id = c.model_id""",
)
both(
    "q13_ab_analysis",
    """select r.variant, count(*) as n, count(f.request_id) as rated, round(avg(r.latency_ms), 6) as latency, round(avg(r.cost_usd), 6) as cost, round(avg(f.rating), 6) as rating,
    round(stddev_samp(f.rating), 6) as rating_sd, sum(case when f.task_completed then 1 else 0 end) as conversions
    from requests r left join feedback f on r.request_id = f.request_id group by r.variant""",
)
both(
    "q14_cohorts",
    f"""with first_seen as (select user_id, min({start(DAY * 7)}) as cohort from requests group by user_id),
    aged as (select r.user_id, cohort, cast(floor(({start(DAY * 7, 'r.epoch_s')} - cohort) / cast({DAY * 7} as double)) as bigint) as week from requests r join first_seen f on r.user_id = f.user_id)
    select cohort, week, count(distinct user_id) as users, count(*) as n from aged group by cohort, week""",
)
both(
    "q15_quality_correlation",
    """select r.model_id, count(*) as n, round(corr(r.latency_ms, f.rating), 6) as latency_rating, round(corr(r.cost_usd, f.rating), 6) as cost_rating,
    round(covar_pop(r.latency_ms, f.rating), 6) as covar_p, round(covar_samp(r.latency_ms, f.rating), 6) as covar_s,
    round(regr_slope(f.rating, r.latency_ms), 9) as slope, round(regr_intercept(f.rating, r.latency_ms), 6) as intercept
    from requests r join feedback f on r.request_id = f.request_id group by r.model_id""",
)
both(
    "q16_token_efficiency",
    """select model_id, sum(prompt_tokens) as prompt, sum(completion_tokens) as completion, round(sum(completion_tokens) / cast(sum(prompt_tokens) as double), 6) as ratio,
    round(sum(cost_usd) / sum(prompt_tokens + completion_tokens) * 1000, 6) as cost_per_1k from requests group by model_id""",
)
both(
    "q17_enrichment",
    """with dim as (select 'model_a' as model_id, 'small' as tier, 5000 as sla_ms union all select 'model_b', 'small', 3000 union all select 'model_c', 'large', 2000)
    select r.request_id, r.model_id, d.tier, case when d.sla_ms is null then null else r.latency_ms <= d.sla_ms end as in_sla from requests r left join dim d on r.model_id = d.model_id""",
)
both(
    "q18_drift",
    f"""with d as (select model_id, {start(DAY)} as day_start, avg(latency_ms) as m, stddev_samp(latency_ms) as s, count(*) as n from requests group by model_id, {start(DAY)}),
    b as (select *, avg(m) over (partition by model_id order by day_start rows between 7 preceding and 1 preceding) as base, avg(s) over (partition by model_id order by day_start rows between 7 preceding and 1 preceding) as base_s from d)
    select model_id, day_start, round(m, 6) as latency, round(base, 6) as baseline, round((m - base) / nullif(base_s, 0), 6) as score, abs(m - base) > 0.5 * base_s as drifted from b where base is not null""",
)
both(
    "q19_trend",
    f"""with d as (select model_id, {start(DAY)} as day_start, count(*) as n from requests group by model_id, {start(DAY)}), l as (select *, lag(n) over (partition by model_id order by day_start) as before from d)
    select model_id, day_start, n, before, case when before is null then 'new' when n > 1.2 * before then 'up' when n < 0.8 * before then 'down' else 'flat' end as trend from l""",
)


@query(
    "q20_multi_join",
    """select r.request_id, r.user_id, f.rating, n.request_id as next_request, n.epoch_s - r.epoch_s as gap
    from requests r left join feedback f on f.request_id = r.request_id and f.epoch_s <= r.epoch_s + 120 left join requests n on n.user_id = r.user_id and n.epoch_s > r.epoch_s and n.epoch_s <= r.epoch_s + 900""",
)
def multi_join(spark, sf_dir):
    """A user's requests meet within time buckets only."""
    rows = requests(spark, sf_dir)
    rated = feedback(spark, sf_dir).select(F.col("request_id").alias("rated"), "rating", F.col("epoch_s").alias("rated_at"))
    both_sides = rows.join(rated, (F.col("request_id") == F.col("rated")) & (F.col("rated_at") <= F.col("epoch_s") + 120), "left").select("request_id", "user_id", "epoch_s", "rating")
    following = rows.select("user_id", F.col("request_id").alias("next_request"), F.col("epoch_s").alias("next_at"))
    found = joins.interval_join(both_sides, following, "user_id", "epoch_s", "next_at", 900, "left", only_after=True)
    return found.select("request_id", "user_id", "rating", "next_request", (F.col("next_at") - F.col("epoch_s")).alias("gap"))


both(
    "sql_scalar_functions",
    """select event_id, upper(event_type) as u, lower(event_type) as l, length(event_type) as n, substring(event_type, 2, 3) as mid, concat(event_type, '-', cast(user_id as string)) as c,
    trim(concat('  ', event_type, ' ')) as t, ltrim('  x') as lt, rtrim('x  ') as rt, replace(event_type, 'e', 'E') as r, regexp_replace(event_type, '^[aeiou]', '_') as rr0, abs(-value) as a, cast(ceil(value) as bigint) as ce, cast(floor(value) as bigint) as fl,
    round(sqrt(value), 6) as sq, round(power(value, 2), 6) as pw, round(exp(-value), 9) as ex, round(ln(value + 1), 6) as lg, round(log10(value + 1), 6) as lg10, mod(event_id, 7) as m, cast(sign(value) as int) as sg,
    coalesce(nullif(event_type, 'error'), 'none') as cn, case event_type when 'error' then 1 else 0 end as e, try_cast(event_type as int) as bad from events""",
    "events",
)
both("sql_predicates", "select event_id from events where event_type like 'p%' and value between 1 and 50 and user_id in (1, 2, 3, 4, 5) or event_type ilike 'ERR%' and value is not null and not value > 10", "events")
both("sql_exists", "select request_id from requests r where exists (select 1 from feedback f where f.request_id = r.request_id and f.rating >= 4)")


@query("sql_not_in", "select request_id from requests where request_id not in (select request_id from feedback)")
def not_in(spark, sf_dir):
    """Spark would send the whole subquery to every task."""
    return joins.not_in(requests(spark, sf_dir).select("request_id"), feedback(spark, sf_dir), "request_id", "request_id")


both("sql_distinct", "select distinct model_id, endpoint, success from requests")
both("sql_union", "select model_id, variant from requests where success union select 'model_x', 'control'")
both("sql_union_all", "select user_id, 'request' as kind from requests union all select user_id, 'feedback' from feedback")
both("sql_intersect", "select user_id from requests where endpoint = 'error' intersect select user_id from feedback where rating >= 5")
both("sql_except", "select user_id from requests except select user_id from feedback where rating >= 5")
both("sql_order_limit", "select request_id, latency_ms from requests order by latency_ms desc nulls last, request_id limit 20 offset 5")
both("sql_joins_right_full", "select r.model_id, f.rating, count(*) as n from (select * from requests where success) r full join (select * from feedback where rating > 2) f on r.request_id = f.request_id group by r.model_id, f.rating")
both("sql_right_join", "select f.request_id, r.model_id from (select * from requests where success) r right join feedback f on r.request_id = f.request_id")
both(
    "sql_self_join_models",
    """with m as (select model_id, percentile_cont(0.5) within group (order by latency_ms) as p50, percentile_cont(0.99) within group (order by latency_ms) as p99, count(*) as n from requests group by model_id)
    select a.model_id as model_1, b.model_id as model_2, round(a.p50 - b.p50, 6) as p50_diff, round(a.p99 - b.p99, 6) as p99_diff, a.n - b.n as n_diff from m a join m b on a.model_id < b.model_id""",
)
both(
    "sql_ranking",
    """select user_id, request_id, rank() over (partition by user_id order by endpoint) as rk, dense_rank() over (partition by user_id order by endpoint) as dr, row_number() over (partition by user_id order by epoch_s, request_id) as rn,
    lead(request_id) over (partition by user_id order by epoch_s, request_id) as next_id, first_value(request_id) over (partition by user_id order by epoch_s, request_id) as first_id,
    last_value(request_id) over (partition by user_id order by epoch_s, request_id rows between unbounded preceding and unbounded following) as last_id from requests""",
)


@query(
    "sql_range_frame",
    f"select request_id, count(*) over (partition by model_id order by epoch_s range between {HOUR} preceding and current row) as last_hour, round(sum(cost_usd) over (partition by model_id order by epoch_s range between {HOUR} preceding and current row), 6) as cost_last_hour from requests",
)
def range_frame(spark, sf_dir):
    c = F.col
    rows = requests(spark, sf_dir).select("request_id", "model_id", "epoch_s", "cost_usd")
    framed = ordered.range_totals(rows, "model_id", "epoch_s", HOUR, {"last_hour": ("count", F.lit(1)), "_cost": ("sum", c("cost_usd"))})
    return framed.select("request_id", "last_hour", F.round("_cost", 6).alias("cost_last_hour"))


both("sql_conditional_aggregates", "select model_id, count(*) filter (where success) as ok, count(case when latency_ms > 2000 then 1 end) as slow, round(avg(case when success then latency_ms end), 6) as ok_latency from requests group by model_id")
both(
    "sql_budget_forecast",
    f"""with d as (select {start(DAY)} as day_start, sum(cost_usd) as cost from requests group by {start(DAY)}), m as (select max(cost) as peak, avg(cost) as mean from d)
    select day_start, round(cost, 6) as cost, cost = peak as is_peak, round(mean * 30, 6) as month_forecast from d cross join m""",
)
both(
    "sql_week_over_week",
    f"""with d as (select {start(DAY * 7)} as week_start, count(*) as n, sum(cost_usd) as cost from requests group by {start(DAY * 7)}), l as (select *, lag(cost) over (order by week_start) as before from d)
    select week_start, n, round(cost, 6) as cost, round((cost - before) / nullif(before, 0) * 100, 6) as change_pct from l""",
)
both("sql_churn", "select user_id, max(epoch_s) as last_seen, count(*) as n, (select max(epoch_s) from requests) - max(epoch_s) > 604800 as churned from requests group by user_id")
both("sql_sla_report", "select model_id, count(*) as n, round(avg(case when latency_ms <= 1000 then 100 else 0 end), 6) as within_1s_pct, round(avg(case when success then 100 else 0 end), 6) as success_pct from requests group by model_id")
