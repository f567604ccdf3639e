"""Selection, analyzers and decisions as SQL over small summaries; a summary has a row per model, endpoint, day or the like.

Doubles are written with an exponent, so that no decimal arithmetic slips in. Exponential averages are scans
(operators/scans.py), held against recursive SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from ..sources.tables import requests
from .registry import both, query


def flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


OK = flag("success")
DAY = "cast(floor(epoch_s / 86400) as bigint)"
#: A deterministic transport delay stands in for arrival times, which the tables do not have.
ARRIVAL = "epoch_s + (request_id % 7) * 3600"


MODELS = f"with m as (select model_id, count(*) as n, avg(cost_usd) as cost, avg(latency_ms) as latency, avg({OK}) as ok from requests group by model_id)"

# Frontier, score, safety checks against the present model, confidence
both(
    "x13_model_selection",
    MODELS
    + """, s as (select model_id, n, cost, latency, ok, ok * 5e0 as quality from m),
    f as (select a.model_id from s a where not exists (select 1 from s b where b.model_id <> a.model_id and b.cost <= a.cost and b.latency <= a.latency and b.quality >= a.quality and (b.cost < a.cost or b.latency < a.latency or b.quality > a.quality))),
    c as (select cost as now_cost, latency as now_latency from s where model_id = 'model_a'),
    r as (select s.model_id, n, ok, cost, latency, quality, f.model_id is not null as on_frontier, 4e-1 * (100e0 - least(cost, 100e0)) / 100e0 + 3e-1 * (5000e0 - least(latency, 5000e0)) / 5000e0 + 3e-1 * quality / 5e0 as score, now_cost, now_latency from s left join f on s.model_id = f.model_id cross join c)
    select model_id, on_frontier, round(score, 6) as score, row_number() over (order by on_frontier desc, score desc, model_id) as place, (cost - now_cost) / now_cost * 100e0 <= 10e0 as cost_check, latency - now_latency <= 100e0 as latency_check, quality >= 35e-1 as quality_check, round(least(1e0, 5e-1 * least(n / 1000e0, 1e0) + 5e-1 * ok), 6) as confidence from r""",
)

# Volatility as an exponential average of relative deviations of the rate
_MEAN, _DEVIATION = "0.1::double * r.rps + 0.9::double * w.mean", "abs(r.rps - ({m})) / greatest({m}, 1.0::double)"


@query(
    "x14_traffic_volatility",
    f"""with recursive d as (select model_id, {DAY} as day, count(*) / 24e0 as rps from requests group by model_id, {DAY}), r as materialized (select *, row_number() over (partition by model_id order by day) as k, max(rps) over (partition by model_id order by day) as peak from d),
    w as (select model_id, day, k, peak, 0.1::double * rps as mean, 0.1::double * ({_DEVIATION.format(m="0.1::double * rps").replace("r.rps", "rps")}) as volatility from r where k = 1
      union all select r.model_id, r.day, r.k, r.peak, {_MEAN}, 0.1::double * ({_DEVIATION.format(m=_MEAN)}) + 0.9::double * w.volatility from w join r on r.model_id = w.model_id and r.k = w.k + 1)
    select model_id, day, round(mean, 6) as mean_rate, round(volatility, 6) as volatility, round(peak, 6) as peak_rate from w""",
)
def traffic_volatility(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy("model_id", F.expr(DAY).alias("day")).agg((F.count("*") / 24).alias("rps"))
    found = decisions.traffic_volatility(daily, "model_id", "day", "rps", 0.1)
    return found.select("model_id", "day", *[F.round(c, 6).alias(c) for c in ("mean_rate", "volatility", "peak_rate")])


# The decision over clusters, with lifetime by frequency, threshold and confidence
both(
    "x15_cache_decision",
    """with g as (select model_id, endpoint, cast(floor(prompt_tokens / 100) as bigint) as band, count(*) as n, stddev_pop(prompt_tokens) / avg(prompt_tokens) as spread, sum(cost_usd) as cost from requests group by model_id, endpoint, cast(floor(prompt_tokens / 100) as bigint)),
    s as (select *, 8e-1 + case when spread < 1e-1 then 2e-1 when spread < 3e-1 then 1e-1 else 0e0 end as similarity from g),
    h as (select *, least(95e0, 50e0 * similarity + 30e0 * least(n / 100e0, 1e0) + 20e0 * least(n / 10e0, 1e0)) as hit_rate from s)
    select model_id, endpoint, band, n, round(hit_rate, 6) as hit_rate, round(cost * hit_rate / 100e0, 6) as saving, case when n > 100 then 3600 when n > 50 then 1800 when n > 10 then 900 else 300 end as ttl_seconds, similarity >= 85e-2 as above_threshold, round(least(1e0, 5e-1 * similarity + 5e-1 * least(n / 100e0, 1e0)), 6) as confidence from h where n >= 2""",
)

# The factor blended by confidence and held within bounds
both(
    "x16_rate_limit_blend",
    f"""with m as (select model_id, count(*) as n, avg({flag("not success")}) as e, sum(cost_usd) / 2e0 as b, stddev_pop(latency_ms) / avg(latency_ms) as v from requests group by model_id),
    f as (select *, least(1e0, n / 1000e0) as confidence, case when e > 1e-1 then 7e-1 when e > 5e-2 then 85e-2 when e > 2e-2 then 95e-2 else 11e-1 end * case when b > 1e0 then 8e-1 when b > 8e-1 then 9e-1 else 115e-2 end * case when v > 5e-1 then 105e-2 else 1e0 end as raw from m),
    c as (select *, least(12e-1, greatest(8e-1, 1e0 + (raw - 1e0) * confidence)) as factor from f)
    select model_id, round(confidence, 6) as confidence, round(factor, 6) as factor, cast(greatest(10, least(1000, floor(100 * factor))) as bigint) as new_limit from c""",
)

# Savings, latency and the trade-off of a batch size
both(
    "x17_batch_trade_off",
    """with m as (select endpoint, count(*) as n, count(*) * 60 / ((max(epoch_s) - min(epoch_s)) / 60e0) as per_minute, avg(latency_ms) as latency from requests group by endpoint),
    b as (select *, greatest(1, least(floor(per_minute / 60e0 * 30e0), floor(10000e0 / latency), 64)) as batch from m),
    t as (select *, 30e0 * ln(batch + 1e0) / ln(65e0) as saving_pct, latency * batch / 2e0 as added_latency from b)
    select endpoint, cast(batch as bigint) as batch, round(saving_pct, 6) as saving_pct, round(added_latency, 6) as added_latency, round(6e-1 * saving_pct / 100e0 - 4e-1 * least(added_latency / 10000e0, 1e0), 6) as trade_off, 6e-1 * saving_pct / 100e0 - 4e-1 * least(added_latency / 10000e0, 1e0) > 2e-1 as worth_it from t""",
)

# Readout of a prompt test, roll out, roll back or go on
both(
    "x18_prompt_test",
    """with a as (select r.endpoint, avg(case when variant = 'control' then prompt_tokens end) as t0, avg(case when variant = 'treatment' then prompt_tokens end) as t1, avg(case when variant = 'control' then rating end) as q0, avg(case when variant = 'treatment' then rating end) as q1, count(*) as n from requests r join feedback f on r.request_id = f.request_id group by r.endpoint),
    d as (select endpoint, n, (t0 - t1) / t0 * 100e0 as reduction, (q1 - q0) / q0 * 100e0 as quality_change from a)
    select endpoint, n, round(reduction, 6) as reduction, round(quality_change, 6) as quality_change, case when n < 20 then 'continue' when quality_change < -5e0 then 'rollback' when reduction > 0e0 then 'rollout' else 'continue' end as verdict from d""",
)

# Proposals are validated after the merge
both(
    "x19_validated_decisions",
    f"""with p as (select {DAY} as cycle, model_id as id, avg({OK}) as confidence, sum(cost_usd) as cost, avg(latency_ms) as latency from requests group by {DAY}, model_id),
    b as (select cycle, avg(cost) as mean_cost, avg(latency) as mean_latency from p group by cycle), c as (select p.*, (cost - mean_cost) / mean_cost * 100e0 as cost_pct, latency - mean_latency as more_ms from p join b on p.cycle = b.cycle)
    select cycle, id, round(confidence, 6) as confidence, round(cost_pct, 6) as cost_pct, case when confidence < 7e-1 then 'confidence' when cost_pct > 20e0 then 'cost' when more_ms > 500e0 then 'latency' else 'accepted' end as outcome from c""",
)

# X11: one row for every check with its own limit
both(
    "x20_canary_health",
    f"""with a as (select endpoint, variant, count(*) as n, avg({OK}) as ok, avg({flag("not success")}) as e, avg(latency_ms) as l, avg(cost_usd) as c from requests group by endpoint, variant),
    j as (select t.endpoint, t.n, t.ok, t.e, t.l, (t.c - b.c) / b.c * 100e0 as more_cost, t.ok - b.ok as better from a t join a b on t.endpoint = b.endpoint and t.variant = 'treatment' and b.variant = 'control'),
    r as (select endpoint, 'success' as name, ok as value, ok >= 95e-2 as passed from j union all select endpoint, 'errors', e, e <= 5e-2 from j union all select endpoint, 'latency', l, l <= 1000e0 from j union all select endpoint, 'cost', more_cost, more_cost <= 10e0 from j union all select endpoint, 'samples', cast(n as double), n >= 100 from j union all select endpoint, 'change', better, better >= -2e-2 from j)
    select endpoint, name, round(value, 6) as value, passed from r""",
)

# With the least time of observation and relative deviations from thresholds
both(
    "x21_phase_verdict",
    f"""with d as (select endpoint, {DAY} as day, count(*) as n, avg({OK}) as ok, avg(latency_ms) as l from requests where variant = 'treatment' group by endpoint, {DAY}),
    o as (select *, min(day) over (partition by endpoint) as opened from d), v as (select *, day - opened as days, (9e-1 - ok) / 9e-1 as short_of, (1e-1 - (1e0 - ok)) / 1e-1 as error_room from o)
    select endpoint, day, case when days < 2 then 'observe' when short_of > 2e-1 or error_room < -2e0 then 'rollback' when days >= 5 and n >= 2 and ok >= 9e-1 and l <= 2000e0 then 'promote' else 'hold' end as verdict from v""",
)

# Four terms with throughput, and its presets
both(
    "e19_four_term_score",
    MODELS
    + f""", d as (select model_id, count(*) / (count(distinct {DAY}) * 1e0) as per_day from requests group by model_id), p as (select 'balanced' as preset, 4e-1 as wq, 3e-1 as wc, 2e-1 as wl, 1e-1 as wt union all select 'quality', 7e-1, 1e-1, 1e-1, 1e-1 union all select 'cost', 2e-1, 6e-1, 1e-1, 1e-1 union all select 'speed', 2e-1, 1e-1, 4e-1, 3e-1),
    s as (select preset, m.model_id, wq * ok + wc * greatest(0e0, 1e0 - least(cost / 1e-1, 1e0)) + wl * greatest(0e0, 1e0 - least(latency / 5000e0, 1e0)) + wt * least(per_day / 1000e0, 1e0) as score from m join d on m.model_id = d.model_id cross join p)
    select preset, model_id, round(score, 6) as score, row_number() over (partition by preset order by round(score, 9) desc, model_id) as place from s""",
)

# Weights by preset and the best of each
both(
    "e20_composite_presets",
    MODELS
    + """, n as (select max(cost) as top_cost, max(latency) as top_latency from m), p as (select 'balanced' as preset, 5e-1 as wq, 3e-1 as wc, 2e-1 as wl union all select 'cost', 2e-1, 6e-1, 2e-1 union all select 'quality', 8e-1, 1e-1, 1e-1),
    s as (select preset, model_id, wq * ok + wc * (1e0 - cost / top_cost) + wl * (1e0 - latency / top_latency) as score from m cross join n cross join p)
    select preset, max_by(model_id, struct_order) as best, round(max(score), 6) as score from (select *, round(score, 9) as struct_order from s) x group by preset""",
)

FULL_REWARD = f"""with j as (select r.request_id, r.model_id, r.endpoint, r.cost_usd, r.latency_ms, f.rating, f.task_completed, f.retry_occurred, f.dwell_time_seconds, r.request_id % 11 = 0 as edited, r.request_id % 13 = 0 as kept from requests r join feedback f on r.request_id = f.request_id),
    i as (select *, least(1e0, greatest(0e0, 5e-1 + {flag("task_completed")} * 3e-1 - {flag("retry_occurred")} * 4e-1 - {flag("edited")} * 1e-1 + case when dwell_time_seconds > 10e0 and dwell_time_seconds < 120e0 then 2e-1 when dwell_time_seconds < 3e0 then -2e-1 else 0e0 end + {flag("kept")} * 2e-1)) as implicit from j),
    w as (select 'default' as preset, 6e-1 as wq, 3e-1 as wc, 1e-1 as wl union all select 'quality', 8e-1, 1e-1, 1e-1 union all select 'cost', 3e-1, 6e-1, 1e-1),
    r as (select preset, request_id, model_id, endpoint, (wq * (rating / 5e0 + implicit) / 2e0 + wc * (1e0 - least(1e0, cost_usd / 1e-2)) + wl * (1e0 - least(1e0, latency_ms / 5000e0))) * case when rating / 5e0 < 3e-1 or retry_occurred then 8e-1 else 1e0 end as reward from i cross join w)"""

# With edited, saved and shared answers, by preset; E10: the rollup a policy and its variants
both("e21_reward_presets", FULL_REWARD + " select preset, request_id, round(reward, 6) as reward from r")
both("e22_policy_rollup", FULL_REWARD + " select endpoint as policy, model_id as variant, count(*) as selections, round(sum(reward), 6) as total_reward, round(avg(reward), 6) as mean_reward, round(stddev_samp(reward), 6) as deviation from r where preset = 'default' group by endpoint, model_id")

# E5: every axis of a configuration, moved, held to its range and checked
both(
    "e23_variant_axes",
    """with b as (select distinct model_id from requests), x as (select 'temperature' as axis, 7e-1 as base, 0e0 as low, 2e0 as high union all select 'top_p', 9e-1, 0e0, 1e0 union all select 'max_tokens', 1024e0, 1e0, 4096e0), s as (select -5e-1 as step union all select -1e-1 union all select 2e-1 union all select 5e0)
    select model_id, axis, step, round(greatest(low, least(high, base * (1e0 + step))), 6) as value, base * (1e0 + step) between low and high as valid from b cross join x cross join s""",
)

# Configurations with their upper bound, inside a task's range, and the step towards the best
both(
    "e24_config_bounds",
    f"""with c as (select r.endpoint as task, r.model_id as config, count(*) as n, avg(f.rating / 5e0) as reward, avg({OK}) as ok, avg(r.completion_tokens) as tokens from requests r join feedback f on r.request_id = f.request_id group by r.endpoint, r.model_id), t as (select task, sum(n) as total from c group by task)
    select c.task, config, c.n, round(reward, 6) as reward, round(ok, 6) as success_rate, round(reward + sqrt(2e0 * ln(total) / c.n), 6) as ucb, tokens between 200 and 300 as in_range from c join t on c.task = t.task""",
)
both(
    "e25_suggested_step",
    """with c as (select r.endpoint as task, r.model_id as config, count(*) as n, avg(f.rating) as reward, avg(r.completion_tokens) as tokens from requests r join feedback f on r.request_id = f.request_id group by r.endpoint, r.model_id),
    b as (select task, max(round(reward, 9)) as top from c where n >= 3 and tokens between 100 and 400 group by task), w as (select c.task, min(c.config) as config, min(c.tokens) as tokens from c join b on c.task = b.task and round(c.reward, 9) = b.top group by c.task), o as (select endpoint as task, avg(completion_tokens) as now from requests group by endpoint)
    select w.task, config, round(now + 1e-1 * (tokens - now), 6) as next_tokens, case when tokens > now then 'up' when tokens < now then 'down' else 'stay' end as direction from w join o on w.task = o.task""",
)

# The grid and its best point
both(
    "e26_grid_best",
    f"""with g as (select t / 4e0 as temperature, 5e-1 + p * 25e-2 as top_p from (select 0 as t union all select 1 union all select 2 union all select 3 union all select 4) a cross join (select 0 as p union all select 1 union all select 2) b), q as (select endpoint, avg(latency_ms) / 1000e0 as m, avg({OK}) as ok from requests group by endpoint),
    s as (select endpoint, temperature, top_p, ok * (1e0 - abs(temperature - least(1e0, m))) * top_p as score from g cross join q), r as (select *, row_number() over (partition by endpoint order by round(score, 9) desc, temperature, top_p) as place from s)
    select endpoint, temperature, top_p, round(score, 6) as score from r where place = 1""",
)

# Temperature, nucleus, cut and length by task, from what the task's answers were like; score of candidates
both(
    "e27_parameter_rules",
    f"""with h as (select endpoint, avg({OK}) as coherence, stddev_pop(completion_tokens) / avg(completion_tokens) as diversity, avg(completion_tokens) as tokens from requests group by endpoint), b as (select 'click' as endpoint, 1e-1 as base, 256 as length union all select 'view', 4e-1, 512 union all select 'purchase', 2e-1, 1024 union all select 'signup', 12e-1, 2048),
    t as (select h.endpoint, tokens, coalesce(length, 1024) as length, least(2e0, greatest(0e0, coalesce(base, 7e-1) + case when diversity < 3e-1 then 2e-1 else 0e0 end - case when coherence < 7e-1 then 2e-1 else 0e0 end)) as temperature from h left join b on h.endpoint = b.endpoint)
    select endpoint, round(temperature, 6) as temperature, case when temperature < 3e-1 then 9e-1 when temperature < 7e-1 then 95e-2 else 1e0 end as top_p, case when temperature < 3e-1 then 10 when temperature < 7e-1 then 40 end as top_k, cast(least(length, ceil(tokens * 15e-1)) as bigint) as max_tokens from t""",
)
both(
    "e28_candidate_score",
    MODELS + ", s as (select model_id, 5e-1 * ok + 3e-1 / (1e0 + ln(cost + 1e0)) + 2e-1 / (1e0 + latency / 1000e0) + 1e-1 * 5e-1 * 7e-1 as score from m) select model_id, round(score, 6) as score, row_number() over (order by round(score, 9) desc, model_id) as place from s",
)

DAILY_COST = f"with d as (select model_id, {DAY} as day, sum(case when success then cost_usd else 0e0 end) as cost, count(*) as n from requests group by model_id, {DAY}), k as (select *, row_number() over (partition by model_id order by day) - 1 as k, lag(cost) over (partition by model_id order by day) as before from d)"

# Failed requests are free; spikes, average above the mean, and the z-score of the last days
@query(
    "z12_cost_insights",
    DAILY_COST.replace("with d as", "with recursive d as").replace("k as (select", "r as materialized (select").replace(" - 1 as k", " as k")
    + """, w as (select model_id, day, k, cost as ema from r where k = 1 union all select r.model_id, r.day, r.k, 0.2::double * r.cost + 0.8::double * w.ema from w join r on r.model_id = w.model_id and r.k = w.k + 1),
    e as (select r.*, w.ema, avg(cost) over (partition by r.model_id order by r.day rows between unbounded preceding and current row) as mean, avg(cost) over (partition by r.model_id order by r.day rows between 5 preceding and 1 preceding) as m5, stddev_pop(cost) over (partition by r.model_id order by r.day rows between 5 preceding and 1 preceding) as s5 from r join w on r.model_id = w.model_id and r.day = w.day)
    select model_id, day, round(cost, 6) as cost, case when before > 0 and (cost - before) / before > 1e0 then 'critical' when before > 0 and (cost - before) / before > 5e-1 then 'warning' end as spike, round(ema, 6) as ema, ema > 11e-1 * mean as above_mean, k > 10 and s5 > 1e-12 and (cost - m5) / s5 > 3e0 as odd from e""",
)
def cost_insights(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy("model_id", F.expr(DAY).alias("day")).agg(F.sum(F.when(F.col("success"), F.col("cost_usd")).otherwise(0.0)).alias("cost"))
    found = decisions.cost_insights(daily, "model_id", "day", "cost")
    return found.select("model_id", "day", F.round("cost", 6).alias("cost"), "spike", F.round("ema", 6).alias("ema"), "above_mean", "odd")


both("z13_budget_levels", f"with d as (select {DAY} as day, sum(case when success then cost_usd else 0e0 end) as cost from requests group by {DAY}), m as (select day, cost, sum(cost) over (partition by cast(floor(day / 30) as bigint) order by day rows between unbounded preceding and current row) as month_cost from d) select day, round(cost, 6) as cost, round(month_cost, 6) as month_cost, case when cost >= 9e-1 * 25e-2 then 'critical' when cost >= 8e-1 * 25e-2 then 'warning' end as daily, case when month_cost >= 9e-1 * 6e0 then 'critical' when month_cost >= 8e-1 * 6e0 then 'warning' end as monthly from m")

# Z3: what to do about cost, by priority
both(
    "z14_cost_recommendations",
    MODELS
    + """, c as (select min(cost) as low, max(cost) as high, max(n) as most, sum(n * cost) as total from m), r as (select 'switch to the cheapest model' as title, case when (high - low) / high > 5e-1 then 'high' else 'medium' end as priority, high - low as value from c where high - low > 1e-5
    union all select 'cache answers', 'medium', cast(most as double) from c where most > 100 union all select 'raise or cut the budget', 'urgent', total from c where total > 5e0) select title, priority, round(value, 6) as value from r""",
)

# Service levels by day, degradation against the first hundred requests
both(
    "z15_service_levels",
    f"""with d as (select model_id, {DAY} as day, percentile_cont(0.95) within group (order by latency_ms) as p95, percentile_cont(0.99) within group (order by latency_ms) as p99, avg({OK}) as ok from requests group by model_id, {DAY}),
    s as (select model_id, 100e0 * (1e0 - sum({flag("p95 > 1000")} + {flag("p99 > 2000")}) / (2e0 * count(*))) as compliance, avg(ok) * 100e0 as success_pct, max_by(ok, -day) * 100e0 as first_pct, max_by(ok, day) * 100e0 as last_pct from d group by model_id)
    select model_id, round(compliance, 6) as compliance, compliance < 95e0 as sla_broken, success_pct < 995e-1 as low_success, round((last_pct - first_pct) / greatest(abs(first_pct), 1e-9) * 100e0, 6) as change_pct, abs((last_pct - first_pct) / greatest(abs(first_pct), 1e-9) * 100e0) >= 10e0 as degraded from s""",
)

# Recommendations about quality, and where errors come from
both(
    "z16_quality_recommendations",
    f"""with m as (select r.model_id, avg({flag("not success")}) * 100e0 as errors, avg({OK}) * 100e0 as ok, avg({flag("latency_ms <= 1000")}) * 100e0 as compliance, avg(f.rating) as rating, count(*) as n from requests r left join feedback f on r.request_id = f.request_id group by r.model_id having count(*) >= 10),
    r as (select model_id, 'fix error sources' as title, case when errors >= 5e0 then 'urgent' else 'high' end as priority, errors as now, 5e-1 as expected from m where errors >= 1e0 union all select model_id, 'retry with backoff', 'high', ok, 995e-1 from m where ok < 995e-1
    union all select model_id, 'meet latency levels', 'high', compliance, 95e0 from m where compliance < 95e0 union all select model_id, 'review poor answers', 'medium', rating, 4e0 from m where rating < 4e0)
    select model_id, title, priority, round(now, 6) as now, expected, round(abs(now - expected) / now * 100e0, 6) as improvement_pct from r""",
)
both("z17_top_errors", "with e as (select model_id, variant, count(*) as n, count(distinct user_id) as users from requests where not success group by model_id, variant), r as (select *, row_number() over (order by n desc, model_id, variant) as place from e) select model_id, variant, n, users, place from r where place <= 5")

# Growth by the hour's line, weekday against weekend
both(
    "z18_growth_and_weekend",
    f"""with h as (select cast(floor(epoch_s / 3600) as bigint) as hour, count(*) as n from requests group by cast(floor(epoch_s / 3600) as bigint)), g as (select regr_slope(cast(n as double), cast(hour as double)) as slope, min_by(n, hour) as opening, sum(n) as total from h),
    d as (select {DAY} as day, count(*) as n from requests group by {DAY}), w as (select avg(case when (day + 3) % 7 >= 5 then n end) as weekend, avg(case when (day + 3) % 7 < 5 then n end) as weekday from d)
    select round(slope / opening * 100e0, 6) as growth_pct, abs(slope / opening * 100e0) > 20e0 as growing, round(weekend, 6) as weekend, round(weekday, 6) as weekday, total >= 100 and abs(weekend - weekday) / weekday * 100e0 > 30e0 as differs from g cross join w""",
)

# What to do about traffic
both(
    "z19_pattern_recommendations",
    """with e as (select endpoint, count(*) as n, avg(prompt_tokens) as tokens, count(distinct user_id) as users from requests group by endpoint), t as (select sum(n) as total from e), s as (select e.*, n * 100e0 / total as share from e cross join t)
    select endpoint, round(share, 6) as share, case when share > 30e0 then 'cache' when users <= 3 then 'dedicate' when tokens > 530e0 then 'shorten' else 'watch' end as action, case when share > 30e0 then 'high' else 'low' end as priority from s""",
)

# Two odd days in a row, with confidence and severity; error rates by level
both(
    "z20_confirmed_anomalies",
    f"""with d as (select model_id, {DAY} as day, avg(latency_ms) as v, avg({flag("not success")}) as e from requests group by model_id, {DAY}), s as (select *, avg(v) over w as m, stddev_pop(v) over w as sd, count(*) over w as n from d window w as (partition by model_id order by day rows between 7 preceding and 1 preceding)),
    z as (select *, case when n >= 3 and sd > 1e-9 then abs(v - m) / sd else 0e0 end as z from s), p as (select *, lag(z, 1, 0e0) over (partition by model_id order by day) as z_before from z)
    select model_id, day, round(z, 5) as z, z > 15e-1 and z_before > 15e-1 as confirmed, case when z > 5e0 then 'critical' when z > 4e0 then 'error' when z > 15e-1 then 'warning' end as severity, round(least(1e0, z / 6e0) * least(1e0, n / 7e0), 5) as confidence, case when e > 2e-1 then 'critical' when e > 1e-1 then 'error' when e > 5e-2 then 'warning' end as error_level from p""",
)

# The state of each alert
both(
    "z21_alert_lifecycle",
    f"""with d as (select model_id, {DAY} as day, avg({flag("not success")}) > 2e-1 as f from requests group by model_id, {DAY}), r as (select *, sum(case when f then 0 else 1 end) over (partition by model_id order by day rows between unbounded preceding and current row) as run from d),
    a as (select model_id, min(day) as started, max(day) as ended, count(*) as n from r where f group by model_id, run), l as (select max(day) as today from d)
    select a.model_id, started, ended, n, case when ended < today then 'resolved' when model_id = 'model_d' then 'silenced' when n >= 2 then 'acknowledged' else 'firing' end as state from a cross join l""",
)

# Nine rules over six-hour slots, each firing for two slots at least
both(
    "z22_nine_alert_rules",
    f"""with w as (select cast(floor(epoch_s / 21600) as bigint) as slot, avg({flag("not success")}) as e, max(latency_ms) as top, count(*) as n, sum(prompt_tokens + completion_tokens) as tokens, avg(cost_usd) as cost, max({ARRIVAL} - epoch_s) as lag, avg({flag("(request_id % 7) * 3600 > 10800")}) as late, count(distinct user_id) as users from requests group by cast(floor(epoch_s / 21600) as bigint)),
    f as (select slot, 'error rate' as rule, e > 25e-2 as f from w union all select slot, 'latency', top > 2500e0 from w union all select slot, 'consumer lag', lag > 18000 from w union all select slot, 'backpressure', n > 12 from w union all select slot, 'watermark lag', lag > 14400 from w union all select slot, 'late events', late > 4e-1 from w union all select slot, 'throughput', n < 3 from w union all select slot, 'tokens', tokens > 8000 from w union all select slot, 'converged', users > 5 from w),
    r as (select *, sum(case when f then 0 else 1 end) over (partition by rule order by slot rows between unbounded preceding and current row) as run from f) select rule, min(slot) as started, max(slot) as ended, count(*) as n from r where f group by rule, run having count(*) >= 2""",
)

# The summary of a report with its highlight and period
both(
    "z23_report_highlights",
    f"""with m as (select model_id, avg({flag("not success")}) as e, avg(latency_ms) as l from requests group by model_id), i as (select model_id, 'errors' as title, case when e > 2e-1 then 3 when e > 1e-1 then 2 else 0 end as level from m union all select model_id, 'latency', case when l > 2000e0 then 3 when l > 900e0 then 1 else 0 end from m), p as (select min(epoch_s) as opened, max(epoch_s) as closed from requests)
    select count(*) as insights, sum({flag("level = 3")}) as critical, sum({flag("level = 2")}) as errors, sum({flag("level = 1")}) as warnings, max(level) as worst, min(opened) as period_start, max(closed) as period_end from i cross join p""",
)

# A15, A22, A23, A26, A31
both("a14_distribution", f"with d as (select model_id, {DAY} as day, latency_ms as v, row_number() over (partition by model_id, {DAY} order by latency_ms) - 1 as k, count(*) over (partition by model_id, {DAY}) as n from requests) select model_id, day, max(n) as n, min(v) as low, max(v) as high, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, max(case when k = floor(n / 4e0) then v end) as p25, max(case when k = floor(n / 2e0) then v end) as p50, max(case when k = floor(n * 3 / 4e0) then v end) as p75 from d group by model_id, day")
both(
    "a15_period_costs",
    """with c as (select *, case when model_id in ('model_a', 'model_b') then 'first' else 'second' end as provider from requests), e as (select 'hour' as period, cast(floor(epoch_s / 3600) as bigint) as slot, provider, cost_usd from c union all select 'day', cast(floor(epoch_s / 86400) as bigint), provider, cost_usd from c union all select 'week', cast(floor((epoch_s + 259200) / 604800) as bigint), provider, cost_usd from c)
    select period, slot, provider, count(*) as n, round(sum(cost_usd), 6) as cost from e group by period, slot, provider""",
)
both("a16_trace_by_status", f"select variant as provider, success as status, {DAY} as day, count(*) as n, round(percentile_cont(0.5) within group (order by latency_ms), 6) as p50, round(percentile_cont(0.99) within group (order by latency_ms), 6) as p99 from requests group by variant, success, {DAY}")
both("a17_routing_confidence", "with u as (select user_id, model_id, count(*) as n from requests group by user_id, model_id), t as (select user_id, sum(n) as total from u group by user_id), c as (select u.model_id, u.n, u.n / (t.total * 1e0) as confidence from u join t on u.user_id = t.user_id) select model_id, sum(n) as requests, round(sum(confidence * n) / sum(n), 6) as mean_confidence, round(max(confidence), 6) as top_confidence from c group by model_id")
both("a18_multi_objective", MODELS + ", t as (select max(ok) as top_ok, min(cost) as low_cost, min(latency) as low_latency from m), s as (select model_id, ok / top_ok as quality, low_cost / cost as cheapness, low_latency / latency as speed from m cross join t) select model_id, round(quality, 6) as quality, round(cheapness, 6) as cheapness, round(speed, 6) as speed, row_number() over (order by round((quality + cheapness + speed) / 3e0, 9) desc, model_id) as place from s")
both("a19_peak_hours", "with h as (select endpoint, cast(floor(epoch_s / 3600) as bigint) % 24 as hour, count(*) as n from requests group by endpoint, cast(floor(epoch_s / 3600) as bigint) % 24), t as (select endpoint, max(n) as top, avg(n) as mean from h group by endpoint) select h.endpoint, hour, n, n = top as is_peak, round(n / mean, 6) as ratio from h join t on h.endpoint = t.endpoint")
both("a20_percentage_change", f"with d as (select model_id, {DAY} as day, count(*) as n from requests group by model_id, {DAY}), p as (select *, lag(n) over (partition by model_id order by day) as before from d) select model_id, day, n, round(case when before = 0 then case when n = 0 then 0e0 else 100e0 end else (n - before) * 100e0 / abs(before) end, 6) as change_pct from p where before is not null")
