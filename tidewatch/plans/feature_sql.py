"""Rows, keys, windows, deduplication and feature groups as SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, series
from ..operators import selection as E
from ..sources.tables import read, requests
from .decision_sql import ARRIVAL, DAY, OK, flag
from .registry import both, query
from .window_plans import rounded

c = F.col

# K5: processing delay and lateness; K11: all parts of a cost; K13: task presets and service levels
both("k05_delay_and_lateness", f"select request_id, ({ARRIVAL}) - epoch_s as delay_s, (({ARRIVAL}) - epoch_s) * 1000 as delay_ms, ({ARRIVAL}) - epoch_s > 10800 as is_late from requests")
both("k06_total_cost", "with p as (select request_id, prompt_tokens / 1000e0 * 3e-3 + completion_tokens / 1000e0 * 15e-3 as token_cost, latency_ms / 1000e0 * 2e-4 as compute_cost, case when latency_ms > 1000e0 then (latency_ms - 1000e0) * 1e-6 else 0e0 end as penalty from requests) select request_id, round(token_cost, 8) as token_cost, round(compute_cost, 8) as compute_cost, round(penalty, 8) as penalty, round(token_cost + compute_cost + penalty, 8) as total_cost from p")
both(
    "k07_task_presets",
    """with t as (select 'click' as endpoint, 'classification' as task, 500e0 as most_ms, 7e-1 as least_quality union all select 'view', 'summarization', 2000e0, 8e-1 union all select 'purchase', 'code_generation', 5000e0, 9e-1 union all select 'signup', 'question_answering', 1000e0, 85e-2)
    select r.request_id, coalesce(t.task, 'general') as task, r.latency_ms <= coalesce(most_ms, 3000e0) as meets_latency_sla, f.rating / 5e0 >= coalesce(least_quality, 75e-2) as meets_quality_threshold from requests r left join t on r.endpoint = t.endpoint left join feedback f on r.request_id = f.request_id""",
)

# Several keys at once, prefixes, ranges; S12: ready, replayed and purged dead letters; S13: a global cap; S14: what a full buffer does
both("s11_lookups", "with k as (select distinct user_id as wanted from requests where request_id % 100 = 0) select request_id, endpoint, 'keys' as how from requests where user_id in (select wanted from k) union all select request_id, endpoint, 'prefix' from requests where endpoint like 'p%' union all select request_id, endpoint, 'range' from requests where request_id between 100 and 299")
both(
    "s12_dead_letter_replay",
    """with l as (select request_id, epoch_s, cast(request_id % 15 as int) as retry_count from requests where not success), b as (select *, epoch_s + cast(least(3600e0, pow(2e0, least(retry_count, 10))) as bigint) as next_retry from l), t as (select max(epoch_s) as now from requests)
    select request_id, retry_count, next_retry, case when epoch_s < now - 20 * 86400 then 'purged' when next_retry <= now then 'ready' else 'waiting' end as state from b cross join t""",
)
both(
    "s13_capped_intake",
    f"""with p as (select request_id, user_id, model_id, {DAY} as day, row_number() over (partition by user_id, {DAY} order by epoch_s, request_id) as by_user, row_number() over (partition by model_id, endpoint, {DAY} order by epoch_s, request_id) as by_group from requests), a as (select *, by_user <= 2 as user_ok, by_group <= 3 as group_ok from p),
    k as (select day, count(*) as accepted from a where user_ok and group_ok group by day) select a.request_id, case when not user_ok then 'user' when not group_ok then 'group' when accepted > 25 and request_id % accepted >= 25 then 'global' else 'accepted' end as outcome from a left join k on a.day = k.day""",
)
both(
    "s14_full_buffers",
    f"""with p as (select request_id, {DAY} as day, endpoint, row_number() over (partition by endpoint, {DAY} order by epoch_s, request_id) as head, row_number() over (partition by endpoint, {DAY} order by epoch_s desc, request_id desc) as tail, count(*) over (partition by endpoint, {DAY}) as n from requests)
    select request_id, n, case when n >= 5 then 'full' when n >= 4 then 'critical' when n >= 3 then 'warning' else 'normal' end as level, tail <= 5 as kept_dropping_oldest, head <= 5 as kept_dropping_newest, case when head > 5 then 'rejected' else 'taken' end as rejecting, case when head > 5 then 'spilled' else 'memory' end as persisting from p""",
)

# Any and all of two triggers; W13: a timer after the window's end; W17: early and delayed results; W8: times of a window
both(
    "w15_composite_trigger",
    f"""with r as (select request_id, model_id, {DAY} as day, row_number() over (partition by model_id, {DAY} order by request_id) as n, max(epoch_s) over (partition by model_id, {DAY} order by request_id rows between unbounded preceding and current row) as seen from requests), t as (select *, n % 3 = 0 as by_count, seen - day * 86400 >= 43200 as by_time from r)
    select request_id, model_id, day, n, by_count or by_time as fires_any, by_count and by_time as fires_all from t where by_count or by_time""",
)
both(
    "w16_processing_timer",
    f"""with r as (select request_id, model_id, {DAY} as day, {ARRIVAL} as arrival, ({DAY} + 1) * 86400 + 3600 as fires_at from requests), w as (select model_id, day, min(fires_at) as fires_at, count(*) as n, sum({flag("arrival < fires_at")}) as in_time, min(case when arrival >= fires_at then arrival end) as first_late from r group by model_id, day)
    select model_id, day, fires_at, n, in_time, first_late is not null as fired_by_element from w""",
)
both(
    "w17_early_and_delayed",
    f"""with e as (select model_id, {DAY} as day, cast(floor((epoch_s - {DAY} * 86400) / 21600) as bigint) as part, count(*) as n, sum(cost_usd) as cost from requests group by model_id, {DAY}, cast(floor((epoch_s - {DAY} * 86400) / 21600) as bigint)), s as (select model_id, day, part, sum(n) over w as n, sum(cost) over w as cost, max(part) over (partition by model_id, day) as last_part from e window w as (partition by model_id, day order by part rows between unbounded preceding and current row))
    select model_id, day, day * 86400 + (part + 1) * 21600 as emitted_at, 'early' as kind, cast(n as bigint) as n, round(cost, 6) as cost from s union all select model_id, day, (day + 1) * 86400 + 3600, 'final', cast(n as bigint), round(cost, 6) from s where part = last_part""",
)
both("w18_window_times", f"select model_id, {DAY} * 86400 as window_start, ({DAY} + 1) * 86400 as window_end, ({DAY} + 1) * 86400 * 1000 - 1 as rowtime_ms, max({ARRIVAL}) as proctime, count(*) as n from requests group by model_id, {DAY}")

# T-10: what a normalised series was made of
both(
    "t10_fill_and_drop_rates",
    f"""with r as (select model_id, request_id, epoch_s, max(epoch_s) over (partition by model_id, {DAY} order by request_id rows between unbounded preceding and 1 preceding) as seen from requests), m as (select *, coalesce(seen - epoch_s > 21600, false) as late from r),
    s as (select model_id, count(*) as received, sum({flag("late")}) as dropped_late, count(distinct case when not late then cast(floor(epoch_s / 21600) as bigint) end) as slots, max(cast(floor(epoch_s / 21600) as bigint)) - min(cast(floor(epoch_s / 21600) as bigint)) + 1 as grid from m group by model_id)
    select model_id, received, dropped_late, slots, grid - slots as filled, round((grid - slots) * 100e0 / grid, 6) as fill_rate, round(dropped_late * 100e0 / received, 6) as drop_rate from s""",
)


def _hourly(spark, sf_dir):
    return requests(spark, sf_dir).groupBy("model_id", (c("epoch_s") - c("epoch_s") % 21600).alias("t")).agg(F.avg("latency_ms").alias("v"))


_HOURLY_SQL = "with h as (select model_id, epoch_s - epoch_s % 21600 as t, avg(latency_ms) as v from requests group by all), l as (select model_id, t, v, lead(t) over (partition by model_id order by t) as nt from h), g as (select *, unnest(range(t, coalesce(nt, t + 1), 21600)) as slot from l)"


@query("t04_fill_constant", _HOURLY_SQL + " select model_id, slot as t, round(case when slot = t then v else -1 end, 6) as v, slot <> t as filled from g")
def fill_constant(spark, sf_dir):
    return rounded(series.fill_gaps(_hourly(spark, sf_dir), "model_id", "t", "v", 21600, "constant", -1.0))


@query("t04_fill_skip", _HOURLY_SQL + " select model_id, slot as t, round(v, 6) as v, false as filled from g where slot = t")
def fill_skip(spark, sf_dir):
    return rounded(series.fill_gaps(_hourly(spark, sf_dir), "model_id", "t", "v", 21600, "skip"))


# Chosen or left-out fields, inside nested ones too; D5: what becomes of duplicates; D8: a filter of fixed size in front
@query("d06_chosen_fields", "with k as (select event_id, row_number() over (partition by user_id, event_type, json_extract_string(props, '$.k') order by event_id) > 1 as by_included, row_number() over (partition by user_id, event_type, value, props order by event_id) > 1 as by_excluded from events) select * from k", views=False)
def chosen_fields(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("nested", F.struct(c("user_id").alias("id"), F.struct("event_type", F.from_json("props", "k long").alias("p")).alias("body"))).withColumn("_e", F.lit(0))
    included = dedup.mark_duplicates(rows, dedup.content_hash(["nested"]), "_e", "event_id").withColumnRenamed("is_duplicate", "by_included")
    left_out = dedup.content_columns(rows, exclude=["event_id", "ts", "nested", "_e"])
    return dedup.mark_duplicates(included, dedup.content_hash(left_out), "_e", "event_id").select("event_id", "by_included", c("is_duplicate").alias("by_excluded"))


_SEEN = "with l as (select request_id, user_id is null or endpoint is null or request_id % 50 = 0 as unsure, epoch_s - lag(epoch_s) over (partition by user_id, endpoint order by epoch_s, request_id) < 86400 as seen from requests)"


@query("d07_strategies_of_filters", _SEEN + " select request_id, 'strict' as strategy from l where not coalesce(seen, false) and not unsure union all select request_id, 'best_effort' from l where not coalesce(seen, false) or unsure union all select request_id, 'log_only' from l")
def filter_strategies(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("unsure", c("user_id").isNull() | c("endpoint").isNull() | (c("request_id") % 50 == 0))
    marked = dedup.mark_duplicates(rows, dedup.composite_key("user_id", "endpoint"), "epoch_s", "request_id", 86400)
    kept = [dedup.filtered(marked, how, "unsure").select("request_id", F.lit(how).alias("strategy")) for how in ("strict", "best_effort", "log_only")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("d08_bloom_filter", "with s as (select user_id, event_type, count(*) as n from events group by all) select count(*) as keys, sum(n - 1)::bigint as duplicates, 0 as missed from s", views=False)
def bloom(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("k", F.concat_ws(":", "user_id", "event_type"))
    report = dedup.bloom_report(rows, "k", bits=1 << 20, hashes=4)
    return report.select("keys", "duplicates", "missed")


# Warnings; N11: limits on both sides and presets; N16: smoothed PSI of given histograms
both(
    "n19_threshold_presets",
    f"""with m as (select model_id, {DAY} as day, avg({OK}) as quality, avg(cost_usd) as cost, avg(latency_ms) as latency from requests group by model_id, {DAY}), l as (select model_id, day, 'quality' as metric, quality as v, 5e-1 as low, 11e-1 as high from m union all select model_id, day, 'cost', cost, 0e0, 8e-3 from m union all select model_id, day, 'latency', latency, 0e0, 1500e0 from m)
    select model_id, day, metric, round(v, 6) as v, case when v < low or v > high then 'critical' when v < low * 11e-1 or v > high * 9e-1 then 'warning' end as level from l""",
)
both(
    "n20_smoothed_stability",
    f"""with h as (select endpoint, cast(least(floor(latency_ms / 500e0), 9) as bigint) as bin, sum({flag("epoch_s < 1705000000")}) as a, sum({flag("epoch_s >= 1705000000")}) as b from requests group by endpoint, cast(least(floor(latency_ms / 500e0), 9) as bigint)), t as (select endpoint, sum(a) as ta, sum(b) as tb from h group by endpoint), s as (select h.endpoint, (a + 1e-10) / (ta + 1e-9) as p, (b + 1e-10) / (tb + 1e-9) as q from h join t on h.endpoint = t.endpoint)
    select endpoint, round(sum((q - p) * ln(q / p)), 5) as psi, sum((q - p) * ln(q / p)) > 2e-1 as drifted from s group by endpoint""",
)
both(
    "n21_drift_warnings",
    f"""with d as (select model_id, {DAY} as day, avg(latency_ms) / 1000e0 as x from requests group by model_id, {DAY}), w as (select model_id, day, x, avg(x) over r as recent, count(*) over r as n_recent, avg(x) over o as older, stddev_pop(x) over o as sd, count(*) over o as n_older, sum(x - 1e0 - 5e-2) over (partition by model_id order by day rows between unbounded preceding and current row) as s from d window r as (partition by model_id order by day rows between 4 preceding and current row), o as (partition by model_id order by day rows between 19 preceding and 5 preceding)),
    c as (select *, s - least(0e0, min(s) over (partition by model_id order by day rows between unbounded preceding and current row)) as high from w)
    select model_id, day, n_recent >= 5 and n_older > 5 and abs(recent - older) > 15e-1 * sd as adwin_warning, round(high, 6) as high, high > 2e0 as cusum_drift, high > 14e-1 and not high > 2e0 as cusum_warning from c""",
)

# The rest of the feature groups
both(
    "f05_request_group",
    """select request_id, prompt_tokens as prompt_length, ln(prompt_tokens + 1e0) / 10e0 >= 1e0 as long_prompt, case when prompt_tokens < 300 then 'short' when prompt_tokens < 700 then 'medium' else 'long' end as length_band, cast(floor(epoch_s / 3600) as bigint) % 24 as hour_of_day, (cast(floor(epoch_s / 86400) as bigint) + 3) % 7 as day_of_week, (cast(floor(epoch_s / 86400) as bigint) + 3) % 7 >= 5 as is_weekend, round(sin(2e0 * pi() * (epoch_s % 86400) / 86400e0), 6) as hour_sin, round(cos(2e0 * pi() * (epoch_s % 86400) / 86400e0), 6) as hour_cos, endpoint as task_type, length(endpoint) as task_length, variant = 'treatment' as is_treatment, prompt_tokens + completion_tokens as total_tokens, round(completion_tokens / (prompt_tokens * 1e0), 6) as expansion from requests""",
)
both(
    "f06_model_group",
    """with m as (select s_suppkey as model, n_name as provider, cast(s_acctbal as double) as balance from supplier join nation on s_nationkey = n_nationkey), p as (select provider, count(*) as models, avg(balance) as mean from m group by provider)
    select m.model, m.provider, case when balance > 5e3 then 128000 when balance > 0e0 then 32000 else 8000 end as context_length, round(abs(balance) / 1e6 + 1e-3, 8) as cost_per_1k_input, round((abs(balance) / 1e6 + 1e-3) * 3e0, 8) as cost_per_1k_output, round(least(1e0, greatest(0e0, balance / 1e4)), 6) as capability, models as models_of_provider, balance > mean as above_provider from m join p on m.provider = p.provider""",
    "supplier",
    "nation",
)
both(
    "f07_hour_sliding_group",
    """with o as (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9 union all select 10 union all select 11), s as (select r.*, (cast(floor(epoch_s / 300) as bigint) - k) * 300 as opened from requests r cross join o)
    select model_id, opened, opened + 3600 as closed, count(*) as n, round(percentile_cont(0.5) within group (order by latency_ms), 6) as p50, round(percentile_cont(0.95) within group (order by latency_ms), 6) as p95, round(avg(case when success then 1e0 else 0e0 end), 6) as success_rate from s group by model_id, opened""",
)
both(
    "f08_feedback_sessions",
    """with l as (select f.*, lag(epoch_s) over (partition by user_id order by epoch_s, request_id) as before from feedback f), k as (select *, sum(case when before is null or epoch_s - before > 43200 then 1 else 0 end) over (partition by user_id order by epoch_s, request_id rows between unbounded preceding and current row) as session_no from l)
    select user_id, session_no, count(*) as n, round(avg(rating), 6) as mean_rating, round(avg(case when task_completed then 1e0 else 0e0 end), 6) as completion_rate, round(avg(case when retry_occurred then 1e0 else 0e0 end), 6) as regeneration_rate, round(avg(dwell_time_seconds), 6) as dwell, max(epoch_s) - min(epoch_s) as lasted, count(*) > 1 as followed_up from k group by user_id, session_no""",
)
both(
    "f09_derived_group",
    f"""with m as (select model_id, {DAY} as day, avg(cost_usd) as cost, avg(latency_ms) as latency, avg({OK}) as ok, count(*) as n from requests group by model_id, {DAY}), b as (select day, avg(cost) as mean_cost, avg(latency) as mean_latency from m group by day)
    select model_id, m.day, round(1e0 / (1e0 + cost * 100e0) * 1e0 / (1e0 + latency / 1000e0), 6) as cost_latency_score, round(ok / (cost * 1000e0), 6) as quality_cost_ratio, round(latency / mean_latency, 6) as relative_latency, round(cost / mean_cost, 6) as relative_cost, round(n * cost / 1e0, 6) as spent, round(1e0 - least(1e0, n * cost / 25e-2), 6) as budget_left from m join b on m.day = b.day""",
)


# A share of requests explores by a hash of its id, the rest takes the best known
@query(
    "e29_epsilon_greedy",
    """with a as (select endpoint, model_id, avg(success::int) as m, count(*) as n from requests group by all), b as (select endpoint, arg_max(model_id, (round(m, 9), model_id)) as best from a group by endpoint), l as (select list(distinct model_id order by model_id) as arms from a),
    h as (select r.request_id, best, arms, ('0x' || substr(md5(request_id::varchar || 'e'), 1, 8))::bigint % 100 as h, ('0x' || substr(md5(request_id::varchar || 'a'), 1, 8))::bigint % len(arms) as k from requests r join b using (endpoint), l)
    select request_id, h < 10 as explores, case when h < 10 then arms[k + 1] else best end as choice from h""",
)
def epsilon_greedy(spark, sf_dir):
    rows = requests(spark, sf_dir)
    arms = rows.groupBy("endpoint", "model_id").agg(F.avg(c("success").cast("double")).alias("m"))
    best = arms.groupBy("endpoint").agg(F.max_by("model_id", F.struct(F.round("m", 9), "model_id")).alias("best"))
    names = arms.agg(F.array_sort(F.collect_set("model_id")).alias("arms"))
    return E.epsilon_greedy(rows.join(F.broadcast(best), "endpoint").crossJoin(F.broadcast(names)), "request_id", "arms", "best", 10)


@query(
    "e30_optimizer_policy",
    """with a as (select r.endpoint, r.model_id, avg(f.rating) as m, count(*) as n from requests r join feedback f using (request_id) group by all), t as (select endpoint, arg_max(model_id, (round(m, 9), model_id)) as task_best from a where n >= 5 group by endpoint), o as (select arg_max(model_id, (round(m, 9), model_id)) as overall from (select model_id, sum(m * n) / sum(n) as m from a group by model_id)),
    u as (select endpoint, arg_max(model_id, (round(m + sqrt(2 * ln(total) / n), 9), model_id)) as explorer from (select *, sum(n) over (partition by endpoint) as total from a) group by endpoint),
    h as (select request_id, coalesce(task_best, overall) as exploit, coalesce(explorer, overall) as explore, ('0x' || substr(md5(request_id::varchar || 'p'), 1, 8))::bigint % 100 < 20 as explores from requests left join t using (endpoint) left join u using (endpoint), o)
    select request_id, explores, case when explores then explore else exploit end as balanced, exploit, explore from h""",
)
def optimizer_policy(spark, sf_dir):
    from ..sources.tables import feedback

    rows = requests(spark, sf_dir)
    a = rows.join(feedback(spark, sf_dir).select("request_id", "rating"), "request_id").groupBy("endpoint", "model_id").agg(F.avg("rating").alias("m"), F.count("*").alias("n"))
    task = a.where("n >= 5").groupBy("endpoint").agg(F.max_by("model_id", F.struct(F.round("m", 9), "model_id")).alias("task_best"))
    overall = a.groupBy("model_id").agg((F.sum(c("m") * c("n")) / F.sum("n")).alias("m")).agg(F.max_by("model_id", F.struct(F.round("m", 9), "model_id")).alias("overall"))
    totals = a.groupBy("endpoint").agg(F.sum("n").alias("total"))
    bound = F.round(c("m") + F.sqrt(2 * F.ln("total") / c("n")), 9)
    explorer = a.join(totals, "endpoint").groupBy("endpoint").agg(F.max_by("model_id", F.struct(bound, "model_id")).alias("explorer"))
    chosen = rows.join(F.broadcast(task), "endpoint", "left").join(F.broadcast(explorer), "endpoint", "left").crossJoin(F.broadcast(overall))
    exploit, explore, explores = F.coalesce("task_best", "overall"), F.coalesce("explorer", "overall"), E.hash_below(c("request_id"), 100, "p") < 20
    return chosen.select("request_id", explores.alias("explores"), F.when(explores, explore).otherwise(exploit).alias("balanced"), exploit.alias("exploit"), explore.alias("explore"))


both("e31_adaptive_shares", f"with a as (select model_id, count(*) as n, avg({OK}) as m from requests group by model_id), t as (select sum(n) as total, sum(m) as mass from a) select model_id, round(m / mass, 6) as share, round(m + sqrt(2e0 * ln(total) / n), 6) as ucb, round(9e-1 * m / mass + 1e-1 / 4e0, 6) as blended from a cross join t")

# One step after another for each policy and arm
_STEP = "0.1::double * (r.y - (w.t0 * r.x0 + w.t1 * r.x1))"


@query(
    "e32_contextual_thompson",
    f"""with recursive r as materialized (select endpoint as policy, model_id as arm, 1.0::double as x0, prompt_tokens / 1000.0::double as x1, success::int::double as y, row_number() over (partition by endpoint, model_id order by request_id) as k from requests),
    w as (select policy, arm, cast(0 as bigint) as k, 0.0::double as t0, 0.0::double as t1, 1.0::double as v, 0.0::double as total from r where k = 1 union all
      select r.policy, r.arm, r.k, w.t0 + {_STEP} * r.x0, w.t1 + {_STEP} * r.x1, greatest(0.01::double, w.v * 0.99::double), w.total + r.y from w join r on r.policy = w.policy and r.arm = w.arm and r.k = w.k + 1)
    select policy, arm, max(k) as n, round(arg_max(t0, k), 6) as theta_0, round(arg_max(t1, k), 6) as theta_1, round(arg_max(v, k), 6) as variance, round(arg_max(total, k) / max(k), 6) as mean_reward from w group by policy, arm""",
)
def contextual_thompson(spark, sf_dir):
    rows = requests(spark, sf_dir).select(c("endpoint").alias("policy"), c("model_id").alias("arm"), "request_id", F.array(F.lit(1.0), c("prompt_tokens") / 1000, c("success").cast("double")).alias("xy"))
    found = E.contextual_thompson(rows, ["policy", "arm"], "request_id", "xy")
    return found.select("policy", "arm", "n", F.round(c("theta")[0], 6).alias("theta_0"), F.round(c("theta")[1], 6).alias("theta_1"), F.round("variance", 6).alias("variance"), F.round("mean_reward", 6).alias("mean_reward"))


# Dates beyond the plain parts, and functions of the user's own
@query("sql_date_formats", "select event_id, strftime(ts, '%d.%m.%Y %H:%M') as label, epoch(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'))::bigint as parsed, extract(week from ts)::int as week, extract(doy from ts)::int as doy, dayname(ts)[1:3] as weekday, epoch(date_trunc('hour', ts))::bigint as hour_start from events", views=False)
def date_formats(spark, sf_dir):
    parsed = "unix_seconds(cast(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'yyyy-MM-dd HH:mm:ss') as timestamp))"
    return read(spark, sf_dir, "events").selectExpr("event_id", "date_format(ts, 'dd.MM.yyyy HH:mm') as label", f"{parsed} as parsed", "cast(extract(week from ts) as int) as week", "cast(extract(doy from ts) as int) as doy", "date_format(ts, 'EEE') as weekday", "unix_seconds(cast(date_trunc('HOUR', ts) as timestamp)) as hour_start")


@query("sql_user_functions", "select user_id, round(sqrt(avg(value * value)), 6) as rms, round(max(value * 1.5 + 1), 6) as top_scaled, sum(len(event_type))::bigint as letters from events group by user_id", views=False)
def user_functions(spark, sf_dir):
    from ..functions.user import register_functions

    register_functions(spark)
    events = read(spark, sf_dir, "events")
    means = spark.sql("select user_id, round(tidewatch_rms(value), 6) as rms from {events} group by user_id", events=events)
    rest = spark.sql("select user_id, round(max(tidewatch_scaled(value)), 6) as top_scaled, sum(n) as letters from {events} e, lateral tidewatch_letters(event_type) l group by user_id", events=events)
    return means.join(rest, "user_id")
