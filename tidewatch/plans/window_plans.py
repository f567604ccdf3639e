"""Windows, watermarks and aggregates over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordered as O
from ..operators import windows as W
from ..sources.tables import requests
from .registry import query

SUMMARY = [("count", "latency_ms", "n"), ("sum", "cost_usd", "cost"), ("avg", "latency_ms", "mean"), ("min", "latency_ms", "low"), ("max", "latency_ms", "high"), ("percentile", "latency_ms", "p50", 50), ("percentile", "latency_ms", "p95", 95), ("percentile", "latency_ms", "p99", 99), ("stddev", "latency_ms", "sd"), ("stddev_pop", "latency_ms", "sd_pop")]
SUMMARY_SQL = """count(latency_ms) as n, round(sum(cost_usd), 6) as cost, round(avg(latency_ms), 6) as mean, round(min(latency_ms), 6) as low, round(max(latency_ms), 6) as high,
  round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99, round(stddev_samp(latency_ms), 6) as sd, round(stddev_pop(latency_ms), 6) as sd_pop"""


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("w01_tumbling_aggregate", f"select model_id, time_bucket(interval '6 hours', event_time, timestamp '1970-01-01') as window_start, time_bucket(interval '6 hours', event_time, timestamp '1970-01-01') + interval '6 hours' as window_end, {SUMMARY_SQL} from requests group by all")
def tumbling_aggregate(spark, sf_dir):
    return rounded(W.window_aggregate(requests(spark, sf_dir), ["model_id"], W.tumbling("event_time", "6 hours"), SUMMARY))


@query("w02_tumbling_offset", f"select model_id, time_bucket(interval '6 hours', event_time, timestamp '1970-01-01 01:00:00') as window_start, time_bucket(interval '6 hours', event_time, timestamp '1970-01-01 01:00:00') + interval '6 hours' as window_end, {SUMMARY_SQL} from requests group by all")
def tumbling_offset(spark, sf_dir):
    return rounded(W.window_aggregate(requests(spark, sf_dir), ["model_id"], W.tumbling("event_time", "6 hours", "1 hour"), SUMMARY))


@query(
    "w03_sliding_aggregate",
    f"""with s as (select *, unnest([0, 1, 2]) as k from requests),
    w as (select *, time_bucket(interval '8 hours', event_time, timestamp '1970-01-01') - to_hours(8 * k) as window_start from s)
    select model_id, variant, window_start, window_start + interval '24 hours' as window_end, {SUMMARY_SQL} from w group by model_id, variant, window_start""",
)
def sliding_aggregate(spark, sf_dir):
    return rounded(W.window_aggregate(requests(spark, sf_dir), ["model_id", "variant"], W.sliding("event_time", "24 hours", "8 hours"), SUMMARY))


SESSIONS = """with l as (select *, lag(event_time) over (partition by user_id order by event_time) as before from requests),
    f as (select *, sum(case when before is null or event_time >= before + interval '12 hours' then 1 else 0 end) over (partition by user_id order by event_time rows between unbounded preceding and current row) as k from l)"""


@query("w04_session_aggregate", f"{SESSIONS} select user_id, min(event_time) as window_start, max(event_time) + interval '12 hours' as window_end, {SUMMARY_SQL} from f group by user_id, k")
def session_aggregate(spark, sf_dir):
    return rounded(W.window_aggregate(requests(spark, sf_dir), ["user_id"], W.session("event_time", "12 hours"), SUMMARY))


@query(
    "w05_capped_sessions",
    """with recursive r as (select *, row_number() over (partition by user_id order by epoch_s, request_id) as k from requests),
    w as (select user_id, request_id, epoch_s, k, cast(0 as bigint) as session_no, epoch_s as opened from r where k = 1 union all
      select r.user_id, r.request_id, r.epoch_s, r.k, w.session_no + case when r.epoch_s - w.epoch_s > 43200 or r.epoch_s - w.opened >= 172800 then 1 else 0 end, case when r.epoch_s - w.epoch_s > 43200 or r.epoch_s - w.opened >= 172800 then r.epoch_s else w.opened end from w join r on r.user_id = w.user_id and r.k = w.k + 1)
    select user_id, request_id, epoch_s, session_no from w""",
)
def capped_sessions(spark, sf_dir):
    return W.capped_sessions(requests(spark, sf_dir), "user_id", "epoch_s", "request_id", 12 * 3600, 48 * 3600)


@query("w06_global_window", f"select model_id, {SUMMARY_SQL} from requests group by model_id")
def global_window(spark, sf_dir):
    return rounded(A.agg_whole(requests(spark, sf_dir), ["model_id"], SUMMARY))


@query(
    "w07_count_window",
    """with r as (select *, (row_number() over (partition by model_id order by epoch_s, request_id) - 1) // 25 as window_no, count(*) over (partition by model_id) as n from requests)
    select model_id, window_no, count(*) as n, round(avg(latency_ms), 6) as latency, bool_and((window_no + 1) * 25 <= n) as complete from r group by model_id, window_no""",
)
def count_window(spark, sf_dir):
    rows = W.count_windows(requests(spark, sf_dir), "model_id", ["epoch_s", "request_id"], 25)
    return rows.groupBy("model_id", "window_no").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.bool_and("complete").alias("complete"))


@query(
    "w08_cumulate",
    """with s as (select model_id, epoch_s - epoch_s % 21600 as step, count(*) as c, sum(cost_usd) as v from requests group by all), w as (select *, step - step % 86400 as window_start from s)
    select model_id, window_start, step + 21600 as window_end, sum(c) over x::bigint as n, round(sum(v) over x, 6) as total from w window x as (partition by model_id, window_start order by step)""".replace("sum(c) over x::bigint", "cast(sum(c) over x as bigint)"),
)
def cumulate(spark, sf_dir):
    return rounded(W.cumulate(requests(spark, sf_dir), ["model_id"], "epoch_s", 21600, 86400, "cost_usd"))


@query(
    "w09_window_algebra",
    """with w as (select request_id, epoch_s as a, epoch_s + 3600 as b, lead(epoch_s) over (partition by user_id order by epoch_s, request_id) as c from requests), x as (select *, c + 1800 as d from w where c is not null)
    select request_id, a < d and c < b as overlaps, a <= c and d <= b as contains, least(a, c) as merged_start, greatest(b, d) as merged_end, greatest(0, greatest(a, c) - least(b, d)) as gap from x""",
)
def window_algebra(spark, sf_dir):
    from pyspark.sql import Window

    following = F.lead("epoch_s").over(Window.partitionBy("user_id").orderBy("epoch_s", "request_id"))
    rows = requests(spark, sf_dir).withColumn("_c", following).where(F.col("_c").isNotNull())
    a, c = F.col("epoch_s"), F.col("_c")
    return rows.select("request_id", *[v.alias(k) for k, v in W.bounds_algebra(a, a + 3600, c, c + 1800).items()])


@query("w10_count_trigger", "with r as (select *, epoch_s - epoch_s % 86400 as day, row_number() over (partition by model_id, epoch_s - epoch_s % 86400 order by request_id) as fired_at from requests) select request_id, model_id, day, fired_at from r where fired_at % 5 = 0")
def count_trigger(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("day", F.col("epoch_s") - F.col("epoch_s") % 86400)
    return W.count_trigger(rows, ["model_id", "day"], ["request_id"], 5).select("request_id", "model_id", "day", "fired_at")


REPLAY = "with m as (select *, max(epoch_s) over (partition by model_id order by request_id rows between unbounded preceding and 1 preceding) - 300 as watermark from requests), r as (select *, coalesce(epoch_s < watermark, false) as is_late, case when epoch_s < watermark then watermark - epoch_s else 0 end as lateness from m)"


def replayed(spark, sf_dir):
    return W.watermark_replay(requests(spark, sf_dir), "model_id", "epoch_s", "request_id", 300)


@query("w11_watermark_replay", f"{REPLAY} select request_id, watermark, is_late, lateness from r")
def watermark_replay(spark, sf_dir):
    return replayed(spark, sf_dir).select("request_id", "watermark", "is_late", "lateness")


@query("w12_late_policy", f"{REPLAY} select model_id, count(*) as n, count(*) filter (where is_late and lateness > 86400) as dropped, count(*) filter (where is_late and lateness <= 86400) as accepted_late, round(avg(lateness) filter (where is_late), 6) as mean_lateness from r group by model_id")
def late_policy(spark, sf_dir):
    late = F.col("is_late")
    return replayed(spark, sf_dir).groupBy("model_id").agg(
        F.count("*").alias("n"), F.count(F.when(late & (F.col("lateness") > 86400), 1)).alias("dropped"), F.count(F.when(late & (F.col("lateness") <= 86400), 1)).alias("accepted_late"), F.round(F.avg(F.when(late, F.col("lateness"))), 6).alias("mean_lateness")
    )


@query(
    "w13_punctuated_watermark",
    """with k as (select *, row_number() over (partition by model_id order by request_id) as k, max(epoch_s) over (partition by model_id order by request_id rows unbounded preceding) as top from requests)
    select request_id, max(case when k % 10 = 0 then top end) over (partition by model_id order by request_id rows unbounded preceding) as watermark from k""",
)
def punctuated(spark, sf_dir):
    return W.punctuated_watermark(requests(spark, sf_dir), "model_id", "epoch_s", "request_id", 10).select("request_id", "watermark")


@query("w14_window_stats", "select time_bucket(interval '1 day', event_time, timestamp '1970-01-01') as window_start, count(*) as n, min(event_time) as first_time, max(event_time) as last_time from requests group by all")
def window_stats(spark, sf_dir):
    return requests(spark, sf_dir).groupBy(F.window("event_time", "1 day").alias("w")).agg(F.count("*").alias("n"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time")).select(F.col("w.start").alias("window_start"), "n", "first_time", "last_time")


@query("a01_rate", "select model_id, round(count(*) / nullif(max(epoch_s) - min(epoch_s), 0)::double, 9) as per_second from requests group by model_id")
def rate(spark, sf_dir):
    return rounded(requests(spark, sf_dir).groupBy("model_id").agg(*A.agg_spec([("rate", "epoch_s", "per_second")])), 9)


@query("a02_histogram", "select model_id, " + ", ".join(f"count(*) filter (where latency_ms <= {b}) as latency_le_{i}" for i, b in enumerate((100, 500, 1000, 2000, 5000))) + " from requests group by model_id")
def histogram(spark, sf_dir):
    return requests(spark, sf_dir).groupBy("model_id").agg(*A.agg_spec([("histogram", "latency_ms", "latency", (100, 500, 1000, 2000, 5000))]))


RANKED = "with r as (select model_id, latency_ms, row_number() over (partition by model_id order by latency_ms) - 1 as k, count(*) over (partition by model_id) as n from requests)"


@query("a03_nearest_rank", f"{RANKED} select model_id, max(n) as n, " + ", ".join(f"max(case when k = floor({p}::double / 100 * (n - 1) + 0.5) then latency_ms end) as {c}" for c, p in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("p999", 99.9))) + " from r group by model_id")
def nearest_rank(spark, sf_dir):
    return A.by_rank(requests(spark, sf_dir), ["model_id"], "latency_ms", {c: A.nearest_rank(p) for c, p in (("p50", 50.0), ("p90", 90.0), ("p95", 95.0), ("p99", 99.0), ("p999", 99.9))})


@query("a04_quartiles", f"{RANKED}, q as (select model_id, max(n) as n, max(case when k = n // 4 then latency_ms end) as q1, max(case when k = n * 3 // 4 then latency_ms end) as q3 from r group by model_id) select *, q3 - q1 as iqr from q")
def quartiles(spark, sf_dir):
    return A.by_rank(requests(spark, sf_dir), ["model_id"], "latency_ms", {"q1": A.quartile(1), "q3": A.quartile(3)}).withColumn("iqr", F.col("q3") - F.col("q1"))


@query("a05_trend", "with d as (select model_id, epoch_s // 86400 as day, count(*) as c from requests group by all) select model_id, round(regr_slope(c, day), 6) as slope, round(regr_intercept(c, day), 2) as intercept, round(case when var_pop(c) = 0 then 1 else regr_r2(c, day) end, 6) as r2, count(*) as n from d group by model_id")
def trend(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy("model_id", F.floor(F.col("epoch_s") / 86400).alias("day")).agg(F.count("*").cast("double").alias("c"))
    return A.trend(daily, ["model_id"], "c", "day").select("model_id", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("a06_ordered_lists", "select user_id, list(request_id order by epoch_s, request_id) as ids, string_agg(model_id, ',' order by epoch_s, request_id) as models, arg_min(endpoint, (epoch_s, request_id)) as first_endpoint, arg_max(endpoint, (epoch_s, request_id)) as last_endpoint, count(distinct model_id) as n_models from requests where success group by user_id")
def ordered_lists(spark, sf_dir):
    at = F.struct("epoch_s", "request_id")
    ordered = F.array_sort(F.collect_list(F.struct("epoch_s", "request_id", "model_id")))
    return (
        requests(spark, sf_dir).where("success").groupBy("user_id")
        .agg(F.transform(ordered, lambda x: x["request_id"]).alias("ids"), F.concat_ws(",", F.transform(ordered, lambda x: x["model_id"])).alias("models"), F.min_by("endpoint", at).alias("first_endpoint"), F.max_by("endpoint", at).alias("last_endpoint"), F.count_distinct("model_id").alias("n_models"))
    )


@query("a07_percentile_kinds", "select model_id, round(quantile_cont(latency_ms, 0.9), 6) as cont, quantile_disc(latency_ms, 0.9) as disc, round(var_samp(latency_ms), 4) as v, round(var_pop(latency_ms), 4) as vp from requests group by model_id")
def percentile_kinds(spark, sf_dir):
    rows = requests(spark, sf_dir)
    cont = O.percentiles(rows, ["model_id"], "latency_ms", {"cont": 0.9})
    disc = O.values_at(rows, ["model_id"], "latency_ms", {"disc": lambda n: F.ceil(F.lit(0.9) * n) - 1}).drop("n")
    spread = rows.groupBy("model_id").agg(F.round(F.var_samp("latency_ms"), 4).alias("v"), F.round(F.var_pop("latency_ms"), 4).alias("vp"))
    return spread.join(cont.withColumn("cont", F.round("cont", 6)), "model_id").join(disc, "model_id")


@query("a08_period_rollup", "select 'day' as period, strftime(event_time, '%Y-%m-%d') as label, model_id, round(sum(cost_usd), 6) as cost from requests group by all union all select 'month', strftime(event_time, '%Y-%m'), model_id, round(sum(cost_usd), 6) from requests group by all")
def period_rollup(spark, sf_dir):
    rows = requests(spark, sf_dir)
    each = [rows.groupBy(F.lit(p).alias("period"), F.date_format("event_time", f).alias("label"), "model_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost")) for p, f in (("day", "yyyy-MM-dd"), ("month", "yyyy-MM"))]
    return each[0].unionByName(each[1])


@query("a09_trace_summary", "with e as (select model_id, map_from_entries(list((endpoint, c) order by endpoint)) as by_endpoint, cast(sum(c) as bigint) as n from (select model_id, endpoint, count(*) as c from requests group by all) group by model_id) select e.model_id, cast(by_endpoint as json)::varchar as by_endpoint, n, round(err, 6) as error_rate from e join (select model_id, avg(case when success then 0 else 1 end) as err from requests group by model_id) r using (model_id)")
def trace_summary(spark, sf_dir):
    rows = requests(spark, sf_dir)
    parts = rows.groupBy("model_id", "endpoint").agg(F.count("*").alias("c"), F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("e"))
    return parts.groupBy("model_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", "c"))))).alias("by_endpoint"), F.sum("c").alias("n"), F.round(F.sum("e") / F.sum("c"), 6).alias("error_rate"))


@query("a10_service_map", "with s as (select *, lag(endpoint) over (partition by user_id order by epoch_s, request_id) as parent from requests) select parent, endpoint as child, count(*) as calls, round(avg(latency_ms), 6) as latency from s where parent is not null group by all")
def service_map(spark, sf_dir):
    from pyspark.sql import Window

    spans = requests(spark, sf_dir).withColumn("parent", F.lag("endpoint").over(Window.partitionBy("user_id").orderBy("epoch_s", "request_id")))
    return spans.where("parent is not null").groupBy("parent", F.col("endpoint").alias("child")).agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("latency"))


@query("a11_traffic_share", "select model_id, count(*) as n, round(count(*)::double / (select count(*) from requests), 6) as share from requests group by model_id")
def traffic_share(spark, sf_dir):
    by_model = requests(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"))
    total = by_model.agg(F.sum("n").alias("_all"))  # one row
    return by_model.crossJoin(F.broadcast(total)).select("model_id", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query(
    "a12_cost_projection",
    """with d as (select model_id, epoch_s // 86400 as day, sum(cost_usd) as c from requests group by all), f as (select model_id, regr_slope(c, day) as s, regr_intercept(c, day) as i, max(day) as top, sqrt(greatest(0, regr_syy(c, day) - regr_slope(c, day) * regr_sxy(c, day)) / nullif(count(*) - 2, 0)) as e from d group by model_id)
    select model_id, round(i + s * (top + 7), 4) as projected, round(i + s * (top + 7) - 1.96 * e, 4) as low, round(i + s * (top + 7) + 1.96 * e, 4) as high from f""",
)
def cost_projection(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy("model_id", F.floor(F.col("epoch_s") / 86400).alias("day")).agg(F.sum("cost_usd").alias("c"))
    c, day = F.col("c"), F.col("day")
    slope, n = F.regr_slope(c, day), F.count("*")
    error = F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(c, day) - slope * F.regr_sxy(c, day)) / F.when(n > 2, n - 2))
    fit = daily.groupBy("model_id").agg((F.regr_intercept(c, day) + slope * (F.max("day") + 7)).alias("p"), error.alias("e"))
    return fit.select("model_id", F.round("p", 4).alias("projected"), F.round(F.col("p") - 1.96 * F.col("e"), 4).alias("low"), F.round(F.col("p") + 1.96 * F.col("e"), 4).alias("high"))
