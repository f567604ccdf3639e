"""Reports and rules that build on the other operators: monitors, alerts, catalogues, outcomes, feature windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..operators import decisions as X
from ..operators import selection as E
from ..operators import windows as W
from ..sources.tables import consumer_lag, feedback, read, requests
from .registry import query
from .selection_plans import CANDIDATES, candidates, summaries
from .window_plans import SUMMARY, SUMMARY_SQL, rounded

c = F.col


@query("s10_consumer_lag", "select event_type as topic, cast(sum(top - mine) as bigint) as lag, max(top - mine) as worst_partition_lag, count(*) as partitions from (select event_type, user_id % 4 as p, max(event_id) as mine from events group by all), (select max(event_id) as top from events) group by event_type", views=False)
def lag(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    progress = events.groupBy(c("event_type").alias("topic"), (c("user_id") % 4).alias("partition")).agg(F.max("event_id").alias("committed"))
    latest = events.agg(F.max("event_id").alias("latest"))
    return consumer_lag(progress.crossJoin(F.broadcast(latest)))


@query("a13_routing_summary", "with r as (select *, lag(model_id) over (partition by user_id order by epoch_s, request_id) as before from requests) select model_id, case when before is null then 'first' when before = model_id then 'stay' else 'switch' end as reason, count(*) as n, round(avg(case when success then 0 else 1 end), 6) as fallback_rate from r group by all")
def routing(spark, sf_dir):
    before = F.lag("model_id").over(Window.partitionBy("user_id").orderBy("epoch_s", "request_id"))
    reason = F.when(c("before").isNull(), "first").when(c("before") == c("model_id"), "stay").otherwise("switch")
    return requests(spark, sf_dir).withColumn("before", before).groupBy("model_id", reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(c("success"), 0).otherwise(1)), 6).alias("fallback_rate"))


@query("e15_variants", "with b as (select model_id, 0.7::double as temperature from (select distinct model_id from requests)), v as (select unnest([-0.9, -0.3, 0.0, 0.6, 1.9])::double as d) select model_id, d as step, round(greatest(0, least(2, temperature + d)), 6) as temperature, temperature + d between 0 and 2 as valid from b, v")
def variants(spark, sf_dir):
    base = requests(spark, sf_dir).select("model_id").distinct().withColumn("t", F.lit(0.7))
    steps = spark.createDataFrame([(-0.9,), (-0.3,), (0.0,), (0.6,), (1.9,)], "step double")
    raw = c("t") + c("step")
    return base.crossJoin(F.broadcast(steps)).select("model_id", "step", F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), raw)), 6).alias("temperature"), raw.between(0, 2).alias("valid"))


@query(
    "e16_spacing",
    f"with {CANDIDATES}, f as (select * from p a where not exists (select 1 from p b where b.quality >= a.quality and b.cost <= a.cost and b.latency <= a.latency and (b.quality > a.quality or b.cost < a.cost or b.latency < a.latency))), d as (select a.id, min(sqrt((a.quality - b.quality) ** 2 + (a.cost - b.cost) ** 2 + ((a.latency - b.latency) / 5000) ** 2)) as d from f a join f b on a.id <> b.id group by a.id) select count(*) as n, round(stddev_pop(d), 6) as spacing from d",
    views=False,
)
def spacing(spark, sf_dir):
    front = E.skyline(candidates(spark, sf_dir), "id", ["quality"], ["cost", "latency"])
    a, b = front.alias("a"), front.alias("b")  # a frontier is small
    far = F.sqrt((c("a.quality") - c("b.quality")) ** 2 + (c("a.cost") - c("b.cost")) ** 2 + ((c("a.latency") - c("b.latency")) / 5000) ** 2)
    near = a.join(F.broadcast(b), c("a.id") != c("b.id")).groupBy(c("a.id")).agg(F.min(far).alias("d"))
    return near.agg(F.count("*").alias("n"), F.round(F.stddev_pop("d"), 6).alias("spacing"))


@query("e17_catalogue", "select s_suppkey as model, n_name as provider, case when s_acctbal > 5000 then 'large' when s_acctbal > 0 then 'medium' else 'small' end as tier, round((s_acctbal::double / 1e6 + 0.001) * 1.5, 8) as cost_per_call from supplier join nation on s_nationkey = n_nationkey where s_acctbal > -500 and n_name in ('FRANCE', 'GERMANY', 'BRAZIL')", views=False)
def catalogue(spark, sf_dir):
    tier = F.when(c("s_acctbal") > 5000, "large").when(c("s_acctbal") > 0, "medium").otherwise("small")
    models = read(spark, sf_dir, "supplier").where("s_acctbal > -500").join(read(spark, sf_dir, "nation").where(c("n_name").isin("FRANCE", "GERMANY", "BRAZIL")), c("s_nationkey") == c("n_nationkey"))
    return models.select(c("s_suppkey").alias("model"), c("n_name").alias("provider"), tier.alias("tier"), F.round((c("s_acctbal").cast("double") / 1e6 + 0.001) * 1.5, 8).alias("cost_per_call"))


@query("e18_best_config_per_task", "with s as (select r.endpoint as task, r.model_id as config, count(*) as n, avg(rating) as reward from requests r join feedback f on r.request_id = f.request_id group by all having count(*) >= 5) select task, arg_max(config, (round(reward, 9), config)) as config, round(max(reward), 6) as reward from s group by task")
def best_config(spark, sf_dir):
    s = requests(spark, sf_dir).join(feedback(spark, sf_dir).select("request_id", "rating"), "request_id").groupBy(c("endpoint").alias("task"), c("model_id").alias("config")).agg(F.count("*").alias("n"), F.avg("rating").alias("reward")).where("n >= 5")
    return s.groupBy("task").agg(F.max_by("config", F.struct(F.round("reward", 9), "config")).alias("config"), F.round(F.max("reward"), 6).alias("reward"))


MONITOR = """with w as (select request_id, model_id, latency_ms as x, avg(latency_ms) over f as m, stddev_pop(latency_ms) over f as sd, count(*) over f as n from requests window f as (partition by model_id order by request_id rows between 49 preceding and current row)),
  z as (select *, case when n >= 3 and sd > 0 then abs(x - m) / sd else 0 end as z from w)"""


@query("n18_threshold_monitor", MONITOR + " select request_id, 'violation' as kind, 'critical' as severity from z where x > 4000 union all select request_id, 'near limit', 'warning' from z where x > 3600 and not x > 4000 union all select request_id, 'anomaly', case when least(1, z / 3 - 1) > 0.7 then 'critical' else 'warning' end from z where z > 3")
def monitor(spark, sf_dir):
    scored = N.rolling_z(requests(spark, sf_dir).select("request_id", "model_id", "latency_ms"), "model_id", ["request_id"], "latency_ms", 50, 3.0)
    x = c("latency_ms")
    alert = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    found = F.array_compact(F.array(alert(x > 4000, "violation", F.lit("critical")), alert((x > 3600) & ~(x > 4000), "near limit", F.lit("warning")), alert(c("is_anomaly"), "anomaly", F.when(c("severity") > 0.7, "critical").otherwise("warning"))))
    return scored.select("request_id", F.explode(found).alias("a")).select("request_id", "a.*")


@query("z09_alert_rules", "with w as (select epoch_s // 21600 as slot, avg(case when success then 0 else 1 end) as e, quantile_cont(latency_ms, 0.99) as p99, count(*) as n from requests group by all), f as (select slot, 'error rate' as rule, e > 0.25 as f from w union all select slot, 'p99 latency', p99 > 2500 from w union all select slot, 'low traffic', n < 3 from w), r as (select *, sum(case when f then 0 else 1 end) over (partition by rule order by slot rows unbounded preceding) as run from f) select rule, min(slot) as started, max(slot) as ended, count(*) as n from r where f group by rule, run having count(*) >= 2")
def alert_rules(spark, sf_dir):
    w = requests(spark, sf_dir).groupBy(F.floor(c("epoch_s") / 21600).alias("slot")).agg(F.avg(F.when(c("success"), 0).otherwise(1)).alias("e"), F.percentile("latency_ms", 0.99).alias("p99"), F.count("*").alias("n"))
    rules = w.select("slot", F.expr("stack(3, 'error rate', e > 0.25, 'p99 latency', p99 > 2500, 'low traffic', n < 3) as (rule, firing)"))
    return N.islands(rules, "rule", ["slot"], "firing").where("n >= 2")


@query(
    "z10_report_summary",
    """with s as (select model_id, quantile_cont(latency_ms, 0.95) as p95, count(*) / nullif(max(epoch_s) - min(epoch_s), 0)::double as rps, avg(success::int) as ok from requests group by model_id),
    i as (select case when p95 > 5000 then 'critical' when p95 > 1000 then 'warning' end as severity from s union all select case when rps > 0 and rps < 1 then 'info' end from s union all select case when ok < 0.9 then 'error' when ok < 0.95 then 'warning' end from s)
    select severity, count(*) as n from i where severity is not null group by severity""",
)
def report(spark, sf_dir):
    return X.insights(summaries(spark, sf_dir), "model_id", X.performance_rules()).groupBy("severity").agg(F.count("*").alias("n"))


@query("z11_collective_anomaly", MONITOR + ", a as (select z.*, r.epoch_s from z join requests r using (request_id) where z > 3), k as (select request_id, epoch_s, count(*) over (partition by model_id order by epoch_s range between 86400 preceding and current row) as together from a) select request_id, together, together >= 2 as collective from k")
def collective(spark, sf_dir):
    rows = requests(spark, sf_dir).select("request_id", "model_id", "latency_ms", "epoch_s")
    odd = N.rolling_z(rows, "model_id", ["request_id"], "latency_ms", 50, 3.0).where("is_anomaly")
    together = F.count("*").over(Window.partitionBy("model_id").orderBy("epoch_s").rangeBetween(-86400, 0))
    return odd.select("request_id", together.alias("together")).withColumn("collective", c("together") >= 2)


@query("x10_decision_outcomes", "select model_id, count(*) as decisions, count(*) filter (where success) as succeeded, count(*) filter (where not success) as rolled_back, round(sum(cost_usd) filter (where success), 6) as saved, round(var_samp(latency_ms), 3) as latency_variance from requests group by model_id")
def outcomes(spark, sf_dir):
    ok = c("success")
    return requests(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("decisions"), F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~ok, 1)).alias("rolled_back"), F.round(F.sum(F.when(ok, c("cost_usd"))), 6).alias("saved"), F.round(F.var_samp("latency_ms"), 3).alias("latency_variance"))


@query("x11_impact_variance", "with b as (select model_id, avg(latency_ms) as l from requests where epoch_s < 1705000000 group by model_id), a as (select model_id, avg(latency_ms) as l from requests where epoch_s >= 1705000000 group by model_id) select model_id, round(b.l * 0.9, 6) as expected, round(a.l, 6) as actual, round((a.l - b.l * 0.9) / (b.l * 0.9) * 100, 6) as variance_pct from b join a using (model_id)")
def impact(spark, sf_dir):
    rows = requests(spark, sf_dir)
    before = rows.where("epoch_s < 1705000000").groupBy("model_id").agg((F.avg("latency_ms") * 0.9).alias("e"))
    after = rows.where("epoch_s >= 1705000000").groupBy("model_id").agg(F.avg("latency_ms").alias("a"))
    return before.join(after, "model_id").select("model_id", F.round("e", 6).alias("expected"), F.round("a", 6).alias("actual"), F.round((c("a") - c("e")) / c("e") * 100, 6).alias("variance_pct"))


@query("x12_promotion_verdict", "with d as (select model_id, epoch_s // 86400 as day, count(*) as n, avg(success::int) as s from requests group by all), f as (select *, s < 0.75 as failed from d), r as (select *, sum(case when failed then 0 else 1 end) over (partition by model_id order by day rows unbounded preceding) as run from f), k as (select model_id, day, n, s, failed, count(*) filter (where failed) over (partition by model_id, run order by day rows unbounded preceding) as failures from r) select model_id, day, failures, case when failures >= 2 then 'rollback' when n >= 3 and s >= 0.8 then 'promote' else 'hold' end as verdict from k")
def promotion(spark, sf_dir):
    d = requests(spark, sf_dir).groupBy("model_id", F.floor(c("epoch_s") / 86400).alias("day")).agg(F.count("*").alias("n"), F.avg(c("success").cast("double")).alias("s"))
    run = F.sum(F.when(c("s") < 0.75, 0).otherwise(1)).over(Window.partitionBy("model_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    failures = F.count(F.when(c("s") < 0.75, 1)).over(Window.partitionBy("model_id", "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    k = d.withColumn("run", run).withColumn("failures", failures)
    return k.select("model_id", "day", "failures", F.when(c("failures") >= 2, "rollback").when((c("n") >= 3) & (c("s") >= 0.8), "promote").otherwise("hold").alias("verdict"))


@query("f04_window_features", f"select model_id, time_bucket(interval '5 minutes', event_time, timestamp '1970-01-01') as window_start, time_bucket(interval '5 minutes', event_time, timestamp '1970-01-01') + interval '5 minutes' as window_end, {SUMMARY_SQL} from requests group by all")
def window_features(spark, sf_dir):
    return rounded(W.window_aggregate(requests(spark, sf_dir), ["model_id"], W.tumbling("event_time", "5 minutes"), SUMMARY))
