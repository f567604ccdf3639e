"""Confirmed anomalies, threshold monitors with drift, alert rules with their states, and patterns over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, decisions, ordered, patterns
from ..sources.tables import feedback, requests
from .registry import query

c = F.col
LETTER = "case when not success then 'E' when latency_ms < 300 then 'A' when latency_ms < 1000 then 'B' when latency_ms < 2500 then 'C' else 'D' end"
#: Each pattern as it is written here, and as a regular expression over letters.
PATTERNS = {"A B+ C": "AB+C", "A B+ C? (D|E)": "AB+C?(D|E)", "(A|B){2,3} (C|D)+?": "[AB]{2,3}(C|D)+?"}


@query(
    "j07_row_patterns",
    f"""with s as (select model_id, string_agg({LETTER}, '' order by request_id) as t, list(request_id order by request_id) as ids from requests group by model_id),
    p as ({" union all ".join(f"select '{name}' as pattern, model_id, ids, regexp_replace(t, '{regex}', '<\\0>', 'g') as t from s" for name, regex in PATTERNS.items())}),
    ch as (select pattern, model_id, ids, i, t[i] as x, t from (select *, unnest(range(1, len(t) + 1)) as i from p)),
    n as (select *, sum(case when x = '<' then 1 else 0 end) over w as opened, sum(case when x = '>' then 1 else 0 end) over w as closed from ch window w as (partition by pattern, model_id order by i rows unbounded preceding))
    select pattern, model_id, opened::bigint as match_no, count(*) as n, min(ids[(i - opened - closed)::bigint]) as first_id, max(ids[(i - opened - closed)::bigint]) as last_id, string_agg(x, '' order by i) as symbols, count(*) filter (where x = 'B') as bs from n where x not in ('<', '>') and opened > closed group by pattern, model_id, opened""",
)
def row_patterns(spark, sf_dir):
    rows = requests(spark, sf_dir).select("model_id", "request_id", F.expr(LETTER).alias("letter"))
    found = None
    for name in PATTERNS:
        matched = patterns.match_rows(rows, "model_id", ["request_id"], {s: c("letter") == s for s in "ABCDE"}, name).withColumn("pattern", F.lit(name))
        found = matched if found is None else found.unionByName(matched)
    symbols = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("match_row", "symbol"))), lambda s: s["symbol"]))  # the rows of one match
    return found.groupBy("pattern", "model_id", "match_no").agg(F.count("*").alias("n"), F.min("request_id").alias("first_id"), F.max("request_id").alias("last_id"), symbols.alias("symbols"), F.count(F.when(c("symbol") == "B", 1)).alias("bs"))


SCORED = """select model_id, request_id, epoch_s, kind, v, case when n > 1 and sd > 1e-9 then (v - m) / sd else 0 end as z, n from (
  select *, avg(v) over w as m, stddev_samp(v) over w as sd, count(*) over w as n from values_of window w as (partition by kind, model_id order by request_id rows between 999 preceding and current row))"""


@query(
    "z24_confirmed_anomalies",
    f"""with values_of as (select model_id, request_id, epoch_s, 'latency' as kind, latency_ms as v from requests union all select model_id, request_id, epoch_s, 'cost', cost_usd from requests), z as ({SCORED}),
    o as (select *, n >= 30 and abs(z) > 2 as odd from z), g as (select *, sum(case when odd then 0 else 1 end) over (partition by kind, model_id order by request_id rows unbounded preceding) as calm from o),
    r as (select *, row_number() over (partition by kind, model_id, calm order by request_id) - case when calm = 0 then 0 else 1 end as run from g),
    k as (select model_id, epoch_s, kind, abs(z) as z, case when abs(z) > 5 then 3 when abs(z) > 4 then 2 else 1 end as level, greatest(0.6, least(1, abs(z) / 5)) * greatest(0.7, least(1, run / 4.0::double)) as confidence from r where odd and run >= 2),
    c as (select *, count(*) over w as near, max(level) over w as top from k window w as (partition by model_id order by epoch_s range between 7200 preceding and current row)),
    v as (select model_id, epoch_s // 21600 as slot, count(*) as n from requests group by all), b as (select *, avg(n) over (partition by model_id order by slot rows between 30 preceding and 1 preceding) as base from v), vol as (select model_id, abs(n - base) / base as part from b where abs(n - base) / base > 0.5),
    e as (select model_id, epoch_s // 86400 as day, avg(case when success then 0 else 1 end) as rate from requests group by all having rate > 0.05),
    a as (select model_id, kind, level, z as score, confidence from k union all select model_id, 'collective', top, near, 0.85 from c where near >= 3 union all select model_id, 'volume', case when part > 1 then 3 when part > 0.75 then 2 else 1 end, part * 10, null from vol union all select model_id, 'errors', case when rate > 0.2 then 3 when rate > 0.1 then 2 else 1 end, rate * 10, null from e)
    select model_id, kind, level::int as level, count(*) as n, round(max(score), 4)::double as top_score, round(avg(confidence), 6)::double as confidence from a group by all""",
)
def confirmed_anomalies(spark, sf_dir):
    """Two deviations in place of the default three, so that the given values have runs of outliers."""
    rows = requests(spark, sf_dir).select("model_id", "request_id", "epoch_s", "latency_ms", "cost_usd", "success")
    both = rows.select("model_id", "request_id", "epoch_s", F.expr("stack(2, 'latency', latency_ms, 'cost', cost_usd) as (kind, v)")).withColumn("scope", F.concat_ws("/", "model_id", "kind"))
    found = alerts.confirmed_outliers(both, "scope", ["request_id"], "v", threshold=2.0).where("level is not null")
    single = found.select("model_id", "epoch_s", "kind", "level", F.abs("z").alias("score"), "confidence")
    together = alerts.collective_anomalies(single, "model_id", "epoch_s", "level", within=7200).select("model_id", F.lit("collective").alias("kind"), "level", c("n").cast("double").alias("score"), "confidence")
    none = F.lit(None).cast("double").alias("confidence")
    volume = alerts.volume_anomalies(rows, "model_id", "epoch_s", seconds=21600).select("model_id", F.lit("volume").alias("kind"), "level", (F.abs("change") * 10).alias("score"), none)
    rate = rows.groupBy("model_id", F.floor(c("epoch_s") / 86400).alias("day")).agg(F.avg(F.when(c("success"), 0).otherwise(1)).alias("rate"))
    errors = rate.select("model_id", F.lit("errors").alias("kind"), alerts.level_above(c("rate"), 0.05, 0.1, 0.2).alias("level"), (c("rate") * 10).alias("score"), none).where("level is not null")
    every = single.drop("epoch_s").unionByName(together).unionByName(volume).unionByName(errors)
    return every.groupBy("model_id", "kind", "level").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("top_score"), F.round(F.avg("confidence"), 6).alias("confidence"))


RUNNING = "partition by model_id order by request_id rows unbounded preceding"
LAST = "partition by model_id order by request_id rows between 49 preceding and current row"


@query(
    "n22_monitor_with_drift",
    f"""with b as (select model_id, request_id, latency_ms as x, cost_usd as y, first_value(cost_usd) over ({RUNNING}) as y0 from requests),
    s as (select *, sum(y - y0 - 0.005::double) over ({RUNNING}) as ph, sum(x - 1000 - 0.05::double) over ({RUNNING}) as up, sum(1000 - x - 0.05::double) over ({RUNNING}) as down, avg(x) over ({LAST}) as xm, stddev_pop(x) over ({LAST}) as xs, avg(y) over ({LAST}) as ym, stddev_pop(y) over ({LAST}) as ys, count(*) over ({LAST}) as n from b),
    t as (select *, ph - least(0, min(ph) over ({RUNNING})) as ph_now, up - least(0, min(up) over ({RUNNING})) as up_now, down - least(0, min(down) over ({RUNNING})) as down_now, case when n >= 3 and xs > 0 then abs(x - xm) / xs else 0 end as xz, case when n >= 3 and ys > 0 then abs(y - ym) / ys else 0 end as yz from s),
    a as (select model_id, 'latency' as metric, 'threshold' as kind, case when x < 0 or x > 3000 then 3 when x > 2400 then 1 end as level from t union all select model_id, 'cost', 'threshold', case when y < 0 or y > 0.009 then 3 when y > 0.0072 then 1 end from t
      union all select model_id, 'latency', 'drift', case when greatest(up_now, down_now) > 5000 then 3 when greatest(up_now, down_now) > 3500 then 1 end from t union all select model_id, 'cost', 'drift', case when ph_now > 0.02 then 3 when ph_now > 0.014 then 1 end from t
      union all select model_id, 'latency', 'anomaly', case when xz > 2.5 then case when least(1, xz / 2.5 - 1) > 0.7 then 3 else 1 end end from t union all select model_id, 'cost', 'anomaly', case when yz > 3 then case when least(1, yz / 3 - 1) > 0.7 then 3 else 1 end end from t)
    select model_id, metric, kind, level, count(*) as n from a where level is not null group by all""",
)
def monitor_with_drift(spark, sf_dir):
    """The presets for latency and cost, with drift limits in the measure of the given values."""
    rows = requests(spark, sf_dir).select("model_id", "request_id", "latency_ms", "cost_usd")
    latency = alerts.threshold_alerts(rows, "model_id", ["request_id"], "latency_ms", alerts.latency_limits(3000.0), cusum=(1000.0, 0.1, 5000.0)).withColumn("metric", F.lit("latency"))
    cost = alerts.threshold_alerts(rows, "model_id", ["request_id"], "cost_usd", alerts.cost_limits(0.009), page_hinkley=(0.02, 0.005)).withColumn("metric", F.lit("cost"))
    columns = ["model_id", "metric", "kind", "level"]
    return latency.select(columns).unionByName(cost.select(columns)).groupBy(columns).agg(F.count("*").alias("n"))


SLOT = 10_800  # seconds
HOURS = 3600


#: When the states are looked at.
NOW = 1_705_300_000


@query(
    "z25_alert_states",
    f"""with w as (select model_id, epoch_s // {SLOT} * {SLOT} as t, 100 * avg(case when success then 0 else 1 end) as errors, percentile_cont(0.99) within group (order by latency_ms) as p99, count(*) as n, sum(prompt_tokens + completion_tokens) as tokens from requests group by all),
    f as (select model_id, t, 'error rate' as rule, errors > 5 as f, 3 as level, {6 * HOURS} as hold_s from w union all select model_id, t, 'p99 latency', p99 > 1000, 3, {6 * HOURS} from w union all select model_id, t, 'low throughput', n < 3, 1, 0 from w union all select model_id, t, 'tokens', tokens >= 3000, 1, {3 * HOURS} from w),
    s as (select *, lead(t) over (partition by model_id, rule order by t) as next_t, sum(case when f then 0 else 1 end) over (partition by model_id, rule order by t rows unbounded preceding) as run from f),
    g as (select model_id, rule, level, hold_s, run, min(t) as started, max(t) as last_met, arg_max(coalesce(next_t, -1), t) as after, count(*) as n from s where f group by all),
    e as (select *, nullif(after, -1) as ended, after between 0 and {NOW} as over from g where started <= {NOW}), h as (select *, case when (case when over then last_met else least(last_met, {NOW}) end) - started >= hold_s then started + hold_s end as fired_at from e),
    k as (select * from h where fired_at is not null or not over), acks as (select r.model_id, f.epoch_s as t from feedback f join requests r on f.request_id = r.request_id where f.rating = 1), quiet as (select model_id from requests group by model_id, epoch_s // 86400 having count(*) % 2 = 0 and any_value(epoch_s) // 86400 = {NOW} // 86400)
    select model_id, rule, level, started, last_met, ended, n, fired_at, case when over then 'resolved' when fired_at is null then 'pending' when rule in ('p99 latency', 'tokens') and model_id in (select model_id from quiet) then 'silenced' when exists (select 1 from acks a where a.model_id = k.model_id and a.t between k.fired_at and {NOW}) then 'acknowledged' else 'firing' end as state from k""",
)
def alert_states(spark, sf_dir):
    """A model's bad ratings acknowledge its alerts, its days with an even number of requests silence two rules."""
    rows = requests(spark, sf_dir).withColumn("t", F.floor(c("epoch_s") / SLOT) * SLOT)
    tails = ordered.percentiles(rows, ["model_id", "t"], "latency_ms", {"p99": 0.99})
    slots = rows.groupBy("model_id", "t").agg((100 * F.avg(F.when(c("success"), 0).otherwise(1))).alias("errors"), F.count("*").alias("n"), F.sum(c("prompt_tokens") + c("completion_tokens")).alias("tokens")).join(tails.drop("n"), ["model_id", "t"])
    rules = [alerts.Rule("error rate", c("errors"), ">", 5, 6 * HOURS, 3), alerts.Rule("p99 latency", c("p99"), ">", 1000, 6 * HOURS, 3), alerts.Rule("low throughput", c("n"), "<", 3, 0, 1), alerts.Rule("tokens", c("tokens"), ">=", 3000, 3 * HOURS, 1)]
    spans = alerts.alert_spans(alerts.rule_samples(slots, "model_id", "t", rules), "model_id", "t")
    marks = feedback(spark, sf_dir).where("rating = 1").select("request_id", c("epoch_s").alias("at")).join(rows.select("request_id", "model_id"), "request_id")
    acks = marks.select(F.lit(None).cast("string").alias("rule"), "model_id", "at")
    days = rows.groupBy("model_id", (F.floor(c("epoch_s") / 86400) * 86400).alias("starts")).agg(F.count("*").alias("k")).where("k % 2 = 0")
    silences = days.select(F.explode(F.array(F.lit("p99 latency"), F.lit("tokens"))).alias("rule"), "model_id", "starts", (c("starts") + 86400).alias("ends"))
    return alerts.alert_states(spans, "model_id", NOW, silences, acks).drop("hold_s")


_PARTS = ", ".join(f"percentile_cont({p}) within group (order by latency_ms) as {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))


@query(
    "z26_performance_report",
    f"""with recursive r as materialized (select model_id, latency_ms, row_number() over (partition by model_id order by request_id) as k, count(*) over (partition by model_id) as n from requests),
    w as (select model_id, k, n, latency_ms as ema from r where k = 1 union all select r.model_id, r.k, r.n, 0.3::double * r.latency_ms + 0.7::double * w.ema from w join r on r.model_id = w.model_id and r.k = w.k + 1),
    m as (select model_id, count(*) as n, {_PARTS}, count(*) / (max(epoch_s) - min(epoch_s))::double as rps, avg(success::int) as success from requests group by model_id), b as (select model_id, percentile_cont(0.95) within group (order by latency_ms) as base from requests where request_id < 100 group by model_id),
    s as (select m.*, w.ema, (p95 - base) / base as change from m join b using (model_id) join w on w.model_id = m.model_id and w.k = w.n),
    i as (select *, case when p95 > 5000 then 'critical' when p95 > 1000 then 'warning' end as high_latency, case when rps > 0 and rps < 1 then 'info' end as low_throughput, case when success < 0.9 then 'error' when success < 0.95 then 'warning' end as low_success, case when change > 0.5 then 'critical' when change > 0.2 then 'warning' end as regression from s)
    select model_id, n, round(p50, 6) as p50, round(p90, 6) as p90, round(p95, 6) as p95, round(p99, 6) as p99, round(p999, 6) as p999, round(rps, 9) as rps, round(success, 6) as success, round(ema, 6) as ema, high_latency, low_throughput, low_success, regression from i""",
)
def performance_report(spark, sf_dir):
    """All requests against the first hundred, with the rule for regressions."""
    rows = requests(spark, sf_dir).select("model_id", "request_id", "epoch_s", "latency_ms", "success")
    summary = alerts.performance_summary(rows, "model_id", ["request_id"], "epoch_s", "latency_ms", "success")
    base = ordered.percentiles(rows.where("request_id < 100"), ["model_id"], "latency_ms", {"base_p95": 0.95})
    joined = summary.join(base, "model_id")
    titles = {"high latency": "high_latency", "low throughput": "low_throughput", "low success rate": "low_success", "latency regression": "regression"}
    levels = [severity.alias(titles[title]) for title, severity, _ in decisions.performance_rules(c("base_p95"))]
    numbers = [F.round(x, 9 if x == "rps" else 6).alias(x) for x in ("p50", "p90", "p95", "p99", "p999", "rps", "success", "ema")]
    return joined.select("model_id", "n", *numbers, *levels)


@query(
    "x23_model_switches",
    f"""with r as (select r.*, f.rating from requests r left join feedback f on f.request_id = r.request_id), p as (select endpoint, model_id as model, count(*) as n, avg(success::int) as success, avg(cost_usd) as cost, avg(latency_ms) as latency, coalesce(avg(rating), 3.5) as quality from r group by all),
    s as (select *, 0.4::double * (0.02::double - least(cost, 0.02::double)) / 0.02::double + 0.3::double * (5000 - least(latency, 5000)) / 5000 + 0.3::double * quality / 5 as score from p),
    f as (select * from s x where not exists (select 1 from s y where y.endpoint = x.endpoint and y.model <> x.model and y.cost <= x.cost and y.latency <= x.latency and y.quality >= x.quality and (y.cost < x.cost or y.latency < x.latency or y.quality > x.quality))),
    b as (select * from f qualify row_number() over (partition by endpoint order by score desc, cost, latency, quality desc, model desc) = 1), u as (select endpoint, model_id as model, count(*) as k, max(epoch_s) as evaluated_at from requests where epoch_s < {NOW} group by all), c as (select * from u qualify row_number() over (partition by endpoint order by k desc, model) = 1),
    j as (select c.endpoint, c.model, b.model as best, b.score, b.cost - s.cost as cost_change, (b.cost - s.cost) / s.cost * 100 > 10 as dear, b.latency - s.latency > 100 as slow, b.quality < 2.5 as poor, {NOW} - c.evaluated_at < 3600 as soon, least(1, 0.5 * least(b.n / 1000.0::double, 1) + 0.5 * b.success) as confidence from c join s on s.endpoint = c.endpoint and s.model = c.model join b on b.endpoint = c.endpoint)
    select endpoint, model, best, round(score, 6)::double as score, round(cost_change, 9) as cost_change, concat_ws(',', case when dear then 'cost' end, case when slow then 'latency' end, case when poor then 'quality' end, case when soon then 'period' end) as failed, round(confidence, 6)::double as confidence, case when best = model then 'keep' when dear or slow or poor or soon then 'blocked' else 'switch' end as decision from j""",
)
def model_switches(spark, sf_dir):
    """By endpoint: the model used most before NOW, last looked at when it was last used."""
    rows = requests(spark, sf_dir)
    rated = rows.join(feedback(spark, sf_dir).select("request_id", "rating"), "request_id", "left")
    points = rated.groupBy("endpoint", c("model_id").alias("model")).agg(F.count("*").alias("n"), F.avg(c("success").cast("double")).alias("success"), F.avg("cost_usd").alias("cost"), F.avg("latency_ms").alias("latency"), F.coalesce(F.avg("rating"), F.lit(3.5)).alias("quality"))
    used = rows.where(c("epoch_s") < NOW).groupBy("endpoint", c("model_id").alias("model")).agg(F.count("*").alias("k"), F.max("epoch_s").alias("evaluated_at"))
    current = used.groupBy("endpoint").agg(F.min_by(F.struct("model", "evaluated_at"), F.struct(-c("k"), "model")).alias("u")).select("endpoint", "u.*")
    found = decisions.model_switches(points, current, "endpoint", NOW, decisions.SwitchLimits(cost_range=0.02, most_latency_ms=100.0, least_quality=2.5))
    return found.select("endpoint", "model", "best", F.round("score", 6).alias("score"), F.round("cost_change", 9).alias("cost_change"), F.concat_ws(",", "failed").alias("failed"), F.round("confidence", 6).alias("confidence"), "decision")
