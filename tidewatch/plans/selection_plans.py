"""Experiments, selection, analyzers and decisions over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import sql_normal_cdf
from ..operators import decisions as X
from ..operators import ordered as O
from ..operators import selection as E
from ..sources.tables import feedback, read, requests
from .registry import query
from .window_plans import rounded

c = F.col
JOINED = "j as (select r.*, f.rating, f.task_completed, f.retry_occurred, f.dwell_time_seconds from requests r join feedback f on r.request_id = f.request_id)"


def rated(spark, sf_dir):
    return requests(spark, sf_dir).join(feedback(spark, sf_dir).drop("event_time", "epoch_s", "user_id"), "request_id")


@query("e01_variant_rollup", f"with {JOINED} select variant, count(*) as n, count(*) filter (where task_completed) as conversions, round(avg(rating), 6) as rating, round(avg(cost_usd) + 1e-9, 6) as cost, round(avg(latency_ms), 6) as latency from j group by variant")
def variant_rollup(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("variant").agg(F.count("*").alias("n"), F.count(F.when(c("task_completed"), 1)).alias("conversions"), F.round(F.avg("rating"), 6).alias("rating"), F.round(F.avg("cost_usd") + 1e-9, 6).alias("cost"), F.round(F.avg("latency_ms"), 6).alias("latency"))


@query(
    "e02_two_proportion_test",
    f"""with a as (select model_id, count(*) filter (where variant = 'control')::double as n1, count(*) filter (where variant = 'control' and success)::double as c1, count(*) filter (where variant = 'treatment')::double as n2, count(*) filter (where variant = 'treatment' and success)::double as c2 from (select *, model_id as m from (select request_id, success, endpoint as model_id, case when user_id % 2 = 0 then 'control' else 'treatment' end as variant from requests)) group by model_id having n1 > 0 and n2 > 0),
    r as (select *, c1 / n1 as p1, c2 / n2 as p2, (c1 + c2) / (n1 + n2) as p from a), z as (select *, case when p * (1 - p) > 0 then (p2 - p1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) else 0 end as z, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as se from r)
    select model_id as endpoint, n1::bigint as n1, c1::bigint as c1, n2::bigint as n2, c2::bigint as c2, round(p1, 6) as rate_1, round(p2, 6) as rate_2, round(z, 6) as z, round(2 * (1 - {sql_normal_cdf('abs(z)')}), 6) as p_value, round(p2 - p1 - 1.96 * se, 6) as low, round(p2 - p1 + 1.96 * se, 6) as high, round(2 * (asin(sqrt(p2)) - asin(sqrt(p1))), 6) as effect,
    case when 2 * (1 - {sql_normal_cdf('abs(z)')}) < 0.05 and n1 >= 20 and n2 >= 20 then case when p2 > p1 then '2' else '1' end end as winner from z""",
)
def two_proportions(spark, sf_dir):
    one = F.col("user_id") % 2 == 0
    arms = requests(spark, sf_dir).groupBy("endpoint").agg(F.count(F.when(one, 1)).alias("n1"), F.count(F.when(one & c("success"), 1)).alias("c1"), F.count(F.when(~one, 1)).alias("n2"), F.count(F.when(~one & c("success"), 1)).alias("c2")).where("n1 > 0 and n2 > 0")
    return rounded(E.two_proportions(arms, least=20).drop("power"))


def sql_quantile(p: str) -> str:
    """The rational approximation of the normal quantile as SQL, for p of at least one half."""
    t = f"sqrt(-2 * ln(1 - {p}::double))"
    return f"({t} - (2.515517::double + 0.802853::double * {t} + 0.010328::double * {t} * {t}) / (1 + 1.432788::double * {t} + 0.189269::double * {t} * {t} + 0.001308::double * {t} * {t} * {t}))"


@query("e03_sample_size", f"with r as (select endpoint, avg((latency_ms < 1000)::int) as base from requests group by endpoint) select endpoint, round(base, 6) as base, ceil(({sql_quantile('0.975')} + {sql_quantile('0.8')}) ** 2 * 2 * (base + 0.01) * (1 - base - 0.01) / 0.0004::double)::bigint as per_arm from r where base > 0 and base < 0.95")
def sample_size(spark, sf_dir):
    rates = requests(spark, sf_dir).groupBy("endpoint").agg(F.avg((c("latency_ms") < 1000).cast("double")).alias("base"))
    return rates.where("base > 0 and base < 0.95").select("endpoint", F.round("base", 6).alias("base"), E.sample_size(c("base"), F.lit(0.02), F.lit(0.05), F.lit(0.8)).cast("long").alias("per_arm"))


@query("e04_assignment", "with h as (select request_id, ('0x' || substr(md5(user_id::varchar), 1, 8))::bigint % 100 as h from requests) select request_id, case when h < 50 then 'a' when h < 80 then 'b' else 'c' end as variant from h")
def assignment(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", E.assigned(c("user_id"), [("a", 50), ("b", 30), ("c", 20)]).alias("variant"))


@query(
    "e05_reward",
    f"""with {JOINED}, i as (select *, least(1, greatest(0, 0.5 + case when task_completed then 0.3 else 0 end - case when retry_occurred then 0.4 else 0 end + case when dwell_time_seconds between 10 and 120 then 0.2 when dwell_time_seconds < 3 then -0.2 else 0 end))::double as implicit from j),
    r as (select request_id, (0.6 * (rating / 5 + implicit) / 2 + 0.3 * (1 - least(1, cost_usd / 0.01)) + 0.1 * (1 - least(1, latency_ms / 5000))) * case when rating / 5 < 0.3 or retry_occurred then 0.8 else 1 end as reward from i) select request_id, round(reward, 6) as reward from r""",
)
def reward(spark, sf_dir):
    rows = rated(spark, sf_dir)
    return rows.select("request_id", F.round(E.reward(c("rating"), c("task_completed"), c("retry_occurred"), c("dwell_time_seconds"), c("rating") / 5, c("cost_usd"), c("latency_ms")), 6).alias("reward"))


@query("e06_beta_arms", "with a as (select model_id, count(*) as n, sum(success::int)::bigint as wins from requests group by model_id), p as (select *, (wins + 1) / (n + 2)::double as m, sqrt((wins + 1) * (n - wins + 1) / ((n + 2)::double ** 2 * (n + 3))) as s from a), b as (select *, max(m) over () - m as r from p) select model_id, n, wins, round(m, 6) as mean, round(m - 1.96 * s, 6) as low, round(m + 1.96 * s, 6) as high, round(r * n, 6) as regret, n >= 100 and r < 0.05 as converged from b")
def beta_arms(spark, sf_dir):
    return rounded(E.beta_arms(requests(spark, sf_dir), "model_id", "success"))


FEATURES = ["one", "size", "late"]


def contexts(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "model_id", F.lit(1.0).alias("one"), (c("prompt_tokens") / 1000).alias("size"), (F.hour("event_time") / 24).alias("late"), c("success").cast("double").alias("r"))


LINUCB_SQL = """with x as (select request_id, model_id, 1.0::double as x0, prompt_tokens / 1000.0::double as x1, hour(event_time) / 24.0::double as x2, success::int::double as r from requests),
    s as (select model_id, 1 + sum(x0 * x0) as a, sum(x0 * x1) as b, sum(x0 * x2) as c, 1 + sum(x1 * x1) as d, sum(x1 * x2) as e, 1 + sum(x2 * x2) as f, sum(x0 * r) as u, sum(x1 * r) as v, sum(x2 * r) as w from x group by model_id),
    g as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from s),
    i as (select model_id, u, v, w, (d * f - e * e) / det as i00, (c * e - b * f) / det as i01, (b * e - c * d) / det as i02, (a * f - c * c) / det as i11, (b * c - a * e) / det as i12, (a * d - b * b) / det as i22 from g),
    t as (select *, i00 * u + i01 * v + i02 * w as t0, i01 * u + i11 * v + i12 * w as t1, i02 * u + i12 * v + i22 * w as t2 from i),
    p as (select x.request_id, t.model_id, t0 * x0 + t1 * x1 + t2 * x2 + sqrt(greatest(0, i00 * x0 * x0 + i11 * x1 * x1 + i22 * x2 * x2 + 2 * (i01 * x0 * x1 + i02 * x0 * x2 + i12 * x1 * x2))) as score from x, t)"""


@query("e08_linucb_choice", LINUCB_SQL + " select request_id, arg_max(model_id, (round(score, 9), model_id)) as choice, round(max(score), 6) as score from p group by request_id")
def linucb(spark, sf_dir):
    rows = contexts(spark, sf_dir)
    return rounded(E.linucb_choice(rows.drop("model_id", "r"), "request_id", FEATURES, E.linucb(rows, "model_id", FEATURES, "r", 1.0), "model_id", 1.0))


@query("e09_ucb1", "with a as (select model_id, count(*) as n, avg(success::int) as m from requests group by model_id) select model_id, n, round(m + sqrt(2 * ln(sum(n) over ()) / n), 6) as ucb from a")
def ucb(spark, sf_dir):
    arms = requests(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"), F.avg(c("success").cast("double")).alias("m"))
    return rounded(E.ucb1(arms, "model_id", "m", "n").select("model_id", "n", "ucb"))


CANDIDATES = "p as (select p_partkey as id, 1 - (p_partkey % 97) / 97::double as quality, p_retailprice::double / 10000 as cost, (p_size * 100 + p_partkey % 7)::double as latency from part)"


def candidates(spark, sf_dir):
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), (1 - (c("p_partkey") % 97) / F.lit(97.0)).alias("quality"), (c("p_retailprice").cast("double") / 10000).alias("cost"), (c("p_size") * 100 + c("p_partkey") % 7).cast("double").alias("latency"))


@query("e10_skyline", f"with {CANDIDATES} select id, round(quality, 6) as quality, round(cost, 6) as cost, latency from p a where not exists (select 1 from p b where b.quality >= a.quality and b.cost <= a.cost and b.latency <= a.latency and (b.quality > a.quality or b.cost < a.cost or b.latency < a.latency))", views=False)
def skyline(spark, sf_dir):
    return rounded(E.skyline(candidates(spark, sf_dir), "id", ["quality"], ["cost", "latency"]))


@query("e11_composite_score", f"with {CANDIDATES}, s as (select id, 0.5 * quality + 0.3 * greatest(0, 1 - cost / 0.1) + 0.2 * greatest(0, 1 - latency / 5000) as s from p) select id, round(s, 6) as score, row_number() over (order by round(s, 6) desc, id) as place from s order by score desc, id limit 25", views=False)
def composite(spark, sf_dir):
    from pyspark.sql import Window

    best = candidates(spark, sf_dir).select("id", F.round(E.composite_score(c("quality"), c("cost"), c("latency"), (0.5, 0.3, 0.2)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # 25 rows


@query("e12_hypervolume", f"with {CANDIDATES}, f as (select * from p a where not exists (select 1 from p b where b.quality >= a.quality and b.cost <= a.cost and b.latency <= a.latency and (b.quality > a.quality or b.cost < a.cost or b.latency < a.latency))), t as (select *, coalesce(max(cost) over (order by quality desc, cost rows between unbounded preceding and 1 preceding), 0) as top from f) select round(sum(greatest(0, 1 - top) * quality), 6) as volume from t", views=False)
def volume(spark, sf_dir):
    return rounded(E.hypervolume(E.skyline(candidates(spark, sf_dir), "id", ["quality"], ["cost", "latency"]), "cost", "quality", 1.0))


@query("e13_parameter_grid_best", "with g as (select t::double / 4 as temperature, 0.5 + p::double * 0.25 as top_p from range(5) a(t), range(3) b(p)), q as (select avg(latency_ms) as m from requests) select temperature, top_p, round(m / 1000 * (1 - abs(temperature - 0.5)) * top_p, 6) as score from g, q")
def parameter_grid(spark, sf_dir):
    mean = requests(spark, sf_dir).agg(F.avg("latency_ms").alias("m"))
    points = E.grid(spark, {"temperature": (0.0, 1.0, 5), "top_p": (0.5, 1.0, 3)})
    return points.crossJoin(F.broadcast(mean)).select("temperature", "top_p", F.round(c("m") / 1000 * (1 - F.abs(c("temperature") - 0.5)) * c("top_p"), 6).alias("score"))


@query("e14_config_statistics", f"with {JOINED}, s as (select model_id, endpoint, count(*) as n, avg(rating) as r, avg(success::int) as ok from j group by all) select model_id, endpoint, n, round(r, 6) as reward, round(ok, 6) as success_rate, row_number() over (partition by model_id order by r desc, endpoint) as place from s where n >= 2")
def configs(spark, sf_dir):
    from pyspark.sql import Window

    s = rated(spark, sf_dir).groupBy("model_id", "endpoint").agg(F.count("*").alias("n"), F.avg("rating").alias("r"), F.avg(c("success").cast("double")).alias("ok")).where("n >= 2")
    return s.select("model_id", "endpoint", "n", F.round("r", 6).alias("reward"), F.round("ok", 6).alias("success_rate"), F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("r"), "endpoint")).alias("place"))


def summaries(spark, sf_dir):
    rows = requests(spark, sf_dir)
    span = F.max("epoch_s") - F.min("epoch_s")
    rates = rows.groupBy("model_id").agg((F.count("*") / F.when(span > 0, span)).alias("rps"), F.avg(c("success").cast("double")).alias("success"))
    return rates.join(O.percentiles(rows, ["model_id"], "latency_ms", {"p95": 0.95}), "model_id")


@query(
    "z01_performance_insights",
    """with s as (select model_id, quantile_cont(latency_ms, 0.95) as p95, count(*) / nullif(max(epoch_s) - min(epoch_s), 0)::double as rps, avg(success::int) as ok from requests group by model_id),
    i as (select model_id, 'high latency' as title, case when p95 > 5000 then 'critical' when p95 > 1000 then 'warning' end as severity, p95 as v from s union all select model_id, 'low throughput', case when rps > 0 and rps < 1 then 'info' end, rps from s union all select model_id, 'low success rate', case when ok < 0.9 then 'error' when ok < 0.95 then 'warning' end, ok from s)
    select model_id, title, severity, round(v, 6) as value, case severity when 'info' then 0 when 'warning' then 1 when 'error' then 2 else 3 end as level from i where severity is not null""",
)
def performance(spark, sf_dir):
    return rounded(X.insights(summaries(spark, sf_dir), "model_id", X.performance_rules()))


@query("z02_cost_budget", "with d as (select epoch_s // 86400 as day, sum(cost_usd) as cost from requests group by all) select day, round(cost, 6) as cost, case when cost >= 0.9 * 0.25 then 'critical' when cost >= 0.8 * 0.25 then 'warning' end as severity, round(sum(cost) over (order by day), 6) as running from d")
def cost_budget(spark, sf_dir):
    from pyspark.sql import Window

    d = requests(spark, sf_dir).groupBy(F.floor(c("epoch_s") / 86400).alias("day")).agg(F.sum("cost_usd").alias("cost"))
    running = F.sum("cost").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return d.select("day", F.round("cost", 6).alias("cost"), F.when(c("cost") >= 0.9 * 0.25, "critical").when(c("cost") >= 0.8 * 0.25, "warning").alias("severity"), F.round(running, 6).alias("running"))


@query("z03_cheaper_model", "with m as (select model_id, avg(cost_usd) as cost, count(*) as n from requests group by model_id) select a.model_id as dear, b.model_id as cheap, round(a.cost - b.cost, 8) as saving, a.n > 100 as worth_caching from (select * from m order by cost desc, model_id limit 1) a, (select * from m order by cost, model_id limit 1) b")
def cheaper(spark, sf_dir):
    m = requests(spark, sf_dir).groupBy("model_id").agg(F.avg("cost_usd").alias("cost"), F.count("*").alias("n"))
    ends = m.agg(F.max(F.struct("cost", "model_id", "n")).alias("a"), F.min(F.struct("cost", "model_id")).alias("b"))
    return ends.select(c("a.model_id").alias("dear"), c("b.model_id").alias("cheap"), F.round(c("a.cost") - c("b.cost"), 8).alias("saving"), (c("a.n") > 100).alias("worth_caching"))


@query("z04_quality", "select r.model_id, round(avg(case when success then 0 else 1 end) * 100, 6) as error_pct, case when avg(case when success then 0 else 1 end) >= 0.05 then 'critical' when avg(case when success then 0 else 1 end) >= 0.01 then 'warning' end as severity, round(avg(f.rating), 6) as rating, avg(f.rating) < 4 as low_rating, count(*) filter (where f.rating >= 4) as positive, count(*) filter (where f.rating < 3) as negative from requests r left join feedback f on r.request_id = f.request_id group by r.model_id having count(*) >= 10")
def quality(spark, sf_dir):
    j = requests(spark, sf_dir).join(feedback(spark, sf_dir).select("request_id", "rating"), "request_id", "left")
    error = F.avg(F.when(c("success"), 0).otherwise(1))
    out = j.groupBy("model_id").agg(F.round(error * 100, 6).alias("error_pct"), F.when(error >= 0.05, "critical").when(error >= 0.01, "warning").alias("severity"), F.round(F.avg("rating"), 6).alias("rating"), (F.avg("rating") < 4).alias("low_rating"), F.count(F.when(c("rating") >= 4, 1)).alias("positive"), F.count(F.when(c("rating") < 3, 1)).alias("negative"), F.count("*").alias("_n"))
    return out.where("_n >= 10").drop("_n")


@query("z05_traffic_pattern", "with h as (select hour(event_time) as h, count(*) as n from requests group by all) select h as hour, n, n > 1.5 * (select avg(n) from h) as peak, n > 0 and n < 0.5 * (select avg(n) from h) as low from h")
def pattern(spark, sf_dir):
    h = requests(spark, sf_dir).groupBy(F.hour("event_time").alias("hour")).agg(F.count("*").alias("n"))
    mean = h.agg(F.avg("n").alias("_m"))
    return h.crossJoin(F.broadcast(mean)).select("hour", "n", (c("n") > 1.5 * c("_m")).alias("peak"), ((c("n") > 0) & (c("n") < 0.5 * c("_m"))).alias("low"))


@query("z06_bursts", "with m as (select epoch_s // 3600 as t, count(*) as n from requests group by all), f as (select *, avg(n) over (order by t rows between 10 preceding and 1 preceding) as a from m) select t, n, round(a, 6) as moving from f where n > 2 * a")
def bursts(spark, sf_dir):
    from pyspark.sql import Window

    m = requests(spark, sf_dir).groupBy(F.floor(c("epoch_s") / 3600).alias("t")).agg(F.count("*").alias("n"))
    w = Window.orderBy("t").rowsBetween(-10, -1)  # one row an hour
    return m.withColumn("moving", F.avg("n").over(w)).where("n > 2 * moving").select("t", "n", F.round("moving", 6).alias("moving"))


@query("z07_top_endpoints", "select endpoint, count(*) as n, round(count(*) * 100 / (select count(*) from requests)::double, 6) as share from requests group by endpoint order by n desc, endpoint limit 3")
def top_endpoints(spark, sf_dir):
    n = requests(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("endpoint", "n", F.round(c("n") * 100 / c("_all"), 6).alias("share")).orderBy(F.desc("n"), "endpoint").limit(3)


@query("z08_volume_anomaly", "with d as (select model_id, epoch_s // 86400 as day, count(*) as n from requests group by all), b as (select *, avg(n) over (partition by model_id order by day rows between 7 preceding and 1 preceding) as base from d) select model_id, day, n, round((n - base) / base * 100, 6) as change, case when abs(n - base) / base > 1 then 'critical' when abs(n - base) / base > 0.75 then 'error' else 'warning' end as severity from b where abs(n - base) / base > 0.5")
def volume_anomaly(spark, sf_dir):
    from pyspark.sql import Window

    d = requests(spark, sf_dir).groupBy("model_id", F.floor(c("epoch_s") / 86400).alias("day")).agg(F.count("*").alias("n"))
    b = d.withColumn("_b", F.avg("n").over(Window.partitionBy("model_id").orderBy("day").rowsBetween(-7, -1)))
    part = F.abs(c("n") - c("_b")) / c("_b")
    return b.where(part > 0.5).select("model_id", "day", "n", F.round((c("n") - c("_b")) / c("_b") * 100, 6).alias("change"), F.when(part > 1, "critical").when(part > 0.75, "error").otherwise("warning").alias("severity"))


@query("x01_rate_limit_factor", "with m as (select model_id, avg(case when success then 0 else 1 end) as e, sum(cost_usd) / 2.0::double as b, stddev_pop(latency_ms) / avg(latency_ms) as v from requests group by model_id) select model_id, round(least(1.2, greatest(0.8, case when e > 0.1 then 0.7 when e > 0.05 then 0.85 when e > 0.02 then 0.95 else 1.1 end * case when b > 1 then 0.8 when b > 0.8 then 0.9 else 1.15 end * case when v > 0.5 then 1.05 else 1 end))::double, 6) as factor from m")
def rate_limit(spark, sf_dir):
    m = requests(spark, sf_dir).groupBy("model_id").agg(F.avg(F.when(c("success"), 0).otherwise(1)).alias("e"), (F.sum("cost_usd") / 2.0).alias("b"), (F.stddev_pop("latency_ms") / F.avg("latency_ms")).alias("v"))
    return rounded(m.select("model_id", X.rate_limit_factor(c("e"), c("b"), c("v")).alias("factor")))


@query("x02_batch_size", "with m as (select endpoint, count(*) * 60 / ((max(epoch_s) - min(epoch_s)) / 60.0::double) as pm, avg(latency_ms) as l from requests group by endpoint) select endpoint, cast(greatest(1, least(floor(pm / 60 * 30), floor(10000 / l), 64)) as bigint) as batch from m")
def batch(spark, sf_dir):
    m = requests(spark, sf_dir).groupBy("endpoint").agg((F.count("*") * 60 / ((F.max("epoch_s") - F.min("epoch_s")) / 60.0)).alias("pm"), F.avg("latency_ms").alias("l"))
    return m.select("endpoint", X.batch_size(c("pm"), 30.0, F.lit(10000.0), c("l"), 1, 64).cast("long").alias("batch"))


@query("x03_caching_clusters", "with g as (select model_id, endpoint, prompt_tokens // 100 as band, count(*) as n, stddev_pop(prompt_tokens) / avg(prompt_tokens) as cv, sum(prompt_tokens) as t from requests group by all), s as (select *, 0.8 + case when cv < 0.1 then 0.2 when cv < 0.3 then 0.1 else 0 end as sim from g) select model_id, endpoint, band, n, round(sim::double, 6) as similarity, round(least(95, 50 * sim + 30 * least(n / 100::double, 1) + 20 * least(n / 10::double, 1))::double, 6) as hit_rate, round(t * (1 - 1 / n::double), 6) as tokens_saved from s")
def caching(spark, sf_dir):
    return rounded(X.caching_clusters(requests(spark, sf_dir), ["model_id", "endpoint"], "prompt_tokens", 100))


@query("x04_phrase_savings", "with p as (select * from (values ('the', 1), ('that the', 1), ('of the', 1)) v(phrase, w)) select phrase, sum((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase))::bigint as occurrences, count(*) filter (where contains(lower(text), phrase)) as texts, (sum((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase)) * any_value(w))::bigint as words_saved from documents, p group by phrase", views=False)
def phrases(spark, sf_dir):
    dim = spark.createDataFrame([("the", 1), ("that the", 1), ("of the", 1)], "phrase string, words_saved int")
    return X.phrase_savings(read(spark, sf_dir, "documents"), "text", dim).withColumn("words_saved", c("words_saved").cast("long"))


@query("x05_merge_decisions", "with p as (select epoch_s // 86400 as cycle, request_id as id, case request_id % 4 when 0 then 'model_switch' when 1 then 'optimize_prompt' when 2 then 'cache' else 'batch' end as type, latency_ms as priority from requests where success), r as (select *, row_number() over (partition by cycle order by priority desc, id) as place from p) select a.cycle, a.id, a.type, a.place from r a where a.place = 1 or (a.place = 2 and not exists (select 1 from r b where b.cycle = a.cycle and b.place = 1 and (b.type = a.type or (b.type = 'model_switch' and a.type = 'optimize_prompt') or (b.type = 'optimize_prompt' and a.type = 'model_switch'))))")
def merge(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["model_switch", "optimize_prompt", "cache", "batch"])), (c("request_id") % 4 + 1).cast("int"))
    p = requests(spark, sf_dir).select(F.floor(c("epoch_s") / 86400).alias("cycle"), c("request_id").alias("id"), kind.alias("type"), c("latency_ms").alias("priority"), c("success").alias("enabled"))
    return X.merge_decisions(p, "cycle", 2)


@query(
    "x06_token_bucket",
    """with recursive r as (select *, row_number() over (partition by user_id order by epoch_s, request_id) as k from requests),
    w as (select user_id, request_id, epoch_s, k, 2.0::double as level from r where k = 1 union all
      select r.user_id, r.request_id, r.epoch_s, r.k, least(2.0::double, w.level - case when w.level >= 1 then 1 else 0 end + (r.epoch_s - w.epoch_s) * (1.0::double / 43200)) from w join r on r.user_id = w.user_id and r.k = w.k + 1)
    select user_id, request_id, level >= 1 as passed from w""",
)
def bucket(spark, sf_dir):
    return X.token_bucket(requests(spark, sf_dir), "user_id", "epoch_s", "request_id", 1 / 43200, 2.0)


@query(
    "x07_budget_walk",
    """with recursive r as (select model_id, epoch_s // 86400 as day, request_id, cost_usd as x, row_number() over (partition by model_id, epoch_s // 86400 order by request_id) as k from requests),
    w as (select model_id, day, cast(0 as bigint) as k, null::bigint as request_id, 0.0::double as spent, '' as action from r where k = 1 union all
      select model_id, day, k, request_id, spent + case action when 'accept' then x when 'downgrade' then x / 2 else 0 end, action from (
        select r.*, w.spent, case when x > 0.009::double or w.spent + x / 2 > 0.05::double then 'reject' when w.spent + x > 0.05::double then 'downgrade' else 'accept' end as action from w join r on r.model_id = w.model_id and r.day = w.day and r.k = w.k + 1))
    select model_id, day, request_id, action from w where k > 0""",
)
def budget(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("day", F.floor(c("epoch_s") / 86400))
    return X.budget_walk(rows, ["model_id", "day"], "request_id", "cost_usd", 0.05, 0.009)


@query(
    "x08_canary_verdict",
    f"""with a as (select endpoint, count(*) filter (where variant = 'control')::double as n1, avg(success::int) filter (where variant = 'control') as s1, avg(latency_ms) filter (where variant = 'control') as l1, var_pop(latency_ms) filter (where variant = 'control') as v1, count(*) filter (where variant = 'treatment')::double as n2, avg(success::int) filter (where variant = 'treatment') as s2, avg(latency_ms) filter (where variant = 'treatment') as l2, var_pop(latency_ms) filter (where variant = 'treatment') as v2 from requests group by endpoint),
    z as (select endpoint, n1, n2, (s2 - s1) / greatest(sqrt(s1 * (1 - s1) / n1 + s2 * (1 - s2) / n2), 1e-4) as zs, (l2 - l1) / nullif(sqrt(v1 / n1 + v2 / n2), 0) as zl from a)
    select endpoint, round(zs, 5) as z_success, round(zl, 5) as z_latency, case when n1 < 10 or n2 < 10 then 'too few' when 2 * (1 - {sql_normal_cdf('abs(zs)')}) < 0.05 and zs < 0 then 'rollback' when 2 * (1 - {sql_normal_cdf('abs(zl)')}) < 0.05 and zl > 0 then 'rollback' else 'promote' end as verdict from z""",
)
def canary(spark, sf_dir):
    from ..functions.stats import two_sided_p

    arm = lambda v, x: F.when(c("variant") == v, x)
    ok, ms = c("success").cast("double"), c("latency_ms")
    parts = [f(arm(v, x)).alias(f"{n}{i}") for i, v in ((1, "control"), (2, "treatment")) for n, f, x in (("n", F.count, ms), ("s", F.avg, ok), ("l", F.avg, ms), ("v", F.var_pop, ms))]
    a = requests(spark, sf_dir).groupBy("endpoint").agg(*parts)
    zs = (c("s2") - c("s1")) / F.greatest(F.sqrt(c("s1") * (1 - c("s1")) / c("n1") + c("s2") * (1 - c("s2")) / c("n2")), F.lit(1e-4))
    se = F.sqrt(c("v1") / c("n1") + c("v2") / c("n2"))
    z = a.withColumn("zs", zs).withColumn("zl", (c("l2") - c("l1")) / F.when(se != 0, se))
    worse = ((two_sided_p(c("zs")) < 0.05) & (c("zs") < 0)) | ((two_sided_p(c("zl")) < 0.05) & (c("zl") > 0))
    verdict = F.when((c("n1") < 10) | (c("n2") < 10), "too few").when(worse, "rollback").otherwise("promote")
    return z.select("endpoint", F.round("zs", 5).alias("z_success"), F.round("zl", 5).alias("z_latency"), verdict.alias("verdict"))


@query("x09_health_checks", "with m as (select model_id, count(*) as n, avg(success::int) as s, quantile_cont(latency_ms, 0.95) as p95, quantile_cont(latency_ms, 0.99) as p99 from requests group by model_id) select model_id, 'success' as name, s >= 0.8 as passed from m union all select model_id, 'p95', p95 <= 3000 from m union all select model_id, 'p99', p99 <= 4000 from m union all select model_id, 'samples', n >= 100 from m")
def health(spark, sf_dir):
    rows = requests(spark, sf_dir)
    m = rows.groupBy("model_id").agg(F.count("*").alias("n"), F.avg(c("success").cast("double")).alias("s")).join(O.percentiles(rows, ["model_id"], "latency_ms", {"p95": 0.95, "p99": 0.99}), "model_id")
    return m.select("model_id", F.expr("stack(4, 'success', s >= 0.8, 'p95', p95 <= 3000, 'p99', p99 <= 4000, 'samples', n >= 100) as (name, passed)"))
