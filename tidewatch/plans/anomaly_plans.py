"""Detectors over the telemetry views; recursive statistics have their closed forms on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import sql_normal_cdf
from ..operators import anomaly as N
from ..sources.tables import requests
from .registry import query
from .window_plans import rounded

c = F.col
BY = ("model_id", ["request_id"], "latency_ms")
FRAME = "partition by model_id order by request_id rows between {} preceding and current row"


def base(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "model_id", "latency_ms", "cost_usd", "epoch_s", "variant")


@query("n01_rolling_z", f"with s as (select request_id, latency_ms as x, avg(latency_ms) over w as m, stddev_pop(latency_ms) over w as sd, count(*) over w as n from requests window w as ({FRAME.format(49)})), z as (select *, case when n >= 3 and sd > 0 then abs(x - m) / sd else 0 end as z from s) select request_id, round(z, 6) as score, z > 3 as is_anomaly, round(case when z > 3 then least(1, z / 3 - 1) else 0 end, 6) as severity from z")
def rolling_z(spark, sf_dir):
    return rounded(N.rolling_z(base(spark, sf_dir), *BY, 50, 3.0).select("request_id", "score", "is_anomaly", "severity"))


@query("n02_expanding_z", "with s as (select request_id, latency_ms as x, avg(latency_ms) over w as m, stddev_samp(latency_ms) over w as sd from requests window w as (partition by model_id order by request_id rows between unbounded preceding and 1 preceding)), z as (select request_id, case when sd > 0 then (x - m) / sd end as z from s) select request_id, round(z, 6) as score, coalesce(abs(z) > 3, false) as is_anomaly from z")
def expanding_z(spark, sf_dir):
    return rounded(N.expanding_z(base(spark, sf_dir), *BY, 3.0).select("request_id", "score", "is_anomaly"))


@query(
    "n03_rolling_iqr",
    f"""with s as (select request_id, latency_ms as x, quantile_cont(latency_ms, 0.25) over w as q1, quantile_cont(latency_ms, 0.75) over w as q3, count(*) over w as n from requests window w as ({FRAME.format(39)})),
    o as (select *, q3 - q1 as iqr, case when x < q1 - 1.5 * (q3 - q1) then q1 - 1.5 * (q3 - q1) - x when x > q3 + 1.5 * (q3 - q1) then x - q3 - 1.5 * (q3 - q1) end as o from s)
    select request_id, round(case when n < 4 then 0 when o is not null then o / greatest(iqr, 0.001) else least(1, abs(x - (q1 + q3) / 2) / greatest(iqr / 2, 0.001)) end, 6) as score, n >= 4 and o is not null as is_anomaly from o""",
)
def rolling_iqr(spark, sf_dir):
    return rounded(N.rolling_iqr(base(spark, sf_dir), *BY, 40, 1.5).select("request_id", "score", "is_anomaly"))


@query(
    "n04_rolling_mad",
    f"""with s as (select request_id, latency_ms as x, list(latency_ms) over w as v from requests window w as ({FRAME.format(29)})), m as (select *, list_median(v) as m from s), d as (select *, list_median(list_transform(v, lambda y: abs(y - m))) as mad from m),
    z as (select request_id, case when len(v) >= 3 and mad > 0 then 1.4826::double * abs(x - m) / mad else 0 end as z from d) select request_id, round(z, 6) as score, z > 5 as is_anomaly from z""",
)
def rolling_mad(spark, sf_dir):
    return rounded(N.rolling_mad(base(spark, sf_dir), *BY, 30, 5.0).select("request_id", "score", "is_anomaly"))


@query(
    "n05_mahalanobis",
    f"""with s as (select request_id, latency_ms / 1000 as a, cost_usd * 1000 as b, avg(latency_ms / 1000) over w as ma, avg(cost_usd * 1000) over w as mb, var_pop(latency_ms / 1000) over w as va, var_pop(cost_usd * 1000) over w as vb, count(*) over w as n from requests window w as ({FRAME.format(49)})),
    d as (select request_id, case when n < 3 then 0 else sqrt((a - ma) ** 2 / greatest(va, 1e-4) + (b - mb) ** 2 / greatest(vb, 1e-4)) end as d from s) select request_id, round(d, 5) as score, d > 3 as is_anomaly from d""",
)
def mahalanobis(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("a", c("latency_ms") / 1000).withColumn("b", c("cost_usd") * 1000)
    return rounded(N.rolling_mahalanobis(rows, "model_id", ["request_id"], ["a", "b"], 50, 3.0).select("request_id", "score", "is_anomaly"), 5)


@query("n06_group_outliers", "with s as (select model_id, avg(latency_ms) as m, stddev_samp(latency_ms) as s, quantile_cont(latency_ms, 0.25) as q1, quantile_cont(latency_ms, 0.75) as q3 from requests group by model_id) select request_id, abs(latency_ms - m) > 3 * s as by_z, latency_ms < q1 - 1.5 * (q3 - q1) or latency_ms > q3 + 1.5 * (q3 - q1) as by_iqr, case when abs(latency_ms - m) > 3 * s and latency_ms > m then 'spike' when abs(latency_ms - m) > 3 * s then 'drop' end as kind from requests join s using (model_id)")
def group_outliers(spark, sf_dir):
    return N.group_outliers(base(spark, sf_dir), "model_id", "latency_ms").select("request_id", "by_z", "by_iqr", "kind")


@query(
    "n07_adwin",
    f"""with s as (select request_id, model_id, list(latency_ms / 1000) over w as v from requests window w as ({FRAME.format(39)})), k as (select request_id, v, len(v) as n, unnest(range(len(v) // 4, 3 * len(v) // 4 + 1)) as cut from s where len(v) >= 10),
    m as (select request_id, n, cut, list_avg(v[:cut]) as m1, list_avg(v[cut + 1:]) as m2, list_avg(list_transform(v[:cut], lambda x: x * x)) as q1, list_avg(list_transform(v[cut + 1:], lambda x: x * x)) as q2 from k),
    d as (select request_id, bool_or(abs(m1 - m2) > e or abs((q1 - m1 * m1) - (q2 - m2 * m2)) > e) as drift from (select *, sqrt(ln(4 + ln(n) / 0.002::double) * (1 / cut::double + 1 / (n - cut)::double) / 2) as e from m) group by request_id)
    select s.request_id, coalesce(drift, false) as is_drift from s left join d on s.request_id = d.request_id""",
)
def adwin(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("x", c("latency_ms") / 1000)
    return N.adwin(rows, "model_id", ["request_id"], "x", 0.002, 40).select("request_id", "is_drift")


RUNNING = "partition by model_id order by request_id rows between unbounded preceding and current row"


@query("n08_page_hinkley", f"with r as (select *, first_value(latency_ms) over ({RUNNING}) as ref from requests), s as (select *, sum(latency_ms - ref - 5) over ({RUNNING}) as s from r), h as (select *, s - least(0, min(s) over ({RUNNING})) as stat from s) select request_id, round(stat, 3) as score, stat > 5000 as is_drift, stat > 3500 and not stat > 5000 as is_warning from h")
def page_hinkley(spark, sf_dir):
    return rounded(N.page_hinkley(base(spark, sf_dir), *BY, 5000.0, 5.0).select("request_id", "score", "is_drift", "is_warning"), 3)


@query("n09_cusum", f"with s as (select *, sum(latency_ms - 1000 - 50) over ({RUNNING}) as u, sum(1000 - latency_ms - 50) over ({RUNNING}) as d from requests), h as (select *, u - least(0, min(u) over ({RUNNING})) as high, d - least(0, min(d) over ({RUNNING})) as low from s) select request_id, round(high, 3) as high, round(low, 3) as low, case when high > 5000 then 'up' when low > 5000 then 'down' end as direction from h")
def cusum(spark, sf_dir):
    return rounded(N.cusum(base(spark, sf_dir), *BY, 1000.0, 100.0, 5000.0).select("request_id", "high", "low", "direction"), 3)


@query(
    "n10_welch_drift",
    f"""with k as (select *, row_number() over (partition by model_id order by request_id) as k from requests), f as (select model_id, avg(latency_ms) as m0, var_samp(latency_ms) as v0, count(*) as n0 from k where k <= 30 group by model_id),
    w as (select *, avg(latency_ms) over w as m1, var_samp(latency_ms) over w as v1, count(*) over w as n1 from k window w as ({FRAME.format(29)})), z as (select request_id, (m1 - m0) / nullif(sqrt(v0 / n0 + v1 / n1), 0) as z from w join f using (model_id) where k >= 60), p as (select request_id, case when z is null then 1 else 2 * (1 - {sql_normal_cdf('abs(z)')}) end as p from z)
    select request_id, round(p, 6) as p_value, p < 0.05 as is_drift, p < 0.1 and not p < 0.05 as is_warning from p""",
)
def welch(spark, sf_dir):
    return rounded(N.welch_drift(base(spark, sf_dir), *BY, 30, 0.05).select("request_id", "p_value", "is_drift", "is_warning"))


@query("n11_population_stability", "with b as (select latency_ms from requests where epoch_s < 1705000000), s as (select min(latency_ms) as lo, max(latency_ms) as hi from b), n as (select least(floor((latency_ms - lo) / (hi - lo) * 10), 9) as bin, count(*) as n from requests, s where epoch_s >= 1705000000 and latency_ms between lo and hi group by 1), t as (select n / sum(n) over () as share from n) select round(sum((share - 0.1) * ln(share / 0.1)), 6) as psi from t")
def psi(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(N.population_stability(rows.where("epoch_s < 1705000000"), rows.where("epoch_s >= 1705000000"), "latency_ms"))


@query(
    "n12_kolmogorov_smirnov",
    """with v as (select model_id, latency_ms as x, count(*) filter (where variant = 'control' and epoch_s % 2 = 0 or variant = 'control' and epoch_s % 2 = 1 and false) as a0, count(*) filter (where epoch_s < 1705000000) as a, count(*) filter (where epoch_s >= 1705000000) as b from requests group by all),
    f as (select model_id, sum(a) over u / sum(a) over p as fa, sum(b) over u / sum(b) over p as fb, sum(a) over p as na, sum(b) over p as nb from v window u as (partition by model_id order by x rows unbounded preceding), p as (partition by model_id)),
    d as (select model_id, max(abs(fa - fb)) as d, max(na) as na, max(nb) as nb from f group by model_id) select model_id, round(d, 6) as d, round(least(1, 2 * exp(-2 * d * d * na * nb / (na + nb))), 6) as p_value from d""".replace("count(*) filter (where variant = 'control' and epoch_s % 2 = 0 or variant = 'control' and epoch_s % 2 = 1 and false) as a0, ", ""),
)
def ks(spark, sf_dir):
    return rounded(N.ks_statistic(base(spark, sf_dir), "model_id", c("epoch_s") < 1705000000, "latency_ms"))


@query("n13_mean_shift", "select model_id, round(avg(latency_ms) filter (where epoch_s < 1705000000), 6) as before, round(avg(latency_ms) filter (where epoch_s >= 1705000000), 6) as after, abs(avg(latency_ms) filter (where epoch_s >= 1705000000) - avg(latency_ms) filter (where epoch_s < 1705000000)) > 3 * stddev_samp(latency_ms) filter (where epoch_s < 1705000000) / sqrt(count(*) filter (where epoch_s >= 1705000000)) as shifted from requests group by model_id")
def mean_shift(spark, sf_dir):
    old, new = F.when(c("epoch_s") < 1705000000, c("latency_ms")), F.when(c("epoch_s") >= 1705000000, c("latency_ms"))
    s = base(spark, sf_dir).groupBy("model_id").agg(F.avg(old).alias("before"), F.avg(new).alias("after"), F.stddev_samp(old).alias("s"), F.count(new).alias("n"))
    return s.select("model_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), (F.abs(c("after") - c("before")) > 3 * c("s") / F.sqrt("n")).alias("shifted"))


@query("n14_chi_square", "with b as (select endpoint, count(*) filter (where epoch_s < 1705000000) as o0, count(*) filter (where epoch_s >= 1705000000) as o1 from requests group by endpoint), t as (select *, sum(o0) over () as t0, sum(o1) over () as t1 from b) select round(sum((o1 - t1 * o0 / t0::double) ** 2 / (t1 * o0 / t0::double)), 6) as chi_square, count(*) - 1 as freedom from t where o0 > 0")
def chi_square(spark, sf_dir):
    b = requests(spark, sf_dir).groupBy("endpoint").agg(F.count(F.when(c("epoch_s") < 1705000000, 1)).alias("o0"), F.count(F.when(c("epoch_s") >= 1705000000, 1)).alias("o1"))
    t = b.agg(F.sum("o0").alias("t0"), F.sum("o1").alias("t1"))
    e = c("t1") * c("o0") / c("t0")
    return b.crossJoin(F.broadcast(t)).where("o0 > 0").agg(F.round(F.sum((c("o1") - e) ** 2 / e), 6).alias("chi_square"), (F.count("*") - 1).alias("freedom"))


@query("n15_degradation", "with m as (select model_id, avg(case when epoch_s < 1705000000 then success::int end) as s0, avg(case when epoch_s >= 1705000000 then success::int end) as s1, avg(case when epoch_s < 1705000000 then latency_ms end) as l0, avg(case when epoch_s >= 1705000000 then latency_ms end) as l1 from requests group by model_id), d as (select model_id, greatest((s0 - s1) / s0, (l1 - l0) / l0) as w from m) select model_id, round(w, 6) as worst, case when w > 0.3 then 'severe' when w > 0.15 then 'moderate' when w > 0.05 then 'minor' else 'none' end as level from d")
def degradation(spark, sf_dir):
    old, ok = c("epoch_s") < 1705000000, c("success").cast("double")
    m = requests(spark, sf_dir).groupBy("model_id").agg(F.avg(F.when(old, ok)).alias("s0"), F.avg(F.when(~old, ok)).alias("s1"), F.avg(F.when(old, c("latency_ms"))).alias("l0"), F.avg(F.when(~old, c("latency_ms"))).alias("l1"))
    w = F.greatest((c("s0") - c("s1")) / c("s0"), (c("l1") - c("l0")) / c("l0"))
    return m.select("model_id", F.round(w, 6).alias("worst"), F.when(w > 0.3, "severe").when(w > 0.15, "moderate").when(w > 0.05, "minor").otherwise("none").alias("level"))


@query("n16_firing_alerts", "with d as (select model_id, epoch_s // 86400 as day, avg(case when success then 0 else 1 end) > 0.2 as f from requests group by all), r as (select *, sum(case when f then 0 else 1 end) over (partition by model_id order by day rows unbounded preceding) as run from d) select model_id, min(day) as started, max(day) as ended, count(*) as n from r where f group by model_id, run")
def firing(spark, sf_dir):
    d = requests(spark, sf_dir).groupBy("model_id", F.floor(c("epoch_s") / 86400).alias("day")).agg((F.avg(F.when(c("success"), 0).otherwise(1)) > 0.2).alias("f"))
    return N.islands(d, "model_id", ["day"], "f")


@query("n17_safety_bounds", "with m as (select model_id, avg(latency_ms) as latency, avg(cost_usd) as cost, avg(success::int) as success from requests group by model_id), l as (unpivot m on latency, cost, success into name metric value v), b as (select * from (values ('latency', 0, 800), ('cost', 0, 0.01), ('success', 0.9, 1)) x(metric, low, high)) select model_id, metric, round(v + 1e-9, 6) as v, case when v > high then 'above' else 'below' end as breach from l join b using (metric) where v > high or v < low")
def safety(spark, sf_dir):
    m = requests(spark, sf_dir).groupBy("model_id").agg(F.avg("latency_ms").alias("latency"), F.avg("cost_usd").alias("cost"), F.avg(c("success").cast("double")).alias("success"))
    long = m.select("model_id", F.expr("stack(3, 'latency', latency, 'cost', cost, 'success', success) as (metric, v)"))
    bounds = spark.createDataFrame([("latency", 0.0, 800.0), ("cost", 0.0, 0.01), ("success", 0.9, 1.0)], "metric string, low double, high double")
    return long.join(F.broadcast(bounds), "metric").where("v > high or v < low").select("model_id", "metric", F.round(c("v") + 1e-9, 6).alias("v"), F.when(c("v") > c("high"), "above").otherwise("below").alias("breach"))
