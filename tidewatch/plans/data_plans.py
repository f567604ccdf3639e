"""Row operators, deduplication, time series and joins over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, joins, rows, series
from ..sources.tables import encode_messages, feedback, read, requests
from .registry import query
from .window_plans import rounded

c = F.col


@query("k01_event_key", "select event_id, case when user_id % 4 = 0 then 'composite:model:' || event_type || ',session:' || event_id % 10 when user_id % 4 = 1 then 'model:' || event_type when user_id % 4 = 2 then 'session:' || event_id % 10 when user_id % 4 = 3 and user_id % 8 = 3 then 'user:' || user_id else 'event:' || event_id end as key from events")
def event_key(spark, sf_dir):
    r = c("user_id") % 4
    model, session = F.when(r.isin(0, 1), c("event_type")), F.when(r.isin(0, 2), (c("event_id") % 10).cast("string"))
    user = F.when((c("user_id") % 8) == 3, c("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", rows.event_key(model, session, user, c("event_id").cast("string")).alias("key"))


@query(
    "k02_context_features",
    """with x as (select event_id, cast(floor(value * 10) as bigint) as len, event_id % 11 as pr, hour(ts) as h, dayofweek(ts) as d, event_type from events)
    select event_id, round(least(ln(len + 1.0::double) / 10, 1), 6) as f1, case when len < 100 then 0 when len < 1000 then 0.5 else 1 end::double as f2, round(pr / 10.0::double, 6) as f3, round(cos(h * (2 * pi() / 24)), 6) as f4, round(sin(h * (2 * pi() / 24)), 6) as f5, round(cos(d * (2 * pi() / 7)), 6) as f6, round(sin(d * (2 * pi() / 7)), 6) as f7, 0.5::double as f8, 1::double as f9, 0::double as f10 from x""",
)
def context_features(spark, sf_dir):
    length = F.floor(c("value") * 10).cast("long")
    f = rows.context_features(length, c("event_id") % 11, F.hour("ts"), F.dayofweek("ts") - 1, c("event_type"))
    return rounded(read(spark, sf_dir, "events").select("event_id", f.alias("f")).select("event_id", *[c("f")[i].alias(f"f{i + 1}") for i in range(10)]))


@query(
    "k03_request_cost",
    """with p as (select * from (values ('model_a', 1, 0.01, 0.03), ('model_b', 2, 0.002, 0.004), ('model', 3, 0.001, 0.002)) v(pattern, rank, i, o)),
    b as (select model_id, arg_min(i, rank)::double as i, arg_min(o, rank)::double as o from (select distinct model_id from requests) join p on contains(model_id, pattern) group by model_id)
    select request_id, round(prompt_tokens / 1000::double * i + completion_tokens / 1000::double * o, 6) as price_cost, round(greatest(0, latency_ms - 1000) * 0.0001::double, 6) as penalty, latency_ms <= 1000 as in_sla from requests join b using (model_id)""",
)
def request_cost(spark, sf_dir):
    prices = spark.createDataFrame([("model_a", 1, 0.01, 0.03), ("model_b", 2, 0.002, 0.004), ("model", 3, 0.001, 0.002)], "pattern string, rank int, input_per_1k double, output_per_1k double")
    out = rows.priced(requests(spark, sf_dir), prices)
    return out.select("request_id", F.round("price_cost", 6).alias("price_cost"), F.round(F.greatest(F.lit(0.0), c("latency_ms") - 1000) * 0.0001, 6).alias("penalty"), (c("latency_ms") <= 1000).alias("in_sla"))


@query("k04_composite_quality", "select l_orderkey, l_linenumber, round((l_quantity / 50 * 0.4 + l_discount * 10 * 0.3 + l_tax * 10 * 0.2)::double / 0.9, 6) as quality from lineitem", views=False)
def composite_quality(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") / 50).cast("double").alias("accuracy"), (c("l_discount") * 10).cast("double").alias("relevance"), (c("l_tax") * 10).cast("double").alias("coherence"), F.lit(None).cast("double").alias("completeness"))
    return lines.select("l_orderkey", "l_linenumber", F.round(rows.weighted_quality({"accuracy": 0.4, "relevance": 0.3, "coherence": 0.2, "completeness": 0.1}), 6).alias("quality"))


@query("s01_table_query", "select request_id, model_id, latency_ms from requests where model_id in ('model_a', 'model_b') and latency_ms >= 100 and endpoint not in ('error') and endpoint like 'p%' order by latency_ms desc, request_id limit 50 offset 10")
def table_query(spark, sf_dir):
    q = rows.TableQuery([("model_id", "in", ["model_a", "model_b"]), ("latency_ms", ">=", 100), ("endpoint", "not in", ["error"]), ("endpoint", "like", "p%")], [("latency_ms", True), ("request_id", False)], 50, 10, ["request_id", "model_id", "latency_ms"])
    return rows.run_query(requests(spark, sf_dir), q)


UPSERT_SQL = """with base as (select user_id as key, max(value) as value, count(*) as version from events where event_id % 2 = 0 group by user_id),
  last as (select distinct on (user_id) user_id as key, case event_id % 3 when 0 then 'delete' else 'update' end as op, value as v, case when event_id % 5 = 0 then 1 end as expected from events where event_id % 2 = 1 order by user_id, event_id desc),
  m as (select coalesce(b.key, l.key) as key, b.value, b.version, l.op, l.v, l.expected, l.op is not null and l.expected is not null and not coalesce(b.version = l.expected, false) as clash from base b full join last l on b.key = l.key)"""


def upsert_input(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    base = events.where("event_id % 2 = 0").groupBy(c("user_id").alias("key")).agg(F.max("value").alias("value"), F.count("*").alias("version"))
    changes = events.where("event_id % 2 = 1").select(c("user_id").alias("key"), F.when(c("event_id") % 3 == 0, "delete").otherwise("update").alias("op"), "value", F.when(c("event_id") % 5 == 0, 1).alias("expected_version"), c("event_id").alias("order"))
    return rows.upsert(base, changes, "key", "order")


@query("s02_upsert", UPSERT_SQL + " select key, case when clash or op is null then value else v end as value, case when clash or op is null then version else coalesce(version, 0) + 1 end as version from m where (clash or op is null or op <> 'delete') and case when clash or op is null then version else coalesce(version, 0) + 1 end is not null", views=False)
def upsert(spark, sf_dir):
    return upsert_input(spark, sf_dir)[0]


@query("s03_upsert_rejects", UPSERT_SQL + " select key, op, version, expected as expected_version from m where clash", views=False)
def upsert_rejects(spark, sf_dir):
    return upsert_input(spark, sf_dir)[1]


@query("s04_counters", "select user_id as key, cast(sum(case when event_type = 'error' then -1 else 1 end) as bigint) as value from events group by user_id", views=False)
def counters(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(c("user_id").alias("key"), F.when(c("event_type") == "error", -1).otherwise(1).alias("delta"), "event_id")
    base = events.where("event_id % 2 = 0").groupBy("key").agg(F.sum("delta").alias("value"))
    return rows.add_counters(base, events.where("event_id % 2 = 1"), "key")


@query("s05_rate_limit", "select request_id, epoch_s - epoch_s % 86400 as bucket, row_number() over (partition by model_id, epoch_s - epoch_s % 86400 order by request_id) <= 5 as accepted from requests")
def rate_limit(spark, sf_dir):
    return rows.rate_limited(requests(spark, sf_dir), "model_id", "epoch_s", "request_id", 86400, 5).select("request_id", "bucket", "accepted")


@query("s06_backpressure", "with b as (select epoch_s - epoch_s % 86400 as bucket, count(*) as n from requests group by all) select bucket, n, round(n / 40::double, 6) as fill, case when n / 40::double >= 1 then 'full' when n / 40::double >= 0.9 then 'critical' when n / 40::double >= 0.7 then 'warning' else 'normal' end as level, greatest(n - 40, 0) as spilled from b")
def backpressure(spark, sf_dir):
    return rows.backpressure(requests(spark, sf_dir), "epoch_s", 86400, 40)


@query("s07_dead_letters", "select request_id, case when not success then 'failed' when latency_ms > 3000 then 'too_slow' else 'blank' end as reason, 0 as retry_count, cast(least(3600, pow(2, least(request_id % 15, 10))) as bigint) as delay from requests where not success or latency_ms > 3000")
def dead_letters(spark, sf_dir):
    dead = rows.split_valid(requests(spark, sf_dir), {"failed": c("success"), "too_slow": c("latency_ms") <= 3000, "blank": c("model_id") != ""})[1]
    return dead.select("request_id", "reason", "retry_count", rows.retry_delay(c("request_id") % 15).alias("delay"))


@query("s08_messages", "select cast(event_id as varchar) as key, 'events' as topic, cast(event_id % 4 as int) as partition, to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'props': props})::varchar as value from events", views=False)
def messages(spark, sf_dir):
    return encode_messages(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), "event_id", "events", 4, "round_robin", "event_id")


@query("s09_modified_and_expiring", "select request_id, epoch_s + 86400 as expires_at from requests where epoch_s >= 1705000000 and epoch_s + 86400 < 1706000000")
def modified(spark, sf_dir):
    return requests(spark, sf_dir).where("epoch_s >= 1705000000").select("request_id", (c("epoch_s") + 86400).alias("expires_at")).where("expires_at < 1706000000")


@query("d01_by_key_within_ttl", "with l as (select request_id, epoch_s - lag(epoch_s) over (partition by user_id, endpoint order by epoch_s, request_id) as gap from requests) select request_id, coalesce(gap < 86400, false) as is_duplicate from l")
def dedup_ttl(spark, sf_dir):
    return dedup.mark_duplicates(requests(spark, sf_dir), dedup.composite_key("user_id", "endpoint"), "epoch_s", "request_id", 86400).select("request_id", "is_duplicate")


@query("d02_by_content", "select doc_id, row_number() over (partition by lang, text order by doc_id) > 1 as is_duplicate from documents", views=False)
def dedup_content(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("_e", F.lit(0).cast("long"))
    return dedup.mark_duplicates(docs, dedup.content_hash(["text", "lang"]), "_e", "doc_id").select("doc_id", "is_duplicate")


@query("d03_time_bucketed", "select request_id, row_number() over (partition by user_id, endpoint, epoch_s // 86400 order by epoch_s, request_id) > 1 as is_duplicate from requests")
def dedup_bucketed(spark, sf_dir):
    key = dedup.time_bucketed(dedup.composite_key("user_id", "endpoint"), "epoch_s", 86400)
    return dedup.mark_duplicates(requests(spark, sf_dir), key, "epoch_s", "request_id").select("request_id", "is_duplicate")


@query(
    "d04_strategies",
    """with l as (select request_id, epoch_s - lag(epoch_s) over (partition by user_id, endpoint order by epoch_s, request_id) as g1, epoch_s - lag(epoch_s) over (partition by model_id, prompt_tokens order by epoch_s, request_id) as g2 from requests)
    select request_id, case when g1 < 3600 then 'user_type' when g2 < 864000 then 'tokens' end as matched from l""",
)
def strategies(spark, sf_dir):
    how = [("user_type", dedup.composite_key("user_id", "endpoint"), 3600), ("tokens", dedup.composite_key("model_id", "prompt_tokens"), 864000)]
    return dedup.by_strategies(requests(spark, sf_dir), how, "epoch_s", "request_id").select("request_id", "matched")


@query("d05_stats", "with l as (select model_id, coalesce(epoch_s - lag(epoch_s) over (partition by user_id order by epoch_s, request_id) < 86400, false) as d from requests) select model_id, count(*) as checked, count(*) filter (where d) as duplicates, round(avg(d::int), 6) as rate from l group by model_id")
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(dedup.mark_duplicates(requests(spark, sf_dir), c("user_id").cast("string"), "epoch_s", "request_id", 86400), "model_id")


HOURLY = "with h as (select model_id, epoch_s - epoch_s % 21600 as t, avg(latency_ms) as v, count(*) as n from requests group by all)"


def hourly(spark, sf_dir):
    return requests(spark, sf_dir).groupBy("model_id", (c("epoch_s") - c("epoch_s") % 21600).alias("t")).agg(F.avg("latency_ms").alias("v"), F.count("*").alias("n"))


@query(
    "t01_moving_statistics",
    HOURLY + " select model_id, t, round(avg(v) over w, 6) as mean, round(min(v) over w, 6) as low, round(max(v) over w, 6) as high, round(median(v) over w, 6) as mid, round(stddev_samp(v) over w, 6) as sd from h window w as (partition by model_id order by t rows between 9 preceding and current row)",
)
def moving(spark, sf_dir):
    w = series.rolling(["model_id"], ["t"], 10)
    return rounded(hourly(spark, sf_dir).select("model_id", "t", F.avg("v").over(w).alias("mean"), F.min("v").over(w).alias("low"), F.max("v").over(w).alias("high"), F.percentile("v", 0.5).over(w).alias("mid"), F.stddev_samp("v").over(w).alias("sd")))


EMA_SQL = """with recursive h as (select model_id, row_number() over (partition by model_id order by t) as k, t, v from (select model_id, epoch_s - epoch_s % 86400 as t, avg(latency_ms) as v from (REQUESTS) group by all)),
  e as (select model_id, k, t, v as ema from h where k = 1 union all select h.model_id, h.k, h.t, 0.3 * h.v + 0.7 * e.ema from h join e on h.model_id = e.model_id and h.k = e.k + 1) select model_id, t, round(ema, 6) as ema from e"""


def _requests_sql() -> str:
    from ..sources import tables

    return tables.REQUESTS.replace("{epoch}", tables.SQL_EPOCH).replace("{events}", "events")


@query("t02_exponential_average", EMA_SQL.replace("REQUESTS", _requests_sql()), views=False)
def exponential(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy("model_id", (c("epoch_s") - c("epoch_s") % 86400).alias("t")).agg(F.avg("latency_ms").alias("v"))
    lists = daily.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))  # one value a day
    ema = series.exponential_average(F.transform("s", lambda x: x["v"]), 0.3)
    both = lists.select("model_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["t"]).alias("t"), ema.alias("ema"))).alias("z"))
    return both.select("model_id", "z.t", F.round("z.ema", 6).alias("ema"))


@query(
    "t03_exponential_average_rows",
    """with recursive r as materialized (select model_id, request_id, latency_ms as x, row_number() over (partition by model_id order by request_id) as k from requests),
    w as (select model_id, request_id, k, x as ema from r where k = 1 union all select r.model_id, r.request_id, r.k, 0.2::double * r.x + 0.8::double * w.ema from w join r on r.model_id = w.model_id and r.k = w.k + 1) select model_id, request_id, round(ema, 6) as ema from w""",
)
def exponential_rows(spark, sf_dir):
    return rounded(series.exponential_average_by_row(requests(spark, sf_dir), "model_id", "request_id", "latency_ms", 0.2))


FILL_SQL = HOURLY + """, l as (select model_id, t, v, lead(t) over w as nt, lead(v) over w as nv from h window w as (partition by model_id order by t)),
  g as (select *, unnest(range(t, coalesce(nt, t + 1), 21600)) as slot from l)
  select model_id, slot as t, round(case when slot = t then v else FILL end, 6) as v, slot <> t as filled from g"""
FILL_EXPRESSIONS = {"forward": "v", "backward": "nv", "linear": "v + (nv - v) * (slot - t) / (nt - t)::double", "zero": "0", "mean": "(v + nv) / 2"}


def _fill_plan(how: str):
    @query(f"t04_fill_{how}", FILL_SQL.replace("FILL", FILL_EXPRESSIONS[how]))
    def fill(spark, sf_dir):
        return rounded(series.fill_gaps(hourly(spark, sf_dir), "model_id", "t", "v", 21600, how))


for _how in FILL_EXPRESSIONS:
    _fill_plan(_how)


def _align_plan(how: str, slot: str):
    @query(f"t05_align_{how}", f"select model_id, {slot} as slot, round(avg(latency_ms), 6) as v, count(*) as n from requests group by all")
    def aligned(spark, sf_dir):
        return requests(spark, sf_dir).groupBy("model_id", series.align(c("epoch_s"), 3600, how).alias("slot")).agg(F.round(F.avg("latency_ms"), 6).alias("v"), F.count("*").alias("n"))


for _how, _slot in {"start": "epoch_s - epoch_s % 3600", "end": "epoch_s - epoch_s % 3600 + 3600", "center": "epoch_s - epoch_s % 3600 + 1800", "nearest": "epoch_s - epoch_s % 3600 + case when (epoch_s % 3600) * 2 >= 3600 then 3600 else 0 end"}.items():
    _align_plan(_how, _slot)


@query(
    "t06_interval_detection",
    HOURLY + """, s as (select model_id, t, t - lag(t) over (partition by model_id order by t) as d from h), r as (select *, row_number() over (partition by model_id order by t desc) as k from s where d > 0),
    m as (select model_id, count(*) as samples, cast(floor(median(d)) as bigint) as m from r where k <= 100 group by model_id)
    select m.model_id, cast(any_value(samples) as int) as samples, round(avg((abs(d - m) <= m * 0.1)::int), 6) as consistent, case when avg((abs(d - m) <= m * 0.1)::int) >= 0.7 then any_value(m) end as interval from r join m on r.model_id = m.model_id where k <= 100 group by m.model_id""",
)
def interval(spark, sf_dir):
    return series.detect_interval(hourly(spark, sf_dir), "model_id", "t")


@query("t07_bars", "select model_id, epoch_s - epoch_s % 86400 as slot, round(arg_min(latency_ms, (epoch_s, request_id)), 6) as first, round(max(latency_ms), 6) as high, round(min(latency_ms), 6) as low, round(arg_max(latency_ms, (epoch_s, request_id)), 6) as last, round(sum(latency_ms), 4) as total, count(*) as n from requests group by all")
def bars(spark, sf_dir):
    out = rounded(series.bars(requests(spark, sf_dir), ["model_id"], series.align(c("epoch_s"), 86400, "start"), ["epoch_s", "request_id"], "latency_ms"))
    return out.withColumn("total", F.round("total", 4))


@query(
    "t08_outlier_drop",
    """with recursive r as materialized (select model_id, request_id, latency_ms as x, row_number() over (partition by model_id order by request_id) as k from requests),
    w as (select model_id, request_id, k, x, false as odd, [x] as kept from r where k = 1 union all
      select model_id, request_id, k, x, odd, case when odd then kept else list_append(kept, x)[-100:] end from (
        select r.model_id, r.request_id, r.k, r.x, w.kept, len(w.kept) >= 3 and list_aggregate(w.kept, 'stddev_pop') > 0 and abs(r.x - list_avg(w.kept)) / list_aggregate(w.kept, 'stddev_pop') > 3 as odd from w join r on r.model_id = w.model_id and r.k = w.k + 1))
    select request_id, model_id, x as latency_ms from w where not odd""",
)
def outliers(spark, sf_dir):
    return series.drop_outliers(requests(spark, sf_dir).select("request_id", "model_id", "latency_ms"), "model_id", "request_id", "latency_ms")


@query("t09_metrics_on_one_grid", "with l as (select model_id, epoch_s - epoch_s % 86400 as slot, latency_ms, cost_usd, prompt_tokens from requests) select model_id, slot, round(avg(latency_ms), 6) as latency, round(avg(cost_usd) + 1e-9, 6) as cost, round(avg(prompt_tokens), 6) as tokens from l group by all")
def metric_grid(spark, sf_dir):
    long = requests(spark, sf_dir).select("model_id", series.align(c("epoch_s"), 86400, "start").alias("slot"), F.expr("stack(3, 'latency', latency_ms, 'cost', cost_usd, 'tokens', cast(prompt_tokens as double)) as (metric, v)"))
    wide = long.groupBy("model_id", "slot").pivot("metric", ["latency", "cost", "tokens"]).agg(F.avg("v"))
    return wide.select("model_id", "slot", F.round("latency", 6).alias("latency"), F.round(c("cost") + 1e-9, 6).alias("cost"), F.round("tokens", 6).alias("tokens"))


@query("j01_interval_join", "select r.request_id, f.request_id as feedback_id, f.epoch_s - r.epoch_s as gap from requests r join feedback f on r.user_id = f.user_id and abs(r.epoch_s - f.epoch_s) <= 600")
def interval_join(spark, sf_dir):
    left = requests(spark, sf_dir).select("request_id", "user_id", "epoch_s")
    right = feedback(spark, sf_dir).select(c("request_id").alias("feedback_id"), "user_id", c("epoch_s").alias("f_epoch"))
    return joins.interval_join(left, right, "user_id", "epoch_s", "f_epoch", 600).select("request_id", "feedback_id", (c("f_epoch") - c("epoch_s")).alias("gap"))


@query("j02_asof_join", "with f as (select distinct on (user_id, epoch_s) user_id, epoch_s, rating from feedback order by user_id, epoch_s, rating) select r.request_id, f.rating, f.epoch_s as rated_at from requests r asof left join f on r.user_id = f.user_id and r.epoch_s >= f.epoch_s")
def asof(spark, sf_dir):
    ratings = feedback(spark, sf_dir).groupBy("user_id", c("epoch_s").alias("rated_at")).agg(F.min("rating").alias("rating"))
    right = ratings.withColumn("at", c("rated_at"))
    return joins.asof_join(requests(spark, sf_dir).select("request_id", "user_id", "epoch_s"), right, "user_id", "epoch_s", "at", ["rating", "rated_at"]).select("request_id", "rating", "rated_at")


@query("j03_versioned_join", "with v as (select model_id, 1704067200 + 864000 * k as valid_from, k as version from (select distinct model_id from requests), (select unnest([0, 1, 2]) as k)), w as (select *, lead(valid_from) over (partition by model_id order by valid_from) as until from v) select request_id, version from requests r left join w on r.model_id = w.model_id and r.epoch_s >= valid_from and (until is null or r.epoch_s < until)")
def versioned(spark, sf_dir):
    facts = requests(spark, sf_dir)
    versions = facts.select("model_id").distinct().crossJoin(F.broadcast(spark.range(3))).select("model_id", (F.lit(1704067200) + 864000 * c("id")).alias("valid_from"), c("id").cast("int").alias("version"))
    return joins.versioned_join(facts.select("request_id", "model_id", "epoch_s"), versions, "model_id", "epoch_s", "valid_from").select("request_id", "version")


@query(
    "j04_pattern",
    """with s as (select user_id, request_id, case when latency_ms < 300 then 'A' when latency_ms < 1500 then 'B' else 'C' end as s from requests), n as (select *, case when lag(s) over w is not distinct from s then 0 else 1 end as c from s window w as (partition by user_id order by request_id)),
    g as (select *, sum(c) over (partition by user_id order by request_id rows unbounded preceding) as run from n), b as (select user_id, run, any_value(s) as s, min(request_id) as started, max(request_id) as ended, count(*) as length from g group by user_id, run),
    f as (select *, lag(s) over w as p, lead(s) over w as q from b window w as (partition by user_id order by run)) select user_id, started, ended, length from f where s = 'B' and p = 'A' and q = 'C'""",
)
def pattern(spark, sf_dir):
    marked = requests(spark, sf_dir).withColumn("s", F.when(c("latency_ms") < 300, "A").when(c("latency_ms") < 1500, "B").otherwise("C"))
    return joins.match_runs(marked, "user_id", ["request_id"], "s")


@query("j05_top_n_per_window", "with d as (select epoch_s - epoch_s % 86400 as day, model_id, user_id, count(*) as n from requests group by all) select * from (select *, row_number() over (partition by day, model_id order by n desc, user_id) as place from d) where place <= 2")
def top_n(spark, sf_dir):
    d = requests(spark, sf_dir).groupBy((c("epoch_s") - c("epoch_s") % 86400).alias("day"), "model_id", "user_id").agg(F.count("*").alias("n"))
    return joins.top_n(d, ["day", "model_id"], [F.desc("n"), "user_id"], 2)


@query("j06_union_of_sources", "select event_id as id, event_type as kind, user_id from events union all select conv_id, role, null from conversations", views=False)
def union_sources(spark, sf_dir):
    left = read(spark, sf_dir, "events").select(c("event_id").alias("id"), c("event_type").alias("kind"), "user_id")
    return left.unionByName(read(spark, sf_dir, "conversations").select(c("conv_id").alias("id"), c("role").alias("kind")), allowMissingColumns=True)


@query("f01_request_features", "select request_id, round(ln(prompt_tokens + 1), 6) as length_ln, round(completion_tokens / prompt_tokens::double, 6) as ratio, hour(event_time) as hour, round(cost_usd / (prompt_tokens + completion_tokens) * 1000, 6) as cost_per_1k, case when latency_ms between 0 and 5000 then round(latency_ms, 6) end as latency_valid from requests")
def request_features(spark, sf_dir):
    total = c("prompt_tokens") + c("completion_tokens")
    return rounded(requests(spark, sf_dir).select("request_id", F.ln(c("prompt_tokens") + 1).alias("length_ln"), (c("completion_tokens") / c("prompt_tokens")).alias("ratio"), F.hour("event_time").alias("hour"), (c("cost_usd") / total * 1000).alias("cost_per_1k"), F.when(c("latency_ms").between(0, 5000), c("latency_ms")).alias("latency_valid")))


@query("f02_point_in_time", "with d as (select model_id, epoch_s - epoch_s % 86400 + 86400 as known_at, avg(latency_ms) as latency, count(*) as n from requests group by all) select f.request_id, round(d.latency, 6) as latency, d.n from feedback f join requests r on f.request_id = r.request_id asof left join d on r.model_id = d.model_id and r.epoch_s >= d.known_at")
def point_in_time(spark, sf_dir):
    r = requests(spark, sf_dir)
    daily = r.groupBy("model_id", (c("epoch_s") - c("epoch_s") % 86400 + 86400).alias("known_at")).agg(F.avg("latency_ms").alias("latency"), F.count("*").alias("n"))
    labelled = r.join(feedback(spark, sf_dir).select("request_id"), "request_id").select("request_id", "model_id", "epoch_s")
    return rounded(joins.asof_join(labelled, daily, "model_id", "epoch_s", "known_at", ["latency", "n"]).select("request_id", "latency", "n"))


@query("f03_range_and_outlier_flags", "with s as (select model_id, avg(latency_ms) as m, stddev_samp(latency_ms) as s from requests group by model_id) select request_id, latency_ms < 0 or latency_ms > 60000 as out_of_range, abs(latency_ms - m) > 3 * s as is_outlier from requests join s using (model_id)")
def feature_flags(spark, sf_dir):
    r = requests(spark, sf_dir)
    stats = r.groupBy("model_id").agg(F.avg("latency_ms").alias("m"), F.stddev_samp("latency_ms").alias("s"))
    return r.join(stats, "model_id").select("request_id", (~c("latency_ms").between(0, 60000)).alias("out_of_range"), (F.abs(c("latency_ms") - c("m")) > 3 * c("s")).alias("is_outlier"))
