"""Draws, choices by draws and sampled points from keyed numbers that plain SQL can say too; phrase tables; span trees."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import decisions, joins
from ..operators import selection as E
from ..sources.tables import read, requests
from .registry import query

c = F.col


def uniform_sql(*parts) -> str:
    """The number of selection.uniform as SQL text."""
    x = "1::bigint"
    for p in parts:
        x = f"list_transform([(({x}) * 48271 + ({p}) + 11) % {E.PRIME}], lambda y: (y * y + y * 69621 + 5) % {E.PRIME})[1]"
    for multiplier in (16_807, 39_373, 62_089_911):
        x = f"list_transform([({x})], lambda y: (y * y + y * {multiplier} + 7) % {E.PRIME})[1]"
    return f"(({x} + 1) / {float(E.PRIME + 1)!r}::double)"


def normal_sql(*parts) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*parts, 1)})) * cos({2 * math.pi!r}::double * {uniform_sql(*parts, 2)}))"


def beta_sql(a: str, b: str, *parts) -> str:
    gamma = lambda k, n: f"(({k}) * pow(greatest(1 - 1 / (9 * ({k})) + {normal_sql(*parts, n)} / (3 * sqrt({k})), 1e-6::double), 3.0::double))"
    return f"({gamma(a, 3)} / ({gamma(a, 3)} + {gamma(b, 4)}))"


SEED = 7
ARMS = "a as (select model_id, count(*) as n, sum(success::int)::bigint as wins, row_number() over (order by model_id) as place from requests group by model_id)"
WON, LOST = "(wins + 1)::double", "(n - wins + 1)::double"


@query("e07_thompson_draw", f"with {ARMS} select model_id, round({beta_sql(WON, LOST, SEED, 'place')}, 6) as draw from a")
def thompson(spark, sf_dir):
    return E.thompson_draw(E.beta_arms(requests(spark, sf_dir), "model_id", "success"), "model_id", SEED).select("model_id", F.round("draw", 6).alias("draw"))


@query(
    "e33_thompson_choice",
    f"with {ARMS}, d as (select request_id, a.model_id, {beta_sql(WON, LOST, SEED, 'request_id', 'place')} as draw from requests cross join a) select request_id, arg_max(model_id, draw) as choice, round(max(draw), 6) as draw from d group by request_id",
)
def thompson_choice(spark, sf_dir):
    rows = requests(spark, sf_dir)
    return E.thompson_choice(rows, E.beta_arms(rows, "model_id", "success"), "model_id", "request_id", SEED).select("request_id", "choice", F.round("draw", 6).alias("draw"))


_STEP = "0.1::double * (r.y - (w.t0 * r.x0 + w.t1 * r.x1))"


@query(
    "e34_contextual_choice",
    f"""with recursive r as materialized (select endpoint as policy, model_id as arm, request_id, 1.0::double as x0, prompt_tokens / 1000.0::double as x1, success::int::double as y, row_number() over (partition by endpoint, model_id order by request_id) as k from requests),
    w as (select policy, arm, cast(0 as bigint) as k, 0.0::double as t0, 0.0::double as t1 from r where k = 1 union all
      select r.policy, r.arm, r.k, w.t0 + {_STEP} * r.x0, w.t1 + {_STEP} * r.x1 from w join r on r.policy = w.policy and r.arm = w.arm and r.k = w.k + 1),
    f as (select policy, arm, max(k) as n, arg_max(t0, k) as t0, arg_max(t1, k) as t1 from w group by policy, arm), a as (select *, greatest(0.01::double, pow(0.99::double, n)) as v, row_number() over (partition by policy order by arm) as place from f),
    d as (select r.request_id, a.arm, a.t0 * r.x0 + a.t1 * r.x1 + sqrt(a.v) * sqrt(r.x0 * r.x0 + r.x1 * r.x1) * {normal_sql(SEED, 'r.request_id', 'a.place')} as draw from r join a on r.policy = a.policy)
    select request_id, arg_max(arm, draw) as choice, round(max(draw), 6) as draw from d group by request_id""",
)
def contextual_choice(spark, sf_dir):
    rows = requests(spark, sf_dir).select(c("endpoint").alias("policy"), c("model_id").alias("arm"), "request_id", F.array(F.lit(1.0), c("prompt_tokens") / 1000).alias("x"), c("success").cast("double").alias("y"))
    fitted = E.contextual_thompson(rows.withColumn("xy", F.concat("x", F.array("y"))), ["policy", "arm"], "request_id", "xy")
    return E.contextual_choice(rows, fitted, "policy", "request_id", "x", SEED).select("request_id", "choice", F.round("draw", 6).alias("draw"))


AXES = ("prompt_tokens", "latency_ms")
SPANS = "s as (select count(*) as n, " + ", ".join(f"min({a})::double as low_{i}, max({a})::double as high_{i}" for i, a in enumerate(AXES)) + " from requests)"


def spans(rows) -> tuple[int, dict[str, tuple[float, float]]]:
    """How many requests there are, and the observed span of each axis."""
    r = rows.agg(F.count("*"), *[f(c(a).cast("double")) for a in AXES for f in (F.min, F.max)]).first()
    return r[0], {a: (r[1 + 2 * i] or 0.0, r[2 + 2 * i] or 0.0) for i, a in enumerate(AXES)}


def spread_sql(x: str, seed: int) -> str:
    return f"((({x}) * 48271 + {seed * 69_621 + 11}) % {E.PRIME} * 16807 % {E.PRIME} / {float(E.PRIME)!r}::double)"


def permuted_sql(i: str, seed: int) -> str:
    """The number of selection.permuted as SQL text over n, step and radix."""
    x = f"(({i}) * step + {seed}) % n"
    low, high = f"({x}) % radix", f"({x}) // radix"
    for r in range(2):
        high = f"(({high}) + floor({spread_sql(low, seed + 10 + r)} * (n // radix))::bigint) % (n // radix)"
        low = f"(({low}) + floor({spread_sql(high, seed + 20 + r)} * radix)::bigint) % radix"
    return f"((({high}) * radix + ({low})) * step + 1) % n"


def axis(i: int, share: str) -> str:
    return f"round(low_{i} + {share} * (high_{i} - low_{i}), 6) as {AXES[i]}"


@query("e35_random_search", f"with {SPANS} select request_id as point, {', '.join(axis(i, uniform_sql(SEED + i, 'request_id')) for i in range(2))} from requests, s")
def random_search(spark, sf_dir):
    """A point for every request."""
    rows = requests(spark, sf_dir)
    found = E.random_search(rows.select(c("request_id").alias("point")), "point", spans(rows)[1], SEED)
    return found.select("point", *[F.round(a, 6).alias(a) for a in AXES])


@query(
    "e36_latin_hypercube",
    f"""with {SPANS}, m as (select *, (select min(k) from range(greatest(cast(floor(n * 0.618::double) as bigint), 1), 2 * n + 2) t(k) where gcd(k, n) = 1) as step, (select max(k) from range(1, cast(floor(sqrt(n)) as bigint) + 1) t(k) where n % k = 0) as radix from s)
    select request_id as point, {', '.join(axis(i, f"(({permuted_sql('request_id', SEED + 101 * (i + 1))}) + {uniform_sql(SEED + 7 * (i + 1), 99, 'request_id')}) / n") for i in range(2))} from requests, m""",
)
def latin_hypercube(spark, sf_dir):
    """A point for every request; their ids are 0 to n - 1."""
    rows = requests(spark, sf_dir)
    n, axes = spans(rows)
    found = E.latin_hypercube(rows.select(c("request_id").alias("point")), "point", axes, max(n, 1), SEED)
    return found.select("point", *[F.round(a, 6).alias(a) for a in AXES])


@query(
    "a21_span_tree",
    f"""with recursive s as (select conv_id, turn, case when turn > 0 then turn - 1 end as parent, role, length(text) as size from conversations),
    p as (select conv_id, turn, role, size, null::varchar as parent_name, 1 as depth, size::double as total from s where parent is null
      union all select s.conv_id, s.turn, s.role, s.size, p.role, p.depth + 1, p.total + s.size from p join s on s.conv_id = p.conv_id and s.parent = p.turn)
    select parent_name, role as name, count(*) as calls, round(avg(size), 6) as mean_value, max(depth) as depth, round(avg(total), 6) as mean_total from p group by all""",
    views=False,
)
def span_tree(spark, sf_dir):
    """A turn answers the one before it: edges between roles, with the length of the way from the first turn."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(c("turn") > 0, c("turn") - 1).alias("parent"), "role", F.length("text").alias("size"))
    found = joins.service_edges(joins.span_paths(turns, "conv_id", "turn", "parent", "role", "size"))
    return found.select("parent_name", "name", "calls", F.round("mean_value", 6).alias("mean_value"), "depth", F.round("mean_total", 6).alias("mean_total"))


@query(
    "x22_phrase_table",
    """with w as (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from conversations),
    p as (select distinct array_to_string(w[1:3], ' ') as phrase from w where len(w) >= 3),
    runs as (select conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as phrase from w),
    n as (select phrase, count(*) as occurrences, count(distinct (conv_id, turn)) as texts from runs group by phrase)
    select p.phrase, coalesce(occurrences, 0) as occurrences, coalesce(texts, 0) as texts from p left join n on n.phrase = p.phrase""".replace("\\\\", "\\"),
    views=False,
)
def phrase_table(spark, sf_dir):
    """How often the first three words of any turn occur in all turns."""
    turns = read(spark, sf_dir, "conversations")
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), 1, 3)
    phrases = turns.select(first.alias("w")).where(F.size("w") == 3).select(F.array_join("w", " ").alias("phrase")).distinct()
    return decisions.phrase_counts(turns, "text", phrases)
