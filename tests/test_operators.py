"""Recursive operators against plain loops, and edge cases worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import aggregates as A
from tidewatch.operators import anomaly as N
from tidewatch.operators import decisions as X
from tidewatch.operators import decisions, dedup, joins, rows, series
from tidewatch.operators import selection as E
from tidewatch.operators import windows as W


def test_capped_sessions(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 5, 9, 14, 18, 40, 41])], "k string, i long, t long")
    got = {r.i: r.session_no for r in W.capped_sessions(df, "k", "t", "i", 5, 14).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


def test_token_bucket_and_budget(spark):
    df = spark.createDataFrame([("s", i, t, 3.0) for i, t in enumerate([0, 0, 0, 10, 11])], "s string, i long, t long, cost double")
    assert [r.passed for r in X.token_bucket(df, "s", "t", "i", 0.1, 2.0).orderBy("i").collect()] == [True, True, False, True, False]
    assert [r.action for r in X.budget_walk(df, ["s"], "i", "cost", 8.0, 5.0).orderBy("i").collect()] == ["accept", "accept", "downgrade", "reject", "reject"]


def test_exponential_average_forms_agree(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    expected, e = [], None
    for x in values:
        e = x if e is None else 0.3 * x + 0.7 * e
        expected.append(round(e, 9))
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    assert [round(r.ema, 9) for r in series.exponential_average_by_row(df, "k", "i", "v", 0.3).orderBy("i").collect()] == expected
    native = df.agg(series.exponential_average(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), 0.3).alias("e")).first().e
    assert [round(x, 9) for x in native] == expected


def test_outliers_are_judged_by_kept_values(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 2.0, 1.5, 1.8, 100.0, 1.7, 100.0])], "k string, i long, v double")
    assert [r.v for r in series.drop_outliers(df, "k", "i", "v").orderBy("i").collect()] == [1.0, 2.0, 1.5, 1.8, 1.7]


def test_page_hinkley_and_cusum_against_loops(spark):
    values = [10.0, 11.0, 9.0, 15.0, 16.0, 8.0, 2.0, 3.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    total, low, expected = 0.0, 0.0, []
    for x in values:
        total += x - values[0] - 0.5
        low = min(low, total)
        expected.append(round(total - low, 9))
    assert [round(r.score, 9) for r in N.page_hinkley(df, "k", ["i"], "v", 5.0, 0.5).orderBy("i").collect()] == expected
    up, expected = 0.0, []
    for x in values:
        up = max(0.0, up + x - 10 - 0.5)
        expected.append(round(up, 9))
    assert [round(r.high, 9) for r in N.cusum(df, "k", ["i"], "v", 10.0, 1.0, 4.0).orderBy("i").collect()] == expected


def test_gap_fill_edges(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 10, 2.0), ("k", 40, 8.0), ("one", 5, 3.0)], "k string, t long, v double")
    linear = {(r.k, r.t): r.v for r in series.fill_gaps(df, "k", "t", "v", 10, "linear").collect()}
    assert linear == {("k", 0): 1.0, ("k", 10): 2.0, ("k", 20): 4.0, ("k", 30): 6.0, ("k", 40): 8.0, ("one", 5): 3.0}
    assert series.fill_gaps(df, "k", "t", "v", 10, "skip").count() == 4
    assert series.fill_gaps(df.limit(0), "k", "t", "v", 10, "zero").count() == 0


def test_normal_functions(spark):
    r = spark.range(1).select(stats.normal_cdf(F.lit(1.96)).alias("p"), stats.two_sided_p(F.lit(-1.96)).alias("q"), stats.normal_quantile(F.lit(0.975)).alias("z"), stats.erf(F.lit(0.0)).alias("e")).first()
    assert math.isclose(r.p, 0.9750021, abs_tol=1e-6) and math.isclose(r.q, 0.0499958, abs_tol=1e-6) and math.isclose(r.z, 1.96, abs_tol=1e-3) and abs(r.e) < 1e-6


def test_single_values_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    out = {r.k: r for r in df.groupBy("k").agg(*A.agg_spec([("avg", "v", "m"), ("stddev", "v", "s"), ("percentile", "v", "p", 95), ("count", "v", "n")])).collect()}
    assert (out["a"].m, out["a"].s, out["a"].p, out["a"].n) == (1.0, None, 1.0, 1) and (out["b"].m, out["b"].n) == (None, 0)
    assert [tuple(r) for r in A.by_rank(df, ["k"], "v", {"p50": A.nearest_rank(50.0)}).collect()] == [("a", 1.0, 1)]


def test_latin_hypercube_has_one_point_a_stratum(spark):
    """For a power of two, a prime, a product and 1; no exchange; other seeds give other points."""
    for n in (1, 2, 8, 97, 360):
        points = E.latin_hypercube(spark.range(n).withColumnRenamed("id", "point"), "point", {"x": (0.0, 1.0), "y": (10.0, 20.0)}, n, 1)
        rows = points.collect()
        assert sorted(int(p.x * n) for p in rows) == sorted(int((p.y - 10) * n / 10) for p in rows) == list(range(n))
        assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    other = E.latin_hypercube(spark.range(360).withColumnRenamed("id", "point"), "point", {"x": (0.0, 1.0), "y": (10.0, 20.0)}, 360, 2).collect()
    assert sum(int(a.x * 360) == int(b.x * 360) for a, b in zip(rows, other, strict=True)) < 40
    pairs = {(int(p.x * 4), int((p.y - 10) * 0.4)) for p in rows}
    assert len(pairs) == 16  # the axes are not tied to each other


def test_random_search_and_draws(spark):
    """Uniform numbers fill their span; beta draws have the mean and deviation of their posterior."""
    n = 20_000
    ids = spark.range(n).withColumnRenamed("id", "point")
    x = E.random_search(ids, "point", {"x": (-1.0, 3.0)}, 5).agg(F.min("x"), F.max("x"), F.avg("x"), F.stddev("x")).first()
    assert -1 < x[0] < -0.99 and 2.99 < x[1] < 3 and abs(x[2] - 1) < 0.03 and abs(x[3] - 4 / 12**0.5) < 0.03
    for a, b in ((1.0, 1.0), (3.0, 9.0), (400.0, 100.0)):
        d = ids.select(E.beta_draw(F.lit(a), F.lit(b), 3, F.col("point")).alias("d")).agg(F.avg("d"), F.stddev("d")).first()
        mean, sd = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert abs(d[0] - mean) < 0.02 and abs(d[1] - sd) < 0.1 * sd


def test_thompson_choice_prefers_the_better_arm(spark):
    """The share of choices follows the chance that an arm is best; a single arm is always chosen; no rows, no choices."""
    arms = spark.createDataFrame([("a", 90, 100), ("b", 50, 100), ("c", 0, 0)], "arm string, wins long, n long")
    rows = spark.range(4000).withColumnRenamed("id", "k")
    shares = {r.choice: r["count"] / 4000 for r in E.thompson_choice(rows, arms, "arm", "k", 1).groupBy("choice").count().collect()}
    assert shares["a"] > 0.8 and 0.05 < shares["c"] < 0.2 and shares.get("b", 0) < 0.01
    assert E.thompson_choice(rows, arms.where("arm = 'b'"), "arm", "k", 1).where("choice = 'b'").count() == 4000
    assert E.thompson_choice(rows.limit(0), arms, "arm", "k", 1).count() == 0


def test_contextual_choice_follows_the_context(spark):
    fitted = spark.createDataFrame([("p", "low", [1.0, -1.0], 0.0001), ("p", "high", [0.0, 1.0], 0.0001), ("q", "only", [0.0, 0.0], 1.0)], "policy string, arm string, theta array<double>, variance double")
    rows = spark.createDataFrame([(1, "p", [1.0, 0.1]), (2, "p", [1.0, 0.9]), (3, "q", [1.0, 0.5]), (4, "none", [1.0, 0.5])], "k long, policy string, x array<double>")
    assert {r.k: r.choice for r in E.contextual_choice(rows, fitted, "policy", "k", "x", 3).collect()} == {1: "low", 2: "high", 3: "only"}


def test_span_paths_of_trees(spark):
    """Branches, two traces, an orphan and a cycle; 300 levels."""
    rows = [("t", 1, None, "a", 5), ("t", 2, 1, "b", 3), ("t", 3, 1, "b", 4), ("t", 4, 3, "c", 1), ("t", 9, 8, "x", 1), ("t", 11, 12, "y", 1), ("t", 12, 11, "y", 1), ("u", 1, None, "a", 2)]
    spans = spark.createDataFrame(rows, "trace string, id long, up long, name string, v long")
    found = {(r.trace, r.span): (r.depth, r.total, r.parent_name) for r in joins.span_paths(spans, "trace", "id", "up", "name", "v").collect()}
    assert found == {("t", 1): (1, 5.0, None), ("t", 2): (2, 8.0, "a"), ("t", 3): (2, 9.0, "a"), ("t", 4): (3, 10.0, "b"), ("u", 1): (1, 2.0, None)}
    edges = {(r.parent_name, r.name): (r.calls, r.mean_value, r.depth, r.mean_total) for r in joins.service_edges(joins.span_paths(spans, "trace", "id", "up", "name", "v")).collect()}
    assert edges["a", "b"] == (2, 3.5, 2, 8.5) and edges[None, "a"][0] == 2


def test_phrase_table_of_any_size(spark):
    """10,000 phrases without a collect: counts equal a plain search; overlaps, case, punctuation, too long and empty phrases."""
    texts = ["The cat, the cat the CAT", None, "", "a a a a", "x1 y2", "é É-é"]
    phrases = [f"word{i} word{i + 1}" for i in range(10_000)] + ["the cat", "a a", "cat", "é é", "", None, "x1 Y2", "one two three four five six seven eight nine", "the-cat"]
    found = {r.phrase: (r.occurrences, r.texts) for r in decisions.phrase_counts(spark.createDataFrame([(t, 1) for t in texts], "t string, phrase int"), "t", spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert {k: v for k, v in found.items() if v[0]} == {"the cat": (3, 1), "a a": (3, 1), "cat": (3, 1), "é é": (2, 1), "x1 Y2": (1, 1), "the-cat": (3, 1)}
    assert len(found) == 10_006 and "" not in found


def test_not_in_follows_sql(spark):
    """Null keys, a subquery with a null, an empty one."""
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    given = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    found = lambda right: sorted(r.k or 0 for r in joins.not_in(left, right, "k", "k").collect())
    assert found(given(2, 2, 5)) == [1] and found(given(2, None)) == [] and found(given()) == [0, 1, 2]
    assert "BroadcastNestedLoopJoin BuildRight, LeftAnti" not in joins.not_in(left, given(2), "k", "k")._jdf.queryExecution().executedPlan().toString()


def test_intervals_that_follow(spark):
    left = spark.createDataFrame([(1, "u", 100), (2, "u", 1000), (3, "v", 5), (4, None, 1)], "i int, u string, t long")
    right = spark.createDataFrame([(9, "u", 100), (8, "u", 101), (7, "u", 1000), (6, "u", 999)], "j int, u string, s long")
    found = sorted((r.i, r.j or 0) for r in joins.interval_join(left, right, "u", "t", "s", 900, "left", only_after=True).collect())
    assert found == [(1, 6), (1, 7), (1, 8), (2, 0), (3, 0), (4, 0)]


def test_keys_and_missing_parts(spark):
    df = spark.createDataFrame([("m", "s", "u"), (None, None, "u"), (None, None, None)], "m string, s string, u string")
    assert [r.k for r in df.select(rows.event_key(F.col("m"), F.col("s"), F.col("u"), F.lit("9")).alias("k")).collect()] == ["composite:model:m,session:s", "user:u", "event:9"]
    assert [r.k for r in df.select(dedup.composite_key("m", "u").alias("k")).collect()] == ["m:u", None, None]


def test_skyline_of_duplicates_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 2.0), (4, 0.5, 0.5)], "id long, q double, c double")
    assert sorted(r.id for r in E.skyline(df, "id", ["q"], ["c"]).collect()) == [1, 2, 4]
