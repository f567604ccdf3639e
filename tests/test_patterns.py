"""Row patterns against Python's own backtracking matcher, split over many blocks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered as O
from tidewatch.operators.patterns import MOST_PLACES, match_rows, places

def apart():
    return {s: F.col("s") == s for s in "ABCDE"}


def by_hand(text: str, pattern: str):
    """(match_no, match_row, position) by `re`, whose choices are those of the pattern."""
    found = re.finditer(pattern.replace(" ", ""), text)
    return [(n, i + 1, m.start() + i) for n, m in enumerate(found, 1) for i in range(m.end() - m.start())]


@pytest.mark.parametrize("pattern", ["A B+ C", "A B+ C? (D|E)", "(A|B)+? C{1,2}", "(A B?)+ C*", "A{2,} (B|C D)*? E?", "(A|A B) C?", "((A|B)* C)+"])
def test_patterns_equal_a_backtracking_matcher(spark, monkeypatch, pattern):
    monkeypatch.setattr(O, "BLOCK_ROWS", 17)
    rng = random.Random(pattern)
    texts = {"x": "".join(rng.choice("ABCDE") for _ in range(150)), "y": "".join(rng.choice("AAB") for _ in range(120)) + "CE", "z": "A" + "B" * 100 + "C", None: "ABCABBC"}
    rows = [(k, i, s) for k, t in texts.items() for i, s in enumerate(t)]
    rng.shuffle(rows)
    found = match_rows(spark.createDataFrame(rows, "k string, i long, s string").repartition(3), "k", ["i"], apart(), pattern).collect()
    got = sorted(((r.k or "", r.match_no, r.match_row, r.i) for r in found))
    assert got == sorted((k or "", *x) for k, t in texts.items() for x in by_hand(t, pattern))
    assert all(r.symbol == r.s for r in found)


def test_conditions_that_overlap(spark):
    """A and C hold on the same rows: fast, slow run, fast; a fast row ends one match and does not begin the next."""
    values = [50, 2000, 3000, 60, 1500, 70, 80, 90, 1200, 5, None, 40]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "k string, i long, v long")
    found = match_rows(df, "k", ["i"], {"A": F.col("v") < 100, "B": F.col("v") > 1000, "C": F.col("v") < 100}, "A B+ C").orderBy("i").collect()
    assert [(r.i, r.match_no, r.match_row, r.symbol) for r in found] == [(0, 1, 1, "A"), (1, 1, 2, "B"), (2, 1, 3, "B"), (3, 1, 4, "C"), (7, 2, 1, "A"), (8, 2, 2, "B"), (9, 2, 3, "C")]


def test_empty_table_and_refusals(spark):
    none = spark.createDataFrame([], "k string, i long, s string")
    assert match_rows(none, "k", ["i"], apart(), "A B").collect() == []
    for wrong in ("A?", "A*|B", "(A", "A)", "+A", "A{0}", "A{3,2}", "A,B", " ".join("A" * MOST_PLACES)):
        with pytest.raises(ValueError):
            places(wrong)
    with pytest.raises(ValueError):
        match_rows(none, "k", ["i"], apart(), "A Z")


def test_plan_holds_no_key_in_one_task(spark):
    df = spark.range(100).selectExpr("'a' as k", "id as i", "'A' as s")
    plan = match_rows(df, "k", ["i"], apart(), "A+")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
