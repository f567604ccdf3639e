"""Filter interaction audit: what each filter does behind every other, from one table of failing ids per filter.

Every filter's failing ids are stored once. A filter's effect behind a prefix depends only on which filters the prefix
holds, so the survivors of each set of filters are found level by level: the rows that stand behind a set are joined
with the failing ids of one more filter, a left-semi join gives what it removes and a left-anti join what stands behind
the larger set. The rows that a filter fails go through the same joins, which gives its removals (they still stand), its
redundancies (removed earlier) and the labels that are lost. Each set is reached once, with its filters in order. Rows
that no filter fails survive every prefix, and only their number is kept.

Defined results: every row counts; an id fails a filter if any row of it does; null ids are one id, and never fail as
copies of a smaller one; a null text is empty; a null part is the empty string; an id that is labelled several times
counts as good or toxic if one label says so; without documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The filters' names and the bounds of their conditions.
NAMES = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
MARKS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for all rows in place of a filter.
ALL_ROWS = -1


def failing_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The table of failing ids (_id) of each of the five filters, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split("_t", SPACE), lambda w: w != "")
    read = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_w", words)
    n, upper = F.size("_w"), F.length("_t") - F.length(F.translate("_t", UPPER, ""))
    checked = read.select(
        "_id",
        (n < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("_w")) < DISTINCT_PERCENT * n).alias("B"),
        (100 * upper.cast("long") > UPPER_PERCENT * F.length("_t").cast("long")).alias("C"),
        F.col("_t").rlike(MARKS).alias("D"),
        F.unhex(F.sha2("_t", 256)).alias("_hash"),
    )
    checked = materialise(checked, "checked")
    out = {name: checked.where(name).select("_id") for name in "ABCD"}
    # of equal texts the smallest id is the first; every other pair of id and text is a copy
    firsts = checked.where(F.col("_id").isNotNull()).groupBy("_hash").agg(F.min("_id").alias("_id"))
    out["E"] = checked.where(F.col("_id").isNotNull()).join(firsts, ["_id", "_hash"], "left_anti").select("_id")
    return {name: materialise(ids, f"failing-{name}") for name, ids in out.items()}


def same_id(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"])


def standing(rows: DataFrame, failing: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(filter, behind, part, n, good, toxic) of the rows that stand behind each set of filters, and the same of those removed.

    `filter` is the filter that the rows fail, or ALL_ROWS; `behind` is a set as bits. Of a set the removed rows are
    those that its last filter removes behind the others.
    """
    count = len(failing)
    ids = reduce(DataFrame.unionByName, [x.select(F.lit(s).cast("byte").alias("_next"), F.col("_id")) for s, x in enumerate(failing)])
    any_of = rows.join(ids, same_id(rows, ids), "left_semi")
    each = [rows.join(x, same_id(rows, x), "left_semi").withColumn("filter", F.lit(f).cast("byte")) for f, x in enumerate(failing)]
    level = reduce(DataFrame.unionByName, each, any_of.withColumn("filter", F.lit(ALL_ROWS).cast("byte")))
    level = materialise(level.select("_id", "part", "_good", "_toxic", "filter", F.lit(0).alias("behind"), F.lit(-1).cast("byte").alias("_last")), "standing")
    sums = [F.count("*").alias("n"), F.sum("_good").alias("good"), F.sum("_toxic").alias("toxic")]
    summed = lambda x: x.groupBy("filter", "behind", "part").agg(*sums)
    stay, gone = [summed(level)], []
    for _ in range(count):
        nexts = F.filter(F.array(*[F.lit(s).cast("byte") for s in range(count)]), lambda s: (s > F.col("_last")) & (s != F.col("filter")))
        tried = level.withColumn("_next", F.explode(nexts)).withColumn("behind", F.expr("behind + shiftleft(1, cast(_next as int))"))
        met = same_id(tried, ids) & (tried["_next"] == ids["_next"])
        gone.append(summed(tried.join(ids, met, "left_semi")))
        kept = tried.join(ids, met, "left_anti")
        level = materialise(kept.drop("_last").withColumnRenamed("_next", "_last"), "standing")
        stay.append(summed(level))
    return reduce(DataFrame.unionByName, stay), reduce(DataFrame.unionByName, gone)


def orders(names: list[str]) -> list[dict]:
    """A row per order and step: the filter, the filters before it, and those after which it is the last added, as bits."""
    out = []
    for order in permutations(range(len(names))):
        behind = 0
        for step, f in enumerate(order, 1):
            lower = [behind & ((2 << s) - 1) for s in range(len(names)) if behind >> s & 1]  # the sets on the way to `behind` in order
            out.append({"filter_order": "".join(names[i] for i in order), "step": step, "filter": f, "behind": behind, "after": behind | 1 << f, "way": lower})
            behind |= 1 << f
    return out


def audit(docs: DataFrame, failing: dict[str, DataFrame], labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step: documents kept, removed, redundant and so on; see the module.

    `failing` has for each filter a table of ids (_id); `labels` has the id, quality and toxic.
    """
    names = list(failing)
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("_good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("_toxic")
    )
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = plain.join(known, "_id", "left").select("_id", "part", *[F.coalesce(c, F.lit(0)).cast("byte").alias(c) for c in ("_good", "_toxic")])
    stay, gone = (materialise(x, "audit") for x in standing(materialise(rows, "rows"), list(failing.values())))

    steps = F.array(*[F.struct(*[(F.array(*map(F.lit, v)).cast("array<int>") if k == "way" else F.lit(v)).alias(k) for k, v in s.items()]) for s in orders(names)])
    whole = plain.groupBy("part").agg(F.count("*").alias("_rows"))
    grid = whole.select("part", "_rows", F.explode(steps).alias("_s")).select("part", "_rows", "_s.*")
    at = lambda x, key, **named: x.select("part", F.col("filter"), F.col("behind").alias(key), *[F.col(c).alias(n) for n, c in named.items()])
    flagged = stay.where(f"filter = {ALL_ROWS} and behind = 0").select("part", F.col("n").alias("_flagged"))
    left = at(stay.where(f"filter = {ALL_ROWS}"), "after", _left="n").drop("filter")
    here = at(stay, "behind", removed="n", good_lost="good", toxic_lost="toxic")
    # what a set's filters have removed of a filter's failing rows, added up along the way to the set
    earlier = at(gone, "_on", _gone="n").where(f"filter <> {ALL_ROWS}")
    ways = grid.select("part", "filter", "behind", F.explode("way").alias("_on")).distinct()
    redundant = ways.join(earlier, ["part", "filter", "_on"]).groupBy("part", "filter", "behind").agg(F.sum("_gone").alias("redundant"))
    unique = stay.where(f"filter <> {ALL_ROWS} and behind = {(1 << len(names)) - 1} - shiftleft(1, cast(filter as int))").select("part", "filter", F.col("n").alias("unique_fails"))
    full = grid.join(flagged, "part", "left").join(left, ["part", "after"], "left").join(here, ["part", "filter", "behind"], "left").join(redundant, ["part", "filter", "behind"], "left").join(unique, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    shapley = F.sum(zero("removed")).over(Window.partitionBy("part", "filter"))
    kept = F.col("_rows") - zero("_flagged") + zero("_left")
    return full.select("part", "filter_order", "step", kept.alias("kept"), *[zero(c).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], shapley.alias("shapley"))


#: The same figures from a count of documents for each set of failed filters.
ORACLE_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
words as (select doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first_id from texts),
failed as (
  select doc_id, part, case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > first_id then 16 else 0 end as failing
  from words
),
counted as (
  select part, failing, count(*) as n, count(*) filter (where l.quality = 1) as good, count(*) filter (where l.toxic = 1) as toxic
  from failed f left join labels l on l.doc_id = f.doc_id group by part, failing
),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps as (
  select filter_order, cast(step as int) as step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)
),
audited as (
  select c.part, s.filter_order, s.step, s.bit,
    sum(case when failing & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when failing & before = 0 and failing & bit <> 0 then n else 0 end) as removed,
    sum(case when failing & before <> 0 and failing & bit <> 0 then n else 0 end) as redundant,
    sum(case when failing = bit then n else 0 end) as unique_fails,
    sum(case when failing & before = 0 and failing & bit <> 0 then good else 0 end) as good_lost,
    sum(case when failing & before = 0 and failing & bit <> 0 then toxic else 0 end) as toxic_lost
  from counted c, steps s group by c.part, s.filter_order, s.step, s.bit
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from audited
"""
