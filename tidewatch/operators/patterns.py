"""Patterns over the rows of a key, such as `A B+ C? (D|E)`, found without a task that holds a key.

A pattern is a set of places with an ordered list of what may follow each. Whether a place can still come to an end is
one bit of what the rows ahead say, and a row maps those bits linearly, so the rows of a block compose to one small
matrix of bits; walked from the last block to the first, the blocks tell each row what is possible after it. With that
known, matching never goes back: at each row the first choice that can end is the right one. That too is a map between
places, composed by block and walked from the first block to the last.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .ordered import _taken_over, in_blocks
from .scans import _starts

#: A place is a bit of a long; the end of the pattern is a place too.
MOST_PLACES = 62
#: Steps that a task remembers at most; older ones are worked out again.
REMEMBERED = 1 << 16
TOKEN = re.compile(r"\s*(?:(\w+)|([()|])|([?*+]|\{\d+(?:,\d*)?\})(\??))")


def places(pattern: str) -> tuple[list[str], list[list[int]], list[int]]:
    """(symbols, follows, first): the symbol of each place, what may follow it, and what may come first, by preference.

    Rows side by side, `|`, brackets, `?`, `*`, `+`, `{n}`, `{n,}` and `{n,m}`; with a `?` behind, the shorter choice comes
    first. The end is the place after the last symbol. A pattern that no row matches is refused.
    """
    tokens, at = [], 0
    while pattern[at:].strip():
        found = TOKEN.match(pattern, at)
        if not found:
            raise ValueError(f"what is {pattern[at:]!r} in a pattern?")
        tokens.append(found.groups())
        at = found.end()
    symbols: list[str] = []
    follows: list[list] = []
    tokens.reverse()

    def choice():
        branches = [row()]
        while tokens and tokens[-1][1] == "|":
            tokens.pop()
            branches.append(row())
        return lambda then: [x for b in branches for x in b(then)]

    def row():
        items = []
        while tokens and tokens[-1][1] not in ("|", ")"):
            items.append(item())
        return lambda then: chained(items, then)

    def chained(items, then):
        for build in reversed(items):
            then = build(then)
        return then

    def item():
        name, mark, times, _ = tokens.pop()
        if times or mark == "|":
            raise ValueError("a count stands behind a symbol or a bracket")
        if mark == "(":
            build = choice()
            if not tokens or tokens.pop()[1] != ")":
                raise ValueError("a bracket is not closed")
        else:

            def build(then, name=name):
                symbols.append(name)
                follows.append(then)
                if len(symbols) >= MOST_PLACES:
                    raise ValueError(f"a pattern of over {MOST_PLACES} places")
                return [len(symbols) - 1]

        while tokens and tokens[-1][2]:
            _, _, times, short = tokens.pop()
            build = counted(build, times, bool(short))
        return build

    def counted(build, times: str, short: bool):
        either = lambda more, less: [*less, *more] if short else [*more, *less]
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(times) or (lambda a, b, c: (int(a), int(c) if c else None if b else int(a)))(*times[1:-1].partition(","))
        if high is not None and (high < low or high == 0):
            raise ValueError(f"a count of {times}")

        def endless(then):
            again: list = []  # what comes after a round is known only once the round is built
            entry = build([again])
            again += either(entry, then)
            return entry if low else [again]

        def several(then):
            if high is None:
                then = endless(then)
                return chained([build] * max(low - 1, 0), then)
            for _ in range(high - low):
                then = optional(then)
            return chained([build] * low, then)

        def optional(then):
            return either(build(then), then)

        return several

    def flat(options: list, seen: tuple = ()) -> list[int]:
        """Nested lists of choices as one, each place once; a list within itself adds nothing."""
        out: list[int] = []
        for x in options:
            inner = [x] if isinstance(x, int) else [] if any(x is s for s in seen) else flat(x, (*seen, x))
            out += [y for y in inner if y not in out]
        return out

    whole = choice()
    if tokens:
        raise ValueError("a bracket is closed that was not opened")
    first = whole([-1])
    end = len(symbols)
    named = lambda options: [end if x == -1 else x for x in flat(options)]
    if end in named(first):
        raise ValueError("the pattern matches no rows at all")
    return symbols, [named(f) for f in follows], named(first)


class Steps:
    """What a row does, given the symbols that it satisfies as bits."""

    def __init__(self, pattern: str, names: Sequence[str]):
        self.symbols, self.follows, self.first = places(pattern)
        unknown = set(self.symbols) - set(names)
        if unknown:
            raise ValueError(f"no condition for {sorted(unknown)}")
        self.bit = [1 << list(names).index(s) for s in self.symbols]
        self.end = len(self.symbols)
        self.done = sum(1 << p for p, f in enumerate(self.follows) if self.end in f)  # places that may be the last
        self.next = lru_cache(REMEMBERED)(self._next)
        self.before = lru_cache(REMEMBERED)(self._before)
        self.grown = lru_cache(REMEMBERED)(self._grown)
        self.after = lru_cache(REMEMBERED)(self._after)

    def _open(self, row: int) -> list[int]:
        """For each place, those that may follow it and whose symbol the row satisfies."""
        return [sum(1 << q for q in f if q != self.end and self.bit[q] & row) for f in self.follows]

    def _before(self, row: int, possible: int) -> int:
        """Places that can end with this row and those after it ahead, from those that can with those after it ahead."""
        return self.done | sum(1 << p for p, opened in enumerate(self._open(row)) if opened & possible)

    def _grown(self, summary: tuple[int, tuple[int, ...]], row: int) -> tuple[int, tuple[int, ...]]:
        """A block's (ended, reached) with one more row at its end: possible before it = ended | those that reach what is possible after it."""
        ended, reached = summary
        opened = self._open(row)
        ended |= sum(1 << p for p, r in enumerate(reached) if r & self.done)
        grown = []
        for r in reached:
            new = 0
            for q in range(self.end):
                if r >> q & 1:
                    new |= opened[q]
            grown.append(new)
        return ended, tuple(grown)

    def _next(self, place: int, row: int, possible: int) -> tuple[int, bool]:
        """(place, whether a match begins) of a row after a place; -1 is outside. `possible` is what can end after the row."""
        fits = lambda q: q != self.end and self.bit[q] & row and possible >> q & 1
        if place >= 0:
            for q in self.follows[place]:
                if q == self.end:
                    break
                if fits(q):
                    return q, False
        return next(((q, True) for q in self.first if fits(q)), (-1, False))

    def _after(self, places_now: tuple[int, ...], row: int, possible: int) -> tuple[tuple[int, ...], tuple[bool, ...]]:
        moved = [self.next(p, row, possible) for p in places_now]
        return tuple(q for q, _ in moved), tuple(new for _, new in moved)


@lru_cache(16)
def steps_of(pattern: str, names: tuple[str, ...]) -> Steps:
    """Once for each worker: what it remembers is not sent along."""
    return Steps(pattern, names)


def match_rows(df: DataFrame, key: str, order: Sequence[str], symbols: dict[str, Column], pattern: str) -> DataFrame:
    """Rows of matches, with match_no (from 1 within the key), match_row (from 1 within the match) and symbol.

    Matches are found from the first row on, the next behind the last row of the one before; of several from one row, the one
    that the pattern prefers is taken (more rows first, or fewer behind a `?`; left branches first). A row may satisfy
    several conditions, and symbol is the one that the match takes it for; a null condition is not satisfied. Keys that are
    null are one key. Rows that tie in the whole order are taken in any order. Measures of a match are aggregates over
    (key, match_no), e.g. `min_by(id, match_row)` or `count_if(symbol = 'B')`.
    """
    names = tuple(symbols)
    steps = Steps(pattern, names)
    end, done = steps.end, steps.done
    bits = F.lit(0)
    for i, condition in enumerate(symbols.values()):
        bits = bits + F.when(condition, 1 << i).otherwise(0)
    blocked = in_blocks(df.withColumn("_bits", bits.cast("long")), *order[:2])
    kind = dict(df.dtypes)[key]

    def dealt(rows: DataFrame, backwards: bool = False) -> DataFrame:
        last = [F.desc_nulls_first(c) if backwards else F.asc_nulls_last(c) for c in order]
        return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", *last)

    def folded(rows: DataFrame, fields: str, start, step, given: Sequence[str]) -> DataFrame:
        """A row a key and block: what `step` makes of its rows."""
        schema = _parse_datatype_string(f"`{key}` {kind}, _block long, {fields}")
        arrow = to_arrow_schema(schema)

        def fold(batches):
            one_more = step(steps_of(pattern, names))
            last, at, held, found = None, None, None, []
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
            for batch in batches:
                starts, last = _starts(batch, key, last)
                for k, block, new, *values in zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), starts, *[batch.column(c).to_pylist() for c in given], strict=True):
                    if new:
                        if at:
                            found.append((*at, *held))
                        at, held = (k, block), start
                    held = one_more(held, *values)
                if len(found) > 1000:
                    yield made()
                    found = []
            if at:
                found.append((*at, *held))
                yield made()

        return rows.mapInArrow(fold, schema)

    # which places can end, with what lies behind each block
    nothing = (0, tuple(1 << p for p in range(end)))
    ahead = folded(dealt(blocked.select(key, "_block", *order, "_bits")), "_ended long, _reached array<long>", nothing, lambda steps: steps.grown, ["_bits"])
    step = lambda x, s: s["_ended"].bitwiseOR(F.aggregate(F.transform(s["_reached"], lambda r, p: F.when(r.bitwiseAND(x) != 0, F.pow(F.lit(2.0), p).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    lists = ahead.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_block", "_ended", "_reached")))).alias("_s"))
    at_end = F.lit(done).cast("long")
    known = F.aggregate("_s", F.array(at_end), lambda xs, s: F.concat(xs, F.array(step(F.element_at(xs, -1), s))))
    behind = lists.select(key, F.explode(F.arrays_zip(F.col("_s._block").alias("_block"), F.slice(known, 1, F.size("_s")).alias("_behind"))).alias("_z")).select(key, "_z.*")

    narrow = [*df.columns, "_block", "_bits"]
    marked_schema = _parse_datatype_string(", ".join([*(f"`{n}` {dict(blocked.dtypes)[n]}" for n in narrow), "_possible long"]))

    def mark(batches):
        steps = steps_of(pattern, names)
        last, possible = None, 0
        for batch in batches:
            starts, last = _starts(batch, key, last)
            out = []
            for row, after, new in zip(batch.column("_bits").to_pylist(), batch.column("_behind").to_pylist(), starts, strict=True):
                possible = after if new else possible
                out.append(possible)
                possible = steps.before(row, possible)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in narrow), pa.array(out, pa.int64())], names=[*narrow, "_possible"])

    marked = dealt(_taken_over(blocked, key, behind), backwards=True).mapInArrow(mark, marked_schema)

    # where each block leaves the match that it was entered in; entry 0 is outside of one
    def moved(steps):
        return lambda held, row, possible: one_more(steps, *held, row, possible)

    def one_more(steps, now, begun, rows, row, possible):
        then, new = steps.after(now, row, possible)
        return then, tuple(b + n for b, n in zip(begun, new, strict=True)), tuple(0 if q < 0 else 1 if n else r + 1 for q, n, r in zip(then, new, rows, strict=True))

    entries = (-1, *range(end))
    still = (entries, (0,) * len(entries), (0,) * len(entries))
    through = folded(dealt(marked.select(key, "_block", *order, "_bits", "_possible")), "_place array<long>, _begun array<long>, _rows array<long>", still, moved, ["_bits", "_possible"])
    lists = through.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "_place", "_begun", "_rows"))).alias("_s"))

    def cross(x: Column, s: Column) -> Column:
        i = (x["place"] + 1).cast("int")
        begun = F.get(s["_begun"], i)
        return F.struct(F.get(s["_place"], i).alias("place"), (x["no"] + begun).alias("no"), (F.get(s["_rows"], i) + F.when((begun == 0) & (F.get(s["_place"], i) >= 0), x["rows"]).otherwise(0)).alias("rows"))

    outside = F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("rows"))
    known = F.aggregate("_s", F.array(outside), lambda xs, s: F.concat(xs, F.array(cross(F.element_at(xs, -1), s))))
    entered = lists.select(key, F.explode(F.arrays_zip(F.col("_s._block").alias("_block"), F.slice(known, 1, F.size("_s")).alias("_in"))).alias("_z")).select(key, "_z._block", *[F.col(f"_z._in.{c}").alias(f"_in_{c}") for c in ("place", "no", "rows")])
    out_schema = _parse_datatype_string(", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "match_no long, match_row long, symbol string"]))

    def walk(batches):
        steps = steps_of(pattern, names)
        last, place, no, rows = None, -1, 0, 0
        for batch in batches:
            starts, last = _starts(batch, key, last)
            columns = [batch.column(c).to_pylist() for c in ("_bits", "_possible", "_in_place", "_in_no", "_in_rows")]
            taken, found = [], ([], [], [])
            for i, (row, possible, p, n, r, new) in enumerate(zip(*columns, starts, strict=True)):
                if new:
                    place, no, rows = p, n, r
                place, begins = steps.next(place, row, possible)
                no, rows = no + begins, 0 if place < 0 else 1 if begins else rows + 1
                if place >= 0:
                    taken.append(i)
                    for column, value in zip(found, (no, rows, steps.symbols[place]), strict=True):
                        column.append(value)
            kept = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in df_columns), *(pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*df_columns, "match_no", "match_row", "symbol"])

    df_columns = df.columns
    return dealt(_taken_over(marked, key, entered)).mapInArrow(walk, out_schema)
