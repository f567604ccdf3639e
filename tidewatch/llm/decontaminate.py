"""Benchmark decontamination by winnowing.

Each text keeps the smallest k-gram hash of every window of w consecutive k-grams (the rightmost on ties); with
k + w - 1 = 13 any shared span of 13 words has a kept fingerprint in both texts. Fingerprints of documents are joined
with those of benchmark items, and each hit is extended to the 13-word windows around it, which are compared.
An item of fewer than 13 words is one window: there all k-grams of its own length are kept.

A benchmark of up to BROADCAST_BYTES of text is broadcast as sorted arrays, and windows are compared byte by byte in one
pass over the documents. A larger one stays distributed: a pass over it sets the bits of its fingerprints and windows in
two tables of fixed size, one pass over the documents keeps the windows around fingerprints that pass both, and those
are joined with the benchmark's windows by their words. Memory does not depend on the benchmark's size. Either way a
window occurs only where all its words are equal, so both give the same rows.

Defined results: null texts and texts without words have no hits and are not contaminated; items with a null id make
words hit but are not listed; repeated items count once each by id; repeated documents give repeated rows; an empty
benchmark leaves all documents clean; other columns are ignored, or kept as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_small_batches, map_pieces, materialise, text_and_row, text_bytes, with_row
from .words import ALPHANUMERIC, gram_hashes, gram_hashes_at, join_texts, word_hashes

WINDOW = 13
GRAM = 7
#: Benchmark text that is broadcast, bytes; its arrays take about twelve times as much (tested).
BROADCAST_BYTES = 8 << 20
#: Text that a task looks at together, bytes; a longer text is taken alone.
PIECE_BYTES = 2 << 20
#: Bits of each of the two tables of a large benchmark, and bytes of them that travel in one row.
TABLE_BITS = 1 << 26
TABLE_ROW = 1 << 13
#: Parts that a window which many documents share is dealt into.
SALTS = 16


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: the rightmost smallest hash of every w consecutive ones."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    n = len(grams) - w + 1
    best = grams[:n].copy()
    where = np.arange(n)
    for j in range(1, w):
        other = grams[j : j + n]
        lower = other <= best
        best = np.where(lower, other, best)
        where = np.where(lower, np.arange(j, j + n), where)
    return where[np.flatnonzero(np.diff(where, prepend=-1))]


@dataclass
class Texts:
    """Joined texts as words: bytes, start, end and hash of each word, its text, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    text: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        data, edges = join_texts(texts)
        start, end, words = word_hashes(data, ALPHANUMERIC)
        cut = np.searchsorted(start, edges)
        return cls(data, start, end, words, np.repeat(np.arange(len(texts)), np.diff(cut)), cut)

    def spelled(self, at: int, n: int) -> list[bytes]:
        return [self.data[a:b].tobytes().lower() for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)]  # bytes.lower changes A-Z only

    def kinds(self, n: int, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """In each run of windows that begins at `first`: 0 for those with the words of the first, 1 for the next words..."""
        out = np.zeros(len(at), np.int32)
        for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True):
            if b - a > 1:
                seen: dict[tuple, int] = {}
                out[a:b] = [seen.setdefault(tuple(self.spelled(i, n)), len(seen)) for i in at[a:b].tolist()]
        return out

    def windows(self) -> dict[int, np.ndarray]:
        """Where the windows of items begin, by their length."""
        size = np.diff(self.cut)
        short = {int(n): self.cut[:-1][size == n] for n in np.unique(size[(size > 0) & (size < WINDOW)])}
        at = np.arange(max(0, len(self.words) - WINDOW + 1))
        at = at[self.text[at] == self.text[at + WINDOW - 1]]
        return short | ({WINDOW: at} if len(at) else {})

    def prints(self, n: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the items that have windows of this length."""
        if n < WINDOW:
            return gram_hashes_at(self.words, at, n)
        # Fingerprints are taken over the joined words: windows that cross texts only add kept positions.
        grams = gram_hashes(self.words, GRAM)
        return grams[winnow(grams, WINDOW - GRAM + 1)]

    def near(self, n: int, known) -> np.ndarray:
        """Where windows of this length begin that hold a fingerprint which is known."""
        if len(self.words) < n:
            return np.zeros(0, np.int64)
        k = GRAM if n == WINDOW else n
        grams = gram_hashes(self.words, k)
        kept = winnow(grams, WINDOW - GRAM + 1) if n == WINDOW else np.arange(len(grams))
        kept = kept[known(grams[kept])]
        at = np.unique((kept[:, None] - np.arange(n - k + 1)).ravel())
        at = at[(at >= 0) & (at <= len(self.words) - n)]
        return at[self.text[at] == self.text[at + n - 1]]


def among(values: np.ndarray):
    """A test of membership in sorted values."""
    return lambda x: values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


class Index:
    """Sorted fingerprints and windows of a benchmark: equal windows are one entry with the list of their items."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.names = [name for name, _ in items]
        t = Texts.of([text for _, text in items])
        self.prints, self.hashes, self.at, self.items = {}, {}, {}, {}
        for n, at in t.windows().items():
            self.prints[n] = np.unique(t.prints(n, at))
            hashes = gram_hashes_at(t.words, at, n)
            order = np.argsort(hashes, kind="stable")
            at, hashes = at[order], hashes[order]
            kind = t.kinds(n, at, np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])))
            if kind.any():  # different windows of one hash
                order = np.lexsort((kind, hashes))
                at, hashes, kind = at[order], hashes[order], kind[order]
            first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (kind[1:] != kind[:-1])))
            self.hashes[n], self.at[n] = hashes[first], at[first].astype(np.int32)
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
            pairs = np.unique(which * len(items) + t.text[at])
            edges = np.searchsorted(pairs, np.arange(len(first) + 1) * len(items))
            self.items[n] = edges.astype(np.int32), (pairs % len(items)).astype(np.int32)
        self.texts = Texts(t.data, t.start.astype(np.int32), t.end.astype(np.int32), None, None, None)  # what spelled needs

    def hits(self, t: Texts) -> list[tuple[int, int, np.ndarray]]:
        """(first word, word after the last, items) of each benchmark window inside one of the texts."""
        out = []
        for n, prints in self.prints.items():
            near = t.near(n, among(prints))
            hashes = gram_hashes_at(t.words, near, n)
            hit = among(self.hashes[n])(hashes)
            edge, items = self.items[n]
            for i, h, w in zip(near[hit].tolist(), hashes[hit], np.searchsorted(self.hashes[n], hashes[hit]).tolist(), strict=True):
                own = t.spelled(i, n)
                while w < len(self.at[n]) and self.hashes[n][w] == h:
                    if self.texts.spelled(int(self.at[n][w]), n) == own:
                        out.append((i, i + n, items[edge[w] : edge[w + 1]]))
                    w += 1
        return sorted(out, key=lambda x: x[:2])


def marker(index, keep_row: bool):
    """The function of a piece of documents that finds each one's hit words and items."""
    index = index.value

    def piece(batch):
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        t = Texts.of(texts)
        hit, until = [0] * len(texts), [0] * len(texts)
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for low, high, items in index.hits(t):
            d = int(t.text[low])
            hit[d] += max(0, high - max(low, until[d]))
            until[d] = max(until[d], high)
            found[d].append(items)
        names = [sorted({n for i in np.unique(np.concatenate(x)).tolist() if (n := index.names[i]) is not None}) if x else [] for x in found]
        return {"_id": batch.column(0), "_row": batch.column(2) if keep_row else None, "n_words": np.diff(t.cut), "n_hit": hit, "items": names}

    return piece


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_row: bool = False) -> DataFrame:
    """Per document: words, words hit, the items with occurring windows (ids as sorted strings), the verdict.

    With keep_row the result has (_id, _row, ...) with the whole input row as a struct.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("_item"), F.col(item_text).alias("_text"))
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = items.select("_item", F.col("_text").cast("binary")).collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], bytes(r[1])) for r in rows]))
        own = "n_words long, n_hit long, items array<string>"
        chosen = text_and_row(docs, id_col, text_col) if keep_row else text_bytes(docs, id_col, text_col)
        schema = with_row(docs, id_col, own)
        schema = schema if keep_row else StructType([schema["_id"], *schema.fields[2:]])
        found = map_pieces(chosen, lambda: marker(index, keep_row), schema, PIECE_BYTES)
    else:
        found = joined(docs, items, id_col, text_col, keep_row)
    found = found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return found if keep_row else found.withColumnRenamed("_id", id_col)


def bit_tables(items: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Bits of the fingerprints and windows of all items, by kind and window length; only set rows travel."""

    def run(batches):
        tables: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            t = Texts.of([x or b"" for x in batch.column(1).to_pylist()])
            for n, at in t.windows().items():
                for kind, values in (("print", t.prints(n, at)), ("window", gram_hashes_at(t.words, at, n))):
                    key = (kind, WINDOW if n == WINDOW else 0)  # short lengths share a table: hashes hold no length, tests only get laxer
                    table = tables.setdefault(key, np.zeros(TABLE_BITS // 8, np.uint8))
                    np.bitwise_or.at(table, (values >> np.uint64(3)) % np.uint64(TABLE_BITS // 8), np.uint8(1) << (values & np.uint64(7)).astype(np.uint8))
        lengths: list = []
        for (kind, n), table in tables.items():
            rows = table.reshape(-1, TABLE_ROW)
            lengths += [(kind, n, int(i), rows[i].tobytes()) for i in np.flatnonzero(rows.any(1))]
        columns = list(zip(*lengths, strict=True)) if lengths else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "n", "part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"kind": table.column("kind")[:1], "n": table.column("n")[:1], "part": table.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    schema = "kind string, n int, part int, bits binary"
    partial = in_small_batches(text_bytes(items, "_item", "_text")).mapInArrow(run, schema)
    tables: dict[tuple[str, int], np.ndarray] = {}
    for r in partial.groupBy("kind", "n", "part").applyInArrow(join, schema).toLocalIterator():  # four tables of TABLE_BITS at most
        table = tables.setdefault((r.kind, r.n), np.zeros((TABLE_BITS // 8 // TABLE_ROW, TABLE_ROW), np.uint8))
        table[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return {k: t.ravel() for k, t in tables.items()}


def in_table(table: np.ndarray):
    return lambda x: (table[(x >> np.uint64(3)) % np.uint64(len(table))] >> (x & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, keep_row: bool) -> DataFrame:
    """The same for a benchmark of any size: documents' windows that pass its bit tables are joined with its windows."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(bit_tables(items))

    def item_windows():
        def piece(batch):
            t = Texts.of([x or b"" for x in batch.column(1).to_pylist()])
            rows = [(n, b" ".join(t.spelled(i, n)), int(t.text[i])) for n, at in t.windows().items() for i in at.tolist()]
            sizes, words, whose = zip(*rows, strict=True) if rows else ([], [], [])
            return {"n": sizes, "words": words, "item": batch.column(0).take(pa.array(whose, pa.int64()))}

        return piece

    windows = materialise(map_pieces(text_bytes(items, "_item", "_text"), item_windows, "n int, words binary, item string", PIECE_BYTES).distinct(), "windows")
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # WINDOW at most
    chosen = text_and_row(docs, id_col, text_col)
    rows = materialise(chosen.select("_id", "_bytes", "_row", F.monotonically_increasing_id().alias("_key")), "documents")  # written, so keys stay when a task runs again

    def doc_windows():
        tests = {k: in_table(v) for k, v in tables.value.items()}

        def piece(batch):
            t = Texts.of([x or b"" for x in batch.column(1).to_pylist()])
            out: list[list] = [[] for _ in range(len(t.cut) - 1)]
            for n in sizes:
                near = t.near(n, tests["print", WINDOW if n == WINDOW else 0])
                near = near[tests["window", WINDOW if n == WINDOW else 0](gram_hashes_at(t.words, near, n))]
                for d, i in zip(t.text[near].tolist(), near.tolist(), strict=True):
                    out[d].append({"n": n, "at": i - int(t.cut[d]), "words": b" ".join(t.spelled(i, n))})
            return {"_key": batch.column(0), "n_words": np.diff(t.cut), "found": out}

        return piece

    looked = map_pieces(rows.select("_key", "_bytes"), doc_windows, "_key long, n_words long, found array<struct<n:int,at:int,words:binary>>", PIECE_BYTES)
    looked = materialise(looked, "looked")
    spread = looked.select("_key", F.explode("found").alias("w")).select("_key", "w.*").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    known = windows.select("words").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    hits = materialise(spread.join(known, ["words", "_salt"], "left_semi"), "hits")
    ranges = hits.groupBy("_key").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n")).cast("long").alias("b"))).alias("_ranges"))
    # the items of a window are one list, and each document asks for a window once
    asked = hits.select("_key", "words").distinct()
    lists = asked.select("words").distinct().join(windows.where("item is not null"), ["words"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    named = asked.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS))).join(lists, ["words", "_salt"]).groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counted = looked.select("_key", "n_words").join(ranges, "_key", "left").join(named, "_key", "left")
    counted = counted.select("_key", "n_words", F.coalesce(covered("_ranges"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    kept = ["_id", "_row"] if keep_row else ["_id"]
    return rows.select(*kept, "_key").join(counted, "_key").select(*kept, "n_words", "n_hit", "items")


def covered(ranges: str):
    """Words in the union of half-open ranges."""
    zero = F.lit(0).cast("long")
    step = F.aggregate(
        F.array_sort(ranges),
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda a, r: F.struct((a["n"] + F.greatest(zero, r["b"] - F.greatest(a["end"], r["a"]))).alias("n"), F.greatest(a["end"], r["b"]).alias("end")),
    )
    return step["n"]
