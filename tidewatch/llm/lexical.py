"""Ranked lexical search: the best documents for each item, by norm buckets in the manner of LEMP.

A document is a vector of impacts over the items' terms, an item a vector of its terms' repeats; the score is their
weighted inner product. Both are scaled by the root of a term's weight, so that the product of their lengths bounds the
score.

1. One pass over the documents counts the terms of every whole text and keeps those that some item has.
2. Impact vectors are put in the order of their length. A bucket is a run of vectors of like length.
3. The longest vectors are searched first. The score at the last place of each item is its threshold from then on.
   A bucket is left for the items whose length times the bucket's longest is under their threshold (Cauchy-Schwarz);
   vectors under every item's threshold are not even read.
4. Inside a bucket an item looks at its few heaviest coordinates. What the others can add is bounded by the product of
   the lengths that remain, and by the largest of each coordinate in the bucket; only vectors that may still reach the
   threshold are scored, exactly and in integers.
5. Each task keeps the best of an item that it has met, and two rounds of windows make one ranking of these.

The items are the stated query set: they are taken in blocks of bounded size, each broadcast with its vocabulary and
run against all documents.

Defined results: null texts and texts without terms match nothing and count in no statistic; repeated documents are
ranked each; equal rows of the benchmark are one item, different texts of one id are ranked apart; items without terms
or without matches have no rows; equal scores go by ascending id, null ids first; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import in_small_batches, map_pieces, materialise, started, text_bytes

TOP = 20
#: Bytes of item text in one block.
BLOCK_BYTES = 4 << 20
#: Bytes of one text whose terms are looked at together.
STRIP = 4 << 20
#: Share of the documents that is searched first, to find thresholds.
FIRST = 1 / 32
#: Vectors and postings of one bucket, and the heaviest coordinates of an item that are looked at before the others.
BUCKET = 1_000
BUCKET_POSTINGS = 1 << 20
FOCUS = 24
#: Parts in which an item's candidates are ranked before they meet.
SALTS = 32
#: Bounds are taken a little higher than computed, so that rounding never loses a document.
SLACK = 1 + 1e-9

#: Letters, digits and everything beyond ASCII; a term is a longest run of them.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: bytes) -> Counter:
    """How often each term occurs; bytes.lower changes A-Z only. Long texts are taken in strips that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + STRIP
        if end < len(text) and (rest := TERM.match(text, end)):
            end = rest.end()
        found.update(TERM.findall(text[at:end].lower()))
        at = end
    return found


@dataclass
class Block:
    """Items with their terms as codes of one vocabulary."""

    ids: list
    terms: list[dict[int, int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        terms = [{vocabulary.setdefault(t, len(vocabulary)): n for t, n in terms_of(text).items()} for _, text in rows]
        return cls([x for x, _ in rows], terms, vocabulary)


@dataclass
class Search:
    """The items of a block as vectors: codes with the heaviest coordinate first, repeats times weight, coordinates, length."""

    ids: list
    codes: list[np.ndarray]
    gains: list[np.ndarray]
    coordinates: list[np.ndarray]
    length: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, block: Block, weights: np.ndarray) -> Search:
        codes, gains, coordinates = [], [], []
        for own in block.terms:
            c, n = np.array(list(own), np.int64), np.array(list(own.values()), np.int64)
            c, n = c[weights[c] > 0], n[weights[c] > 0]
            q = n * np.sqrt(weights[c])
            order = np.argsort(-q, kind="stable")
            codes.append(c[order])
            gains.append((n * weights[c])[order])
            coordinates.append(q[order])
        return cls(block.ids, codes, gains, coordinates, np.array([math.sqrt(q @ q) for q in coordinates]), weights)


@dataclass
class Bucket:
    """Vectors of like length: length, the postings of each code as slices of documents and impacts, its largest impact."""

    length: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    codes: np.ndarray
    edges: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, length: np.ndarray, sizes: np.ndarray, codes: np.ndarray, impacts: np.ndarray) -> Bucket:
        order = np.argsort(codes, kind="stable")
        docs = np.repeat(np.arange(len(sizes)), sizes)[order]
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        impacts = impacts[order]
        return cls(length, docs, impacts, codes[first], np.append(first, len(codes)), np.maximum.reduceat(impacts, first) if len(first) else first)

    def postings(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(place among `codes`, first, last) of the codes that occur here."""
        if not len(self.codes):
            return []
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = np.flatnonzero(self.codes[at] == codes)
        return list(zip(here.tolist(), self.edges[at[here]].tolist(), self.edges[at[here] + 1].tolist(), strict=True))

    def survivors(self, search: Search, item: int, threshold: float) -> np.ndarray:
        """The vectors that may reach the threshold by their heaviest coordinates and a bound on what the others can add.

        That is no more than the product of the lengths that remain, and no more than what they add where each is at its
        largest in the bucket.
        """
        codes, q = search.codes[item][:FOCUS], search.coordinates[item]
        others = search.codes[item][FOCUS:]
        most = sum(float(self.most[np.searchsorted(self.codes, others[i])]) * float(search.gains[item][FOCUS + i]) for i, _, _ in self.postings(others))
        seen, part, square = self.postings(codes), np.zeros(len(self.length)), np.zeros(len(self.length))
        if seen:
            docs = np.concatenate([self.docs[a:b] for _, a, b in seen])
            x = np.concatenate([self.impacts[a:b] * math.sqrt(search.weights[codes[i]]) for i, a, b in seen])
            part = np.bincount(docs, np.concatenate([np.full(b - a, q[i]) for i, a, b in seen]) * x, len(self.length))
            square = np.bincount(docs, x * x, len(self.length))
        rest = math.sqrt(float(q[FOCUS:] @ q[FOCUS:]))
        left = np.sqrt(np.maximum(self.length * self.length * SLACK - square, 0))
        return (part + np.minimum(rest * left, most)) * SLACK >= threshold

    def scores(self, search: Search, item: int, chosen: np.ndarray) -> np.ndarray:
        """The exact score of the chosen vectors, 0 for the others."""
        total = np.zeros(len(self.length), np.int64)
        for i, a, b in self.postings(search.codes[item]):
            docs = self.docs[a:b]  # each document once
            keep = chosen[docs]
            total[docs[keep]] += self.impacts[a:b][keep] * search.gains[item][i]
        return total


class Best:
    """The TOP best (score, document) of one item."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.rows = threshold, []

    def take(self, scores: np.ndarray, ids: list, top: int) -> None:
        """Add a bucket's scores above 0 that reach the threshold, keep the best `top` and raise the threshold."""
        at = np.flatnonzero(scores >= max(self.threshold, 1))
        if not len(at):
            return
        if len(at) > top:  # only those can stay that reach the last place of this bucket
            last = np.partition(scores[at], len(at) - top)[len(at) - top]
            at = at[scores[at] >= last]
        self.rows += [(int(scores[i]), ids[i]) for i in at.tolist()]
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        del self.rows[top:]
        if len(self.rows) == top:
            self.threshold = max(self.threshold, self.rows[-1][0])


def vectors(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """(id, n, codes, counts): the number of terms of each text that has any, and its terms among the vocabulary."""

    def make():
        vocabulary = block.value.vocabulary

        def piece(batch):
            n, codes, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms_of(text or b"")
                n.append(found.total())
                known = sorted((vocabulary[t], found[t]) for t in vocabulary.keys() & found.keys())
                codes.append([c for c, _ in known])
                counts.append([k for _, k in known])
            return {"_id": batch.column(0), "n": n, "codes": codes, "counts": counts}

        return piece

    schema = StructType([StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL("n long, codes array<int>, counts array<int>").fields])
    return materialise(map_pieces(text_bytes(docs, id_col, text_col), make, schema).where("n > 0"), "vectors")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def by_length(counted: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """(id, length, codes, impacts) of the vectors that are not empty, in descending order of length over all partitions."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def piece(batch):
            codes, counts = batch.column("codes"), batch.column("counts")
            c, tf = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.append(0, np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False)))
            m = np.array([75 + 25 * n * documents // total for n in batch.column("n").to_pylist()], np.int64)  # Python's integers have no bound
            x = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(edges)))
            squares = w[c] * x.astype(float) ** 2
            length = [math.sqrt(float(squares[a:b].sum())) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int64()))
            return {"_id": batch.column(0), "length": length, "codes": codes, "impacts": lists}

        return piece

    schema = StructType([counted.schema["_id"], *StructType.fromDDL("length double, codes array<int>, impacts array<long>").fields])
    found = map_pieces(counted.select("_id", F.lit(None).cast("binary").alias("_none"), "n", "codes", "counts"), make, schema).where("length > 0")
    return materialise(found.repartitionByRange(F.col("length").desc(), "_id").sortWithinPartitions(F.col("length").desc()), "by_length")


def buckets(batches):
    """(ids, Bucket) of runs of vectors."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            fits = int(np.searchsorted(np.cumsum(sizes[at:]), BUCKET_POSTINGS, side="right"))
            part = batch.slice(at, max(1, min(fits, BUCKET)))
            flat = lambda c, part=part: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part.column("_id").to_pylist(), Bucket.of(part.column("length").to_numpy(), sizes[at : at + part.num_rows], flat("codes"), flat("impacts"))
            at += part.num_rows


def search_vectors(found: DataFrame, search, thresholds: list[int], top: int) -> DataFrame:
    """(item, _id, score): the best of each item among some vectors, of each task its own; item is a place in the block."""
    kind = to_arrow_type(found.schema["_id"].dataType)

    def run(batches):
        known, best = started(lambda: search.value), [Best(t) for t in thresholds]
        for ids, bucket in buckets(batches):
            longest = float(bucket.length.max()) * SLACK
            now = np.array([b.threshold for b in best])
            for item in np.flatnonzero((known.length > 0) & (known.length * longest >= now)).tolist():
                chosen = bucket.survivors(known, item, best[item].threshold)
                if chosen.any():
                    best[item].take(bucket.scores(known, item, chosen), ids, top)
        rows = [(i, doc, score) for i, b in enumerate(best) for score, doc in b.rows]
        items, docs, scores = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, kind), pa.array(scores, pa.int64())], names=["item", "_id", "score"])

    schema = StructType([StructField("item", IntegerType()), found.schema["_id"], StructField("score", LongType())])
    return in_small_batches(found).mapInArrow(run, schema)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """rows with `rank`, the best `top` of each item: first within parts of an item's candidates, then over all."""
    order = [F.col("score").desc(), F.col("_id").asc_nulls_first()]
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    few = part.withColumn("_place", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item", "rank", "_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, id, score): the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("_item"), F.col(item_text).cast("binary").alias("_text")).distinct()
    size = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, math.ceil(1.5 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    schema = StructType([StructField(item_col, items.schema[item_col].dataType), StructField("rank", IntegerType()), StructField(id_col, docs.schema[id_col].dataType), StructField("score", LongType())])
    results = [search_block(spark, docs, asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b), schema, id_col, text_col, top) for b in range(blocks)]
    return reduce(DataFrame.unionByName, results)


def search_block(spark, docs: DataFrame, asked: DataFrame, schema: StructType, id_col: str, text_col: str, top: int) -> DataFrame:
    rows = sorted(((r[0], bytes(r[1])) for r in asked.collect()), key=lambda r: (r[1], str(r[0])))  # BLOCK_BYTES of text at most
    block = Block.of(rows)
    counted = vectors(docs, spark.sparkContext.broadcast(block), id_col, text_col)
    documents, total = counted.agg(F.count("*"), F.sum("n")).first()
    holding = np.zeros(max(1, len(block.vocabulary)), np.int64)
    for r in counted.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row a term of the block at most
        holding[r.code] = r["count"]
    weights = np.array([weight(documents, int(k)) if k else 0 for k in holding], np.int64)  # a term that no document holds adds nothing
    search = Search.of(block, weights)
    shared = spark.sparkContext.broadcast(search)
    ordered = by_length(counted, weights, documents, total or 1)
    cut = ordered.agg(F.percentile_approx("length", 1 - FIRST, 1000)).first()[0]
    first = materialise(ranked(search_vectors(ordered.where(F.col("length") >= (cut or 0)), shared, [0] * len(rows), top), top), "first")
    thresholds = [0] * len(rows)
    for r in first.where(F.col("rank") == top).select("item", "score").collect():  # a row an item of the block at most
        thresholds[r.item] = r.score
    reach = [t / (n * SLACK) for t, n in zip(thresholds, search.length.tolist(), strict=True) if n]
    rest = ordered.where((F.col("length") < (cut or 0)) & (F.col("length") >= (min(reach, default=0.0) / SLACK)))
    both = first.select("item", "_id", "score").unionByName(search_vectors(rest, shared, thresholds, top))
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], StructType([StructField("item", IntegerType()), schema[0]]))
    return ranked(both, top).join(F.broadcast(names), "item").select(schema[0].name, "rank", F.col("_id").alias(schema[2].name), "score")


#: The same ranking from all pairs of an item's and a document's terms.
ORACLE_SQL = r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), item_terms as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), counts as (select doc_id, term, count(*) as tf from doc_terms group by doc_id, term),
lengths as (select doc_id, cast(sum(tf) as bigint) as n from counts group by doc_id),
totals as (select count(*) as all_docs, cast(sum(n) as bigint) as all_terms from lengths),
holding as (select term, count(*) as df from counts group by term),
weights as (select term, cast(floor(1000 * ln(cast(2 * all_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from holding, totals),
scored as (
  select i.item_id, c.doc_id, cast(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * l.n * t.all_docs) // t.all_terms)))) as bigint) as score
  from item_terms i join counts c on c.term = i.term join weights w on w.term = i.term join lengths l on l.doc_id = c.doc_id, totals t
  group by i.item_id, c.doc_id
), placed as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, cast(place as int) as rank, doc_id, score from placed where place <= 20
"""
