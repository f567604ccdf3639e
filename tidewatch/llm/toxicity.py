"""Toxicity: texts are restored by a noisy channel (deobfuscate), then scored by the words that they hold.

1. The character model counts the trigrams of all documents, in one pass whose result has a fixed size.
2. About TRAIN_ROWS labelled texts and TRAIN_BYTES of text at most, chosen by a hash, are restored. Words and beginnings
   of words that are prominent in toxic texts more often than chance allows (a likelihood ratio test over texts, near
   copies counting once) are chosen; those that clean texts hardly hold at all are sure ones. A text over
   TRAIN_TEXT_BYTES is not learnt from.
3. A logistic regression weighs how many chosen words a text has, their share of its words, and whether one is sure.
4. Every whole text is restored under the character model, to which the chosen words are added, and scored.

Defined results: null and empty texts have the score of a text without any chosen word; without labelled rows of both
kinds all scores are the share of label 1 (0 if there are no labels); repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held, in_small_batches, map_pieces, slices, text_bytes
from .deobfuscate import STRIP, SYMBOLS, Restorer, language_model, strips, trigram_counts

TRAIN_ROWS = 4_000
TRAIN_BYTES = 24 << 20
TRAIN_TEXT_BYTES = 1 << 20
#: Least likelihood ratio (twice its logarithm), least number of toxic texts, least share of them, and that of a sure word.
LEAST_RATIO, LEAST_TEXTS, LEAST_SHARE, SURE_SHARE = 24.0, 4, 0.6, 0.95
MOST_WORDS = 512
#: A word is prominent in a text if it is one of so many words at least.
PROMINENT = 200
#: Lengths of beginnings of words.
BEGINNINGS = range(4, 8)
#: Strength of the ridge penalty, and the most steps of Newton's method.
RIDGE = 0.1
STEPS = 30
PIECE_BYTES = 1 << 20

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes, restorer: Restorer) -> Counter:
    """How often each word occurs in a whole text as restored."""
    found: Counter = Counter()
    for strip in strips(text):
        found.update(WORD.findall(restorer.restored(strip).decode(errors="replace").lower()))
    return found


@lru_cache(1 << 18)
def names_of(word: str) -> tuple[str, ...]:
    """What a word may be chosen as: itself, and each of its beginnings, marked by a hyphen."""
    return (word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n])


def count_characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Trigrams of characters over all whole texts: each task sends its sums, the result has a number for each trigram."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for piece in slices(batch, STRIP):
                texts = [x or b"" for x in piece.column(1).to_pylist()]
                for group in [texts] if sum(map(len, texts)) <= 2 * STRIP else [[s] for x in texts for s in strips(x)]:
                    total += trigram_counts(group)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    partial = in_small_batches(text_bytes(docs, id_col, text_col)).mapInArrow(run, "gram int, n long")
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in partial.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # SYMBOLS ** 3 rows at most
        out[r.gram] = r.n
    return out


@dataclass
class ToxicityModel:
    characters: list[list[float]]
    chosen: dict[str, bool] = field(default_factory=dict)  # whether it is sure
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    offset: float = 0.0

    def hits(self, words: Counter) -> dict[str, bool]:
        """The words of a text that are chosen, and whether they are sure."""
        return {w: any(self.chosen[x] for x in known) for w in words if (known := [x for x in names_of(w) if x in self.chosen])}

    def features(self, words: Counter) -> list[float]:
        hits = self.hits(words)
        n = sum(words[w] for w in hits)
        return [math.log1p(n), math.log1p(100 * n / max(1, words.total())), float(any(hits.values()))]

    def score(self, words: Counter) -> float:
        z = self.offset + sum(a * b for a, b in zip(self.weights.tolist(), self.features(words), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def signature(text: bytes) -> int:
    """The smallest hash over runs of three words: near copies mostly share it."""
    w = text.split()
    return min((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def likelihood_ratio(a: int, n1: int, b: int, n0: int) -> float:
    """Twice the logarithm, for a of n1 and b of n0."""
    out = 0.0
    for k, n in ((a, n1), (b, n0)):
        for seen, expected in ((k, (a + b) * n / (n0 + n1)), (n - k, n - (a + b) * n / (n0 + n1))):
            out += 2 * seen * math.log(seen / expected) if seen else 0.0
    return out


def choose_words(texts: list[Counter], labels: list[int], groups: list[int]) -> dict[str, bool]:
    """Words and beginnings that are prominent in toxic texts, the surest first, and whether clean ones hardly hold them.

    Texts of one group and label count once.
    """
    firsts = {(y, g): own for own, y, g in zip(reversed(texts), reversed(labels), reversed(groups), strict=True)}

    def named(own: Counter, among=None) -> Counter:
        counts: Counter = Counter()
        for w, n in own.items():
            for x in names_of(w):
                if among is None or x in among:
                    counts[x] += n
        return counts

    prominent, held_by = (Counter(), Counter()), (Counter(), Counter())
    total = [sum(y == label for y, _ in firsts) for label in (0, 1)]
    toxic = Counter(x for (y, _), own in firsts.items() if y for x, n in named(own).items() if n * PROMINENT >= own.total())
    candidates = {x for x, a in toxic.items() if a >= LEAST_TEXTS}
    for (y, _), own in firsts.items():
        counts = named(own, candidates)
        held_by[y].update(counts.keys())
        prominent[y].update(x for x, n in counts.items() if n * PROMINENT >= own.total())
    out = []
    for x in candidates:
        a, b = prominent[1][x], prominent[0][x]
        if a >= LEAST_SHARE * (a + b) and (ratio := likelihood_ratio(a, total[1], b, total[0])) >= LEAST_RATIO:
            out.append((-ratio, x, held_by[1][x] >= SURE_SHARE * (held_by[0][x] + held_by[1][x])))
    return {x: sure for _, x, sure in sorted(out)[:MOST_WORDS]}


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; the offset is not penalised."""
    full = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(full.shape[1], RIDGE)
    penalty[-1] = 1e-6
    beta = np.zeros(full.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (y - p) - penalty * beta
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), gradient)
        beta += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(rows: list[tuple[bytes, int]], counts: np.ndarray) -> ToxicityModel:
    """Choose words and fit the regression on restored texts."""
    plain = language_model(counts)
    labels = [y for _, y in rows]
    if not rows or min(labels) == max(labels):
        share = float(np.mean(labels)) if rows else 0.0
        return ToxicityModel(plain, offset=math.log(share / (1 - share)) if 0 < share < 1 else 700.0 if share else -700.0)
    restorer = Restorer(plain)
    texts = [words_of(x, restorer) for x, _ in rows]
    chosen = choose_words(texts, labels, [signature(x) for x, _ in rows])
    model = ToxicityModel(language_model(counts, [x.rstrip("-") for x in chosen]), chosen)
    model.weights, model.offset = regression(np.array([model.features(x) for x in texts]), np.array(labels, float))
    return model


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Count characters over all documents; fit on a bounded sample of the labelled rows that are given."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_y"))
    sample = bounded_sample(known, id_col, TRAIN_ROWS, seed=11)
    texts = docs.where(F.octet_length(text_col) <= TRAIN_TEXT_BYTES).select(id_col, F.col(text_col).cast("binary").alias("_t"))
    chosen = bounded_sample(texts.join(F.broadcast(sample), id_col), id_col, TRAIN_ROWS, 1111, "_t", TRAIN_BYTES)
    rows = chosen.select(F.xxhash64(id_col, F.lit(11)).alias("h"), "_t", "_y").collect()
    ordered = sorted((r["h"], bytes(r["_t"]), int(r["_y"] == 1)) for r in rows)
    return fit([(text, y) for _, text, y in ordered], count_characters(docs, id_col, text_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, found): the probability of label 1 for every whole text, and the chosen words that it holds as restored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("restorer", uuid.uuid4().hex)

    def make():
        model = shared.value
        restorer = held(key, lambda: Restorer(model.characters))

        def piece(batch):
            found = [words_of(x or b"", restorer) for x in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "score": [model.score(x) for x in found], "found": [sorted(model.hits(x)) for x in found]}

        return piece

    return map_pieces(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, score double, found array<string>", PIECE_BYTES)
