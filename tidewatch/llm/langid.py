"""Language identification by a string kernel with landmarks.

The kernel of two texts counts the byte n-grams (n = 1 to 3, hashed to a fixed number of buckets) that are present in
both, over the root of the product of their numbers. Landmark texts give Nystrom features K(x, L) K(L, L)^(-1/2), on
which one ridge regression per language is fitted against the rest. The kernel is linear in presence vectors, so
landmarks and regressions fold into one matrix, and a batch of texts is scored by one product with it.

Fitting takes about TRAIN_ROWS labelled texts and TRAIN_BYTES of text at most, chosen by a hash; a text over
TRAIN_TEXT_BYTES is not learnt from. Scoring takes every whole text. Defined results: a null text, or one without a
letter (a character of a Unicode letter category), is `und` with score 0; without any labelled text all are `und`;
repeated rows give repeated results; other columns are ignored, or kept as one struct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_pieces, text_and_row, text_bytes, with_row
from .words import join_texts

BUCKETS = 1 << 15
ORDERS = 3
TRAIN_ROWS = 3_000
TRAIN_BYTES = 24 << 20
TRAIN_TEXT_BYTES = 2 << 20
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts scored by one matrix product, and bytes looked at together.
BATCH_TEXTS = 96
PIECE_BYTES = 1 << 20

#: Letters, and a few number signs that are sorted out one by one.
MAY_BE_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of one text whose n-grams are looked at together; longer texts are taken in strips that overlap.
STRIP = 1 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAY_BE_LETTER.finditer(text))


def presence(texts: list[bytes]) -> np.ndarray:
    """A row per text: which buckets its n-grams fall into."""
    out = np.zeros((len(texts), BUCKETS), bool)
    parts, rows, size = [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, max(1, len(x)), STRIP):
            parts.append(x[at : at + STRIP + ORDERS - 1])
            rows.append(i)
            size += len(parts[-1])
            if size >= STRIP:
                _mark(out, parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        _mark(out, parts, rows)
    return out


def _mark(out: np.ndarray, texts: list[bytes], rows: list[int]) -> None:
    """Set the buckets of the n-grams of each text in its row of `out`."""
    data, edges = join_texts(texts)
    flat = out.ravel()
    codes = _LOWER[data]
    row = np.repeat(np.array(rows, np.int64) * BUCKETS, np.diff(edges))
    last = np.repeat(edges[1:] - 1, np.diff(edges))  # where the text of each byte ends
    gram = np.zeros(len(data), np.uint32)
    place = np.arange(len(data))
    for n in range(ORDERS):
        if len(data) <= n:
            break
        gram = gram[: len(data) - n] << np.uint32(8) | codes[n:]
        inside = place[: len(gram)] + n < last[: len(gram)]
        hashed = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
        flat[row[: len(gram)][inside] + hashed[inside]] = True


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets by languages
    offset: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = presence(texts)
        size = np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        return x.astype(np.float32) @ self.weights / size + self.offset


def fit(rows: list[tuple[bytes, str]]) -> LanguageModel:
    """Nystrom features of landmarks drawn evenly from the languages, then ridge regressions in closed form."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    chosen, each = [], -(-LANDMARKS // len(languages))
    for lang in languages:
        chosen += [i for i, (_, own) in enumerate(rows) if own == lang][:each]

    def vectors(texts: list[bytes]) -> np.ndarray:
        x = presence(texts).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    landmarks = vectors([rows[i][0] for i in chosen])
    near = [vectors([t for t, _ in rows[at : at + BATCH_TEXTS]]) @ landmarks.T for at in range(0, len(rows), BATCH_TEXTS)]  # a batch of vectors at a time
    values, axes = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = axes[:, keep] / np.sqrt(values[keep])
    features = np.concatenate(near).astype(np.float64) @ root
    targets = np.where(np.array([own for _, own in rows])[:, None] == np.array(languages), 1.0, -1.0)
    mean, centre = features.mean(0), targets.mean(0)
    gram = (features - mean).T @ (features - mean)
    slope = np.linalg.solve(gram + RIDGE * len(rows) * np.eye(len(gram)), (features - mean).T @ (targets - centre))
    return LanguageModel(languages, (landmarks.T @ (root @ slope)).astype(np.float32), (centre - mean @ slope).astype(np.float32))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the rows that are given: the caller leaves out what is held out."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= TRAIN_TEXT_BYTES)).select(id_col, text_col, lang_col)
    sample = bounded_sample(known, id_col, TRAIN_ROWS, 6, text_col, TRAIN_BYTES)
    rows = sample.select(F.xxhash64(id_col, F.lit(6)).alias("h"), F.col(text_col).cast("binary").alias("t"), F.col(lang_col).alias("l")).collect()
    return fit([(bytes(r["t"]), r["l"]) for r in sorted(rows, key=lambda r: (r["h"], bytes(r["t"]), r["l"]))])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text; with keep_row (_id, _row, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def piece(batch):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            names, scores = [], []
            for at in range(0, len(texts), BATCH_TEXTS):
                part = texts[at : at + BATCH_TEXTS]
                s = model.scores(part)
                best = s.argmax(1) if s.shape[1] else np.zeros(len(part), int)
                for i, x in enumerate(part):
                    found = s.shape[1] and has_letter(x.decode())
                    names.append(model.languages[best[i]] if found else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, (s[i, best[i]] + 1) / 2))) if found else 0.0)
            return {"_id": batch.column(0), "_row": batch.column(2) if keep_row else None, "lang_pred": names, "score": scores}

        return piece

    if keep_row:
        return map_pieces(text_and_row(docs, id_col, text_col), make, with_row(docs, id_col, "lang_pred string, score double"), PIECE_BYTES)
    found = map_pieces(text_bytes(docs, id_col, text_col), make, f"_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double", PIECE_BYTES)
    return found.withColumnRenamed("_id", id_col)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether a row is kept from learning: crc32 of the id as text, modulo `modulus`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
