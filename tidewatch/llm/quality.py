"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as blocks of 8 bytes; every two neighbouring blocks are a chunk, so chunks of 16 bytes overlap by half
and cover the whole text. Each filter is a learned linear map of a chunk's byte embeddings; its largest value over all
chunks is kept, and a small layer combines the filters into one probability.

Fitting takes about TRAIN_ROWS labelled texts and TRAIN_BYTES of text at most, chosen by a hash; a text over
TRAIN_TEXT_BYTES is not learnt from. It ends early once the loss of an epoch no longer falls. Scoring takes every whole
text, in strips of bounded size. Defined results: null and empty texts are scored as a text of padding; without labelled rows of both
kinds all scores are the share of label 1 (0.5 if none); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_pieces, text_bytes

BLOCK = 8
WIDTH = 8
FILTERS = 48
HIDDEN = 16
PAD = 256
TRAIN_ROWS = 4_000
TRAIN_BYTES = 24 << 20
TRAIN_TEXT_BYTES = 1 << 20
EPOCHS = 10
BATCH_TEXTS = 32
PIECE_BYTES = 1 << 20
#: Blocks whose filters are looked at together in scoring, and the least fall of the loss for which fitting goes on.
STRIP = 1 << 16
LEAST_FALL = 0.02


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes in rows of BLOCK with padding up to a row and one more row after each text; first row of each text."""
    rows = [-(-len(x) // BLOCK) + 2 for x in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(rows, out=first[1:])
    out = np.full(first[-1] * BLOCK, PAD, np.int16)
    for x, at in zip(texts, first.tolist()):  # noqa: B905  first has one more
        out[at * BLOCK : at * BLOCK + len(x)] = np.frombuffer(x, np.uint8)
    return out.reshape(-1, BLOCK), first


@dataclass
class QualityModel:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Every filter's value on every chunk: row i is the chunk of blocks i and i + 1."""
        x = self.p["embed"][codes].reshape(len(codes), BLOCK * WIDTH)
        left, right = x @ self.p["left"], x @ self.p["right"]
        left[:-1] += right[1:]
        return left[:-1]

    def pooled(self, texts: list[bytes]):
        codes, first = blocks(texts)
        r = self.responses(codes)
        ends = first[1:] - 1  # the chunk across two texts is left out
        bounds = np.stack([first[:-1], ends], axis=1).ravel()
        bounds = bounds[:-1] if bounds[-1] >= len(r) else bounds
        return np.maximum.reduceat(r, bounds, axis=0)[::2], r, codes, first

    def tops(self, texts: list[bytes]) -> np.ndarray:
        """Every filter's largest value on each text, chunk by chunk in strips of blocks."""
        codes, first = blocks(texts)
        top = np.full((len(texts), FILTERS), -np.inf, np.float32)
        for at in range(0, len(codes) - 1, STRIP):
            r = self.responses(codes[at : at + STRIP + 1])
            begin = np.searchsorted(first, at, side="right") - 1
            end = np.searchsorted(first, at + len(r), side="left")  # texts that have a row in the strip
            for i in range(begin, min(end, len(texts))):
                low, high = max(first[i] - at, 0), min(first[i + 1] - 1 - at, len(r))  # the chunk across two texts is left out
                if high > low:
                    np.maximum(top[i], r[low:high].max(0), out=top[i])
        return top

    def combine(self, top: np.ndarray) -> np.ndarray:
        h = np.maximum(top + self.p["bias"], 0) @ self.p["mix"] + self.p["mix_bias"]
        z = np.tanh(h) @ self.p["out"] + self.p["out_bias"]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.combine(self.tops(texts))

    def loss(self, texts: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss and its gradient, which reaches a filter through the one chunk where it is largest."""
        p = self.p
        top, r, codes, first = self.pooled(texts)
        act = top + p["bias"]
        on = np.maximum(act, 0)
        h = np.tanh(on @ p["mix"] + p["mix_bias"])
        z = h @ p["out"] + p["out_bias"]
        dz = (1 / (1 + np.exp(-z)) - y) / len(texts)
        dh = dz[:, None] * p["out"] * (1 - h * h)
        dact = dh @ p["mix"].T * (act > 0)
        g = {"out": h.T @ dz, "out_bias": dz.sum(keepdims=True), "mix": on.T @ dh, "mix_bias": dh.sum(0), "bias": dact.sum(0)}
        where = np.stack([a + r[a : b - 1].argmax(0) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
        g["embed"] = np.zeros_like(p["embed"])
        for side, shift in (("left", 0), ("right", 1)):
            c = codes[where + shift]  # texts, filters, block
            x = p["embed"][c].reshape(*where.shape, BLOCK * WIDTH)
            g[side] = np.einsum("df,dfi->if", dact, x)
            dx = dact[..., None] * p[side].T
            flat = dx.reshape(-1, WIDTH)
            for w in range(WIDTH):
                g["embed"][:, w] += np.bincount(c.ravel(), flat[:, w], 257)
        g["embed"][PAD] = 0
        return float(np.mean(np.logaddexp(0, z) - y * z)), g


def batches(sizes: list[int], order: np.ndarray) -> list[np.ndarray]:
    """Places in `order` cut into batches of at most BATCH_TEXTS texts and PIECE_BYTES of text, or one longer text."""
    out, at, size = [], 0, 0
    for i, x in enumerate(order.tolist()):
        if i > at and (i - at >= BATCH_TEXTS or size + sizes[x] > PIECE_BYTES):
            out.append(order[at:i])
            at, size = i, 0
        size += sizes[x]
    return [*out, order[at:]]


def fit(rows: list[tuple[bytes, int]], seed: int = 4) -> QualityModel:
    """Minimise the log loss by Adam."""
    labels = np.array([y for _, y in rows], np.float32)
    if len(rows) < 2 or labels.min() == labels.max():
        return QualityModel(constant=float(labels.mean()) if len(rows) else 0.5)
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    inputs = BLOCK * WIDTH
    p = {
        "embed": normal(257, WIDTH, scale=0.5), "left": normal(inputs, FILTERS, scale=0.12), "right": normal(inputs, FILTERS, scale=0.12), "bias": np.zeros(FILTERS, np.float32),
        "mix": normal(FILTERS, HIDDEN, scale=0.2), "mix_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
    }
    p["embed"][PAD] = 0
    model, moment, n = QualityModel(p), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}, 0
    sizes = [len(x) for x, _ in rows]
    steps, best = EPOCHS * -(-len(rows) // BATCH_TEXTS), np.inf
    for _ in range(EPOCHS):
        total = 0.0
        for pick in batches(sizes, rng.permutation(len(rows))):
            loss, g = model.loss([rows[i][0] for i in pick], labels[pick])
            total += loss * len(pick) / len(rows)
            n += 1
            rate = 4e-3 * max(0.1, 1 - 0.9 * n / steps)
            for k, v in p.items():
                a, b = moment[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] * g[k] - b)
                v -= (rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        if total > best * (1 - LEAST_FALL):
            break
        best = total
    return model


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a bounded sample of the labelled rows that are given: the caller leaves out what is held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_y"))
    sample = bounded_sample(known, id_col, TRAIN_ROWS, seed=4)
    texts = docs.where(F.octet_length(text_col) <= TRAIN_TEXT_BYTES).select(id_col, F.col(text_col).cast("binary").alias("_t"))
    chosen = bounded_sample(texts.join(F.broadcast(sample), id_col), id_col, TRAIN_ROWS, 44, "_t", TRAIN_BYTES)
    rows = chosen.select(F.xxhash64(id_col, F.lit(4)).alias("h"), "_t", "_y").collect()
    return fit([(bytes(r["_t"]), r["_y"]) for r in sorted(rows, key=lambda r: (r["h"], bytes(r["_t"]), r["_y"]))])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def piece(batch):
            return {id_col: batch.column(0), "score": model.scores([x or b"" for x in batch.column(1).to_pylist()])}

        return piece

    return map_pieces(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, score double", PIECE_BYTES)
