"""A linear-chain conditional random field over word shapes, trained on the driver, decoded in numpy batches.

A token is described by the shape of its bytes: how many digits, letters, dots and hyphens it has, whether it has an at
sign, a leading plus, brackets or other signs, how it is capitalised, and whether it is one of a few cue words. The
fields make one whole code; emissions are sums of feature weights of the token before, the token itself and the one
after it.

Decoding is exact. In the best tags no stretch of other tags than 0 scores less than tag 0 throughout. A token is surely
plain if by bounds every stretch that holds it does; only what lies between such tokens goes through Viterbi's steps, all
of it side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import word_hashes

#: Cue words by class, in lower case.
CUES = {
    "title": "mr mrs ms miss dr prof sir herr frau señor señora mme monsieur madame",
    "street": "street st avenue ave road rd lane ln drive boulevard blvd court square terrace straße strasse weg platz rue calle",
    "phone": "phone tel telephone call fax mobile cell telefon téléphone teléfono whatsapp",
    "identity": "ssn social security passport insurance nino dni steuernummer",
    "order": "order invoice ticket ref reference version isbn sku serial part item bestellung factura commande",
    "name": "name named signed sincerely regards nom nombre",
}
#: Shape fields and the number of values of each.
FIELDS = {"digits": 10, "letters": 4, "at": 2, "dots": 5, "hyphens": 4, "plus": 2, "brackets": 2, "signs": 2, "capital": 3, "cue": len(CUES) + 1}
PAIRS = [("digits", "letters"), ("digits", "hyphens"), ("digits", "brackets"), ("digits", "dots"), ("letters", "capital"), ("letters", "at"), ("at", "dots")]
_DIGIT_STEP = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 7, 7, 8, 8, 8, 8, 9], np.int64)

_BYTE = np.arange(256)
_CLASS = {
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "letters": ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128),
    "dots": _BYTE == 46,
    "hyphens": _BYTE == 45,
    "at": _BYTE == 64,
    "brackets": (_BYTE == 40) | (_BYTE == 41),
}
_CLASS["signs"] = ~(np.sum(list(_CLASS.values()), axis=0).astype(bool) | (_BYTE == 43) | (_BYTE == 44))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
SPACE = (_BYTE == 32) | (_BYTE >= 9) & (_BYTE <= 13)


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the cue words, and the class of each."""
    found = {}
    for i, words in enumerate(CUES.values()):
        for w in words.split():
            found[int(word_hashes(np.frombuffer(w.encode(), np.uint8), _CLASS["letters"])[2][0])] = i + 1
    keys = sorted(found)
    return np.array(keys, np.uint64), np.array([found[k] for k in keys], np.int64)


CUE_HASHES, CUE_CLASSES = _cue_table()


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes without white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cues(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cue class of tokens whose first run of letters is a cue word and their only one, 0 for others."""
    low, high, hashed = word_hashes(data, _CLASS["letters"])
    at = np.minimum(np.searchsorted(CUE_HASHES, hashed), len(CUE_HASHES) - 1)
    hit = np.flatnonzero(CUE_HASHES[at] == hashed)
    out = np.zeros(len(start), np.int64)
    owner = np.searchsorted(start, low[hit], side="right") - 1
    first = np.searchsorted(low, start[owner])
    alone = (first == hit) & (np.append(low, len(data) + 1)[hit + 1] >= end[owner])
    out[owner[alone]] = CUE_CLASSES[at[hit[alone]]]
    return out


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape code of every token."""

    def count(flags):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=total[1:])
        return total[end] - total[start]

    first = data[start]
    letters = count(_CLASS["letters"])
    upper = count(_UPPER)
    values = {
        "digits": _DIGIT_STEP[np.minimum(count(_CLASS["digits"]), 17)],
        "letters": np.searchsorted([1, 2, 4], letters, side="right"),
        "at": count(_CLASS["at"]) > 0,
        "dots": np.minimum(count(_CLASS["dots"]), 4),
        "hyphens": np.minimum(count(_CLASS["hyphens"]), 3),
        "plus": first == 43,
        "brackets": count(_CLASS["brackets"]) > 0,
        "signs": count(_CLASS["signs"]) > 0,
        "capital": np.where(upper == 0, 0, np.where((upper == 1) & _UPPER[first], 1, 2)),
        "cue": cues(data, start, end),
    }
    code = np.zeros(len(start), np.int64)
    for name, n in FIELDS.items():
        code = code * n + values[name]
    return code


FEATURES = sum(FIELDS.values()) + sum(FIELDS[a] * FIELDS[b] for a, b in PAIRS)


def features_of(code: np.ndarray) -> np.ndarray:
    """Feature numbers of each code."""
    values, rest = {}, code
    for name, n in reversed(FIELDS.items()):
        values[name], rest = rest % n, rest // n
    columns, total = [], 0
    for name, n in FIELDS.items():
        columns.append(values[name] + total)
        total += n
    for a, b in PAIRS:
        columns.append(values[a] * FIELDS[b] + values[b] + total)
        total += FIELDS[a] * FIELDS[b]
    return np.stack(columns, axis=1)


@dataclass
class Crf:
    """Feature weights (features by tags) of the token before, the token and the token after; steps and first tags."""

    tags: list[str]
    before: np.ndarray
    here: np.ndarray
    after: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def margins(self) -> tuple[float, float]:
        """The most that transitions can add to a stretch of other tags than 0 against tag 0 throughout: once, and for each token."""
        step = self.step.astype(np.float64)
        enter = max((step[0, 1:] - step[0, 0]).max(), (self.first[1:] - self.first[0]).max())
        leave = max((step[1:, 0] - step[0, 0]).max(), 0.0)
        inner = (step[1:, 1:] - step[0, 0]).max()
        return float(enter + leave - inner), float(inner)

    def decode(self, code: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags of all tokens; `line` numbers the lines, which are chains of their own."""
        tags = np.zeros(len(code), np.int64)
        if not len(code):
            return tags
        known, at = np.unique(code, return_inverse=True)
        number = features_of(known)
        weigh = lambda w: (lambda s: s - s[:, :1])(w[number].sum(1))  # noqa: E731  against tag 0
        before, here, after = weigh(self.before), weigh(self.here), weigh(self.after)
        same = line[1:] == line[:-1]
        bound = here[:, 1:].max(1)[at]
        bound[1:] += np.where(same, before[:, 1:].max(1)[at[:-1]], 0)
        bound[:-1] += np.where(same, after[:, 1:].max(1)[at[1:]], 0)
        once, each = self.margins()
        new_line = np.append(0, np.cumsum(~same)) * 1e5  # no stretch crosses lines
        total = np.append(0.0, np.cumsum(bound + each))
        low = np.minimum.accumulate(total[:-1] - new_line)
        high = np.maximum.accumulate((total[1:] - new_line)[::-1])[::-1]
        open_to = high - low + once >= -1e-3  # the best stretch that holds the token
        if not open_to.any():
            return tags
        taken = open_to.copy()
        taken[:-1] |= open_to[1:] & same
        taken[1:] |= open_to[:-1] & same
        place = np.flatnonzero(taken)
        score = here[at[place]]
        has = (place > 0) & np.append(False, same)[place]
        score[has] += before[at[place[has] - 1]]
        has_next = np.append(same, False)[place]
        score[has_next] += after[at[place[has_next] + 1]]
        score[~open_to[place], 1:] = -1e9  # surely plain
        new = np.append(True, (np.diff(place) > 1) | (line[place[1:]] != line[place[:-1]]))
        score[new & ~has] += self.first
        tags[place] = viterbi(score, np.flatnonzero(new), self.step)
        return tags


def viterbi(scores: np.ndarray, begin: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of chains that begin at the given rows: one step per place, over all chains that are that long."""
    length = np.diff(np.append(begin, len(scores)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains with over t rows
    back = np.zeros(scores.shape, np.uint8)
    best = scores[begin]
    final = np.zeros(len(begin), np.int64)
    for t in range(1, length[0] + 1):
        n = alive[t] if t < length[0] else 0
        final[n : len(best)] = best[n:].argmax(1)
        if not n:
            break
        paths = best[:n, :, None] + step
        back[begin[:n] + t] = paths.argmax(1)
        best = paths.max(1) + scores[begin[:n] + t]
    tags = np.zeros(len(scores), np.int64)
    now = final
    for t in range(length[0] - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        tags[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return tags


class Table:
    """Labelled sentences as padded arrays; few shapes occur, so emissions and gradients go by shape."""

    def __init__(self, sentences: list[tuple[list[bytes], list[str]]], tags: list[str]) -> None:
        size, self.most, self.count = len(sentences), max(len(w) for w, _ in sentences), len(tags)
        code, gold, self.real = np.zeros((size, self.most), np.int64), np.zeros((size, self.most), np.int64), np.zeros((size, self.most), bool)
        for i, (words, labels) in enumerate(sentences):
            data = np.frombuffer(b" ".join(words), np.uint8)
            code[i, : len(words)] = shapes(data, *tokens(data))
            gold[i, : len(words)] = [tags.index(x) for x in labels]
            self.real[i, : len(words)] = True
        used, place = np.unique(code, return_inverse=True)
        self.place = place.reshape(code.shape)
        self.has = np.zeros((len(used), FEATURES))
        self.has[np.arange(len(used))[:, None], features_of(used)] = 1
        self.target = np.eye(self.count)[gold] * self.real[..., None]
        self.inner = self.real[:, 1:]

    def loss(self, theta: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradient, by the forward-backward sums."""
        size, inner, place = len(self.real), self.inner, self.place
        own = {k: (self.has @ theta[k])[place] for k in ("before", "here", "after")}
        e = own["here"].copy()
        e[:, 1:] += own["before"][:, :-1]
        e[:, :-1] += own["after"][:, 1:] * inner[..., None]
        top = e.max(2, keepdims=True)
        x, steps = np.exp(e - top), np.exp(theta["step"])
        forward, backward, scale = np.zeros_like(e), np.ones_like(e), np.ones(e.shape[:2])
        for t in range(self.most):
            new = (forward[:, t - 1] @ steps if t else np.exp(theta["first"])) * x[:, t]
            real = self.real[:, t]
            scale[:, t] = np.where(real, new.sum(1), 1.0)
            forward[:, t] = np.where(real[:, None], new / scale[:, t, None], forward[:, t - 1])
        ahead = np.zeros_like(e)
        for t in range(self.most - 1, 0, -1):
            ahead[:, t] = x[:, t] * backward[:, t] / scale[:, t, None]
            backward[:, t - 1] = np.where(self.real[:, t, None], ahead[:, t] @ steps.T, 1.0)
        z = (np.log(scale) + top[..., 0] * self.real).sum(1)
        marginal = forward * backward * self.real[..., None]
        pairs = steps * np.einsum("nta,ntb->ab", forward[:, :-1] * inner[..., None], ahead[:, 1:], optimize=True)
        d = (marginal - self.target) / size
        grad = {}
        for k, at, part in (("here", place, d), ("before", place[:, :-1], d[:, 1:]), ("after", place[:, 1:], d[:, :-1] * inner[..., None])):
            by_shape = [np.bincount(at.ravel(), part[..., tag].ravel(), len(self.has)) for tag in range(self.count)]
            grad[k] = self.has.T @ np.stack(by_shape, axis=1)
        gold_pair = np.einsum("nta,ntb->ab", self.target[:, :-1] * inner[..., None], self.target[:, 1:], optimize=True)
        grad["step"] = (pairs - gold_pair) / size
        grad["first"] = d[:, 0].sum(0)
        gold = (e * self.target).sum() + (self.target[:, 0] * theta["first"]).sum() + (gold_pair * theta["step"]).sum()
        return float((z.sum() - gold) / size), grad


def train(sentences: list[tuple[list[bytes], list[str]]], tags: list[str], rounds: int = 120, rate: float = 0.2, penalty: float = 1e-3) -> Crf:
    """Fit by full-batch gradients with Adam; the same table always gives the same model."""
    table, count = Table(sentences, tags), len(tags)
    theta = {"before": np.zeros((FEATURES, count)), "here": np.zeros((FEATURES, count)), "after": np.zeros((FEATURES, count)), "step": np.zeros((count, count)), "first": np.zeros(count)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in theta.items()}
    for n in range(1, rounds + 1):
        _, grad = table.loss(theta)
        for k, v in theta.items():
            g = grad[k] + penalty * v
            a, b = moment[k]
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.999 * b + 0.001 * g * g
            v -= rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
    return Crf(tags, **{k: v.astype(np.float32) for k, v in theta.items()})
