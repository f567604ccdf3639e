"""Restoring disguised words by a noisy channel: character lattices, decoded under a character language model.

A stretch of text is in doubt if letters stand next to signs that are read as letters, if a letter comes three times in
a row or two different ones twice each, if a word has a star or several marks inside, or if single letters are set apart. Each of its characters
allows several readings: the letter itself, letters that a sign stands for, a word boundary, or nothing (never for a
digit); a repeated letter is read once or twice. The Viterbi algorithm finds the likeliest reading under a trigram model
of characters. All other text is its own only reading; so is a word that one space cuts into two longer parts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import groupby

import numpy as np

from .words import join_texts

#: Symbols of the model: 0 is a boundary, 1 to 26 are letters, 27 is any letter beyond ASCII.
SYMBOLS = 28
OTHER = 27
#: Letters that a sign is read as.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
    "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u", "а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Logarithms: a sign for a letter, a sign as a boundary, a sign as nothing, a letter read once that comes twice or more often.
AS_LETTER, AS_BOUNDARY, AS_NOTHING, ONCE, ONCE_OF_MANY, TWICE_OF_MANY = -1.0, -1.5, -1.5, -3.0, -0.3, -1.5
#: A sign that may be a letter as a boundary, and as nothing.
SIGN_AS_BOUNDARY, SIGN_AS_NOTHING = -4.0, -3.5
#: Signs that are mostly marks between words, at the edges of a stretch.
EDGE_SIGNS = "!|+¡§"
#: A letter beyond ASCII as its base letter.
AS_BASE = -2.0
#: Characters that are decoded together: a longer stretch is taken in parts.
PART = 48
#: Bytes looked at together.
STRIP = 1 << 20

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])
_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_SIGN = np.array([chr(b) in READINGS for b in range(128)] + [False] * 128)
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_CODE = np.array([b & 31 if _ASCII_LETTER[b] else OTHER if b >= 0x80 else 0 for b in range(256)], np.int32)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Trigrams of characters over all texts, by code; a word begins after two boundaries and ends in one."""
    data, _ = join_texts(texts)
    code = _CODE[data[(data & 0xC0) != 0x80]]  # one code a character
    code = code[(code > 0) | np.append(True, code[:-1] > 0)[: len(code)]]
    if len(code) < 2:
        return np.zeros(SYMBOLS**3, np.int64)
    v = np.append(0, code[:-1])
    u = np.where(v > 0, np.append([0, 0], code[:-2]), 0)
    return np.bincount((u * SYMBOLS + v) * SYMBOLS + code, minlength=SYMBOLS**3)


def language_model(counts: np.ndarray, words: list[str] = (), share: float = 0.3) -> list[list[float]]:
    """Log P(character | two before) as a row for each pair: smoothed counts, and for a share those of a list of words."""

    def smoothed(c: np.ndarray) -> np.ndarray:
        c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = (c.sum(0) + 8 * one) / (c.sum((0, 2))[:, None] + 8)
        return (c + 4 * two) / (c.sum(2, keepdims=True) + 4)

    p = smoothed(counts)
    if words:
        own = trigram_counts([" ".join(words).encode()]).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        seen = own.sum(2, keepdims=True)
        p = np.where(seen > 0, (1 - share) * p + share * own / np.maximum(seen, 1), p)
    p[0, 0, 0] = 1  # a boundary after a boundary says nothing
    return np.log(p).reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()


def lattice(stretch: str) -> list[tuple[list[tuple[int, str, float]], float | None, bool]]:
    """Steps of a stretch: readings (symbol, letter, logarithm), that of being skipped, whether only the last letter may follow."""
    out = []
    runs = [(c, len(list(run))) for c, run in groupby(stretch.lower())]
    for at, (c, n) in enumerate(runs):
        letter = c.isalpha()
        readings = [(ord(x) - 96, x, AS_LETTER) for x in READINGS.get(c, "")]
        if "a" <= c <= "z":
            readings, skipped = [(ord(c) - 96, c, 0.0)], None
        elif letter:
            base = unicodedata.normalize("NFKD", c)[0]
            readings += [(OTHER, c, 0.0)] + ([(ord(base) - 96, base, AS_BASE)] if "a" <= base <= "z" else [])
            skipped = None
        else:
            within = c in READINGS and not (c in EDGE_SIGNS and at in (0, len(runs) - 1))
            readings.append((0, " ", SIGN_AS_BOUNDARY if within else AS_BOUNDARY))
            skipped = AS_NOTHING if c not in READINGS else None if c.isdigit() else SIGN_AS_NOTHING
        out.append((readings, skipped, False))
        if n > 1:
            again = [(s, x, TWICE_OF_MANY if n > 2 or not letter else 0.0) for s, x, _ in readings if s]
            out.append((again, (ONCE_OF_MANY if n > 2 else ONCE) if letter else 0.0, True))
    return out


def decode(stretch: str, model: list[list[float]]) -> str:
    """The likeliest reading of a stretch; boundaries are spaces."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for readings, skipped, same in lattice(stretch):
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (value, path) in states.items():
            row, v = model[state], state % SYMBOLS
            if skipped is not None and ((old := new.get(state)) is None or value + skipped > old[0]):
                new[state] = (value + skipped, path)
            for s, letter, cost in readings:
                if same and s != v:
                    continue
                after = v * SYMBOLS + s if s else 0
                total = value + cost + (row[s] if s or v else 0.0)
                if (old := new.get(after)) is None or total > old[0]:
                    new[after] = (total, (path, letter))
        states = new
    _, path = max(((value + (model[state][0] if state % SYMBOLS else 0.0), path) for state, (value, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def doubtful(data: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches that are in doubt, in order."""
    if not len(data):
        return []
    letter, sign, low = _LETTER[data], _SIGN[data], _LOWER[data]
    mark = np.zeros(len(data) + 4, np.int32)
    mark[: len(data) - 1] += (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    mark[: max(0, len(data) - 2)] += (low[2:] == low[:-2]) & (low[1:-1] == low[:-2]) & _ASCII_LETTER[data[2:]]
    twice = (low[1:] == low[:-1]) & _ASCII_LETTER[data[1:]]
    mark[: max(0, len(data) - 3)] += twice[2:] & twice[:-2]
    split = ~letter & ~_SPACE[data]
    if len(data) > 4:
        mark[: len(data) - 4] += letter[4:] & split[3:-1] & letter[2:-2] & split[1:-3] & letter[:-4]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return []
    total = np.append(0, np.cumsum(mark))
    # a word with two and more marks inside, or a star
    cut = np.zeros(len(data), np.int32)
    cut[2:] = split[:-2] & split[1:-1] & letter[2:]
    cut[1:] |= (data[:-1] == 0x2A) & letter[1:]
    cuts = np.append(0, np.cumsum(cut))
    inner = letter[start] & (cuts[end] - cuts[start] > 0)
    flagged = (inner | (total[end] - total[start] > 0)) & (np.add.reduceat(letter.astype(np.int32), start) > 0)
    # single letters or signs, three and more, with one or two spaces between
    single = (end - start == 1) & (letter[start] | sign[start])
    near = np.append(False, start[1:] - end[:-1] <= 2)
    follows = single & np.append(False, single[:-1]) & near
    begins = np.flatnonzero(single & ~follows)
    count = np.add.reduceat(follows.astype(np.int64), begins) + 1 if len(begins) else begins
    out = [(int(start[i]), int(end[i + n - 1])) for i, n in zip(begins.tolist(), count.tolist(), strict=True) if n >= 3]
    covered = np.zeros(len(start) + 1, np.int32)
    for i, n in zip(begins.tolist(), count.tolist(), strict=True):
        if n >= 3:
            covered[i] += 1
            covered[i + n] -= 1
    alone = flagged & (np.cumsum(covered)[:-1] == 0)
    return sorted(out + list(zip(start[alone].tolist(), end[alone].tolist(), strict=True)))


def strips(text: bytes):
    """A long text in strips that end at white space behind a word of two letters and more, where there is any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRIP)
        if end < len(text):
            cut = None
            for m in re.finditer(rb"\S\S(\s+)", text[max(at, end - 4096) : end]):
                cut = m
            end = max(at, end - 4096) + cut.end() if cut else end
        yield text[at:end]
        at = end


class Restorer:
    """Restores texts under one model and remembers what it has decoded, up to a bounded number of stretches."""

    def __init__(self, model: list[list[float]], most: int = 200_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def read(self, stretch: bytes) -> bytes:
        found = self.known.get(stretch)
        if found is None:
            text = stretch.decode(errors="replace")
            found = "".join(decode(text[i : i + PART], self.model) for i in range(0, len(text), PART)).encode()
            if len(self.known) >= self.most:
                self.known.clear()
            if len(stretch) <= PART:
                self.known[stretch] = found
        return found

    def restored(self, text: bytes) -> bytes:
        """A text of up to STRIP bytes with its doubtful stretches as they are read; the rest stays, in lower case of A-Z."""
        out, at = [], 0
        for a, b in doubtful(np.frombuffer(text, np.uint8)):
            out += [text[at:a], self.read(text[a:b])]
            at = b
        return b"".join([*out, text[at:]]).lower()
