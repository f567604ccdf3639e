"""Personal data: exact base patterns, and further spans by a conditional random field over word shapes.

Defined results: a null text counts as empty; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored by `find_personal` and kept by `redact`.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_pieces, text_and_row, text_bytes
from .crf import CUES, Crf, shapes, tokens, train
from .words import join_texts

BASE = ("email", "ip", "card", "phone")
#: Text that a task looks at together, bytes.
PIECE_BYTES = 2 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """As the pattern local@domain read from the left, in time linear in the text: looks outward from each at sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d if i % 2 == 0 else d * 2 - 9 * (d > 4))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points: leftmost non-overlapping per kind, failing matches dropped."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


CUE_WORDS = {w for words in CUES.values() for w in words.split()}
STREETS = set(CUES["street"].split())
#: What the model adds: more of the base kinds, and kinds that no base pattern has.
KINDS = (*BASE, "name", "address", "national_id")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: How labelled values are written, by kind; # is a digit, x a letter, X a capital one, _ a word break.
#: Words in brackets stand before or after a value as cues and are not part of it.
FORMS = {
    "email": ["xxxx.xx@xxxxx.xxx", "xx##@xxxx#.xxxxxxx.xxx", "xxxxxx@xxxx.xx", "xxéx@xxxx.xxx"],
    "ip": ["##.##.#.###", "###.###.##.#", "#.#.#.#", "###.##.###.##"],
    "card": ["################", "####_####_####_####", "####-####-####-####", "####_######_#####"],
    "phone": [
        "+#_(###)_###-####", "+##_###_###_####", "(###)_###-####", "###-###-####", "###.###.####", "+###########", "+##-###-#######", "[phone]_###-###-####", "[tel]_###_####_####",
        "[call]_0##_####_####", "[mobile]_0####_######", "[telefon]_0###_#######", "[phone]_##########", "[fax]_(0##)_####_####", "0##_####_####", "0####_######",
    ],
    "name": ["[mr]_Xxxxx_Xxxxxx", "[mrs]_Xxxx", "[dr]_Xxxxx_X._Xxxxxxx", "[dr]_Xxxx_X._Xxx", "[mr]_Xxx_Xxx", "[name]_Xxx_X._Xxxx", "[prof]_Xxxxxxx", "[name]_Xxxxx_Xxxxxx", "[signed]_Xxxx_Xxxxx", "[ms]_Xxxx_Xxxxx-Xxxxx", "[herr]_Xxxxxx", "[frau]_Xxxx_Xxxxxx", "[regards]_Xxxxx_Xxxxxx", "[señora]_Xxxxx_Xxxxx"],
    "address": ["##_Xxxx_Street", "###_Xxxxxx_Avenue", "####_Xxxx_Xxxxx_Road", "#_Xxxxx_Lane", "##_X._Xxxx_St.", "###_Xxxxxxx_Blvd", "##x_Xxxxxx_Drive", "##_rue_xx_Xxxxx", "##_Xxxxxx_Court", "###_Xxxx_Ave."],
    "national_id": ["###-##-####", "[ssn]_###-##-####", "[social]_[security]_###-##-####", "[ssn]_#########", "[insurance]_XX######X", "XX_##_##_##_X", "[passport]_X########", "[nino]_XX_##_##_##_X", "[dni]_########X"],
}
#: Things of similar shape that are not personal data.
PLAIN_FORMS = [
    "#", "##", "####", "#####", "######", "##########", "#.#", "##,###", "####-##-##", "##:##", "x#", "xx-##", "v#.#.#", "(##)", "(xxxx)", "x_@_x", "+#", "#-#", "##%", "xxx=####", "xxxx---", "xxxxx###", "xxx!!", "xxx$$$", "xxx%%%", "xxx&&&", "xxx***", "|", "########xx##x", "xxxx://xxx.xxx",
    "####_####", "###_###_###", "order_###-###-####", "invoice_###-##-####", "ref_##########", "order_#########", "serial_####-####-####", "isbn_###-#-##-######-#", "ticket_0##_####_####", "version_##.##.##", "part_XX######X", "Xxxxx_Xxxxxx", "Xxxx_Street", "## xxxx_street", "##_Xxxx_xxxx",
    "mr_xxxx", "the_street_xx", "Xxxxx_xx", "call_xx_xxxx", "name_xx_xxxx", "st._Xx_xxxx", "XXXX_XXXXX", "XX!!_XXX!!", "##_xxx_Xxxxx", "Xxxx_##_Xxxx_xxx", "st_xxx", "phone_xxx", "Xxxxx_X._Xxxx", "dr_xxxx_xxx", "##_Xxxxxx", "Xxx,_Xxxx", "rue_xx_xxxx", "social_xxxx", "Xxxxx_Xxxx._Xxx_xxxx",
]
LABELLED_SENTENCES = 700


def labelled_table(seed: int = 20240101, count: int = LABELLED_SENTENCES) -> list[tuple[list[bytes], list[str]]]:
    """A small labelled table made by rule from the forms above: words around at most three values a sentence."""
    rng = random.Random(seed)
    letter = lambda: rng.choice("etaoinshrdluécm")
    word = lambda: "".join(letter() for _ in range(rng.randint(1, 10)))

    def fill(form: str) -> str:
        return "".join(rng.choice("0123456789") if c == "#" else letter() if c == "x" else letter().replace("é", "e").upper() if c == "X" else c for c in form)

    cased = lambda w: rng.choice([w, w, w.capitalize(), w.upper()])
    rows = []
    for _ in range(count):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 6)):
                w = word()
                w = w.capitalize() if rng.random() < 0.25 else w.upper() if rng.random() < 0.1 else w
                words.append(w + rng.choice(".,,!") if rng.random() < 0.15 else w)
                tags.append("O")
            if rng.random() < 0.6:
                kind, first = rng.choice(KINDS), True
                for part in rng.choice(FORMS[kind]).split("_"):
                    if part.startswith("["):
                        words.append(cased(part[1:-1]) + rng.choice(["", "", ":", "."]))
                        tags.append("O")
                    else:
                        words.append(part if part.lower().strip(".") in STREETS else fill(part))
                        tags.append(f"{'B' if first else 'I'}-{kind}")
                        first = False
            else:
                parts = rng.choice(PLAIN_FORMS).replace(" ", "_").split("_")
                words += [cased(x) if x in CUE_WORDS else x if x.lower().strip(".") in STREETS else fill(x) for x in parts]
                tags += ["O"] * len(parts)
            if rng.random() < 0.25:
                words[-1] += rng.choice(".,;:")
        rows.append(([w.encode() for w in words], tags))
    return rows


@cache
def trained() -> Crf:
    return train(labelled_table(), TAGS)


#: What a span of the model must hold to be added: least and most digits by kind.
ADDED_DIGITS = {"email": (0, 999), "ip": (4, 12), "card": (13, 19), "phone": (9, 15), "name": (0, 0), "address": (1, 6), "national_id": (6, 10)}
EDGE = b".,;:!?\"'%$#&*|"


def model_spans(model: Crf, data: np.ndarray, line_edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes of the joined texts, from the tags of all tokens."""
    start, end = tokens(data)
    code = shapes(data, start, end)
    tags = model.decode(code, np.searchsorted(line_edges, start, side="right"))
    out = []
    hit = np.flatnonzero(tags)
    i = 0
    while i < len(hit):
        kind = (int(tags[hit[i]]) - 1) // 2
        j = i + 1
        inside = 2 * kind + 2
        while j < len(hit) and hit[j] == hit[j - 1] + 1 and tags[hit[j]] == inside:
            j += 1
        a, b = int(start[hit[i]]), int(end[hit[j - 1]])
        raw = data[a:b].tobytes()
        a, b = a + len(raw) - len(raw.lstrip(EDGE)), b - len(raw) + len(raw.rstrip(EDGE))
        out.append((a, b, kind))
        i = j
    return out


def plausible(text: str, kind: str) -> bool:
    low, high = ADDED_DIGITS[kind]
    if not low <= len(d := digits_of(text)) <= high or "\n" in text:
        return False
    if kind == "email":
        return "@" in text[1:-1] and "." in text[text.index("@") :]
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)
    if kind == "name":
        return any(p[0].isupper() and len(p) > 1 for p in text.split())
    if kind == "address":
        return any(p[0].isupper() for p in text.split())
    return kind != "card" or luhn(d)


def finder(model: Crf, redacted: bool):
    def piece(batch):
        raw = [x or b"" for x in batch.column(1).to_pylist()]
        data, edges = join_texts(raw)
        lines = np.unique(np.concatenate([edges[1:], np.flatnonzero(data == 10) + 1]))
        added: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        for a, b, kind in model_spans(model, data, lines):
            d = int(np.searchsorted(edges, a, side="right")) - 1
            added[d].append((a - int(edges[d]), b - int(edges[d]), kind))
        spans, texts = [], []
        for x, more in zip(raw, added, strict=True):
            text = x.decode()
            base = base_spans(text)
            rows = [(a, k, b, BASE[k]) for a, k, b in base]
            at = chars = 0
            for a, b, kind in more:
                chars += len(x[at:a].decode())
                at = a
                value = x[a:b].decode()
                start, end = chars, chars + len(value)
                if plausible(value, KINDS[kind]) and not any(p < end and start < r for p, _, r in base):
                    rows.append((start, len(BASE) + kind, end, f"model_{KINDS[kind]}"))
            rows.sort()
            spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, _, b, k in rows])
            if redacted:
                texts.append(mask(text, rows))
        return {"_key": batch.column(0), "spans": spans, "redacted": texts}

    return piece


def mask(text: str, rows) -> str:
    """Each run of overlapping spans becomes the first one's kind in brackets."""
    out, at = [], 0
    for start, _, end, kind in rows:
        if start >= at:
            out += [text[at:start], f"[{kind.removeprefix('model_').upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "spans array<struct<kind:string,start:int,end:int,value:string>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and an array of (kind, start, end, value); offsets in code points."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    found = map_pieces(text_bytes(docs, id_col, text_col), lambda: finder(model.value, False), f"_key {dict(docs.dtypes)[id_col]}, {SPANS}", PIECE_BYTES)
    return found.withColumnRenamed("_key", id_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    counted = length_col in names

    def make():
        find = finder(model.value, True)

        def piece(batch):
            new = find(batch.select([0, 1]))["redacted"]
            texts = [None if old is None else x for old, x in zip(batch.column(1).to_pylist(), new, strict=True)]
            return {"_row": batch.column(2), "_text": texts, "_length": [None if x is None else len(x) for x in texts] if counted else [None] * len(texts)}

        return piece

    schema = StructType([StructField("_row", docs.schema), StructField("_text", StringType()), StructField("_length", LongType())])
    found = map_pieces(text_and_row(docs, text_col, text_col), make, schema, PIECE_BYTES)
    row = F.col("_row")
    changed = {text_col: F.col("_text")} | ({length_col: F.col("_length").cast(docs.schema[length_col].dataType)} if counted else {})
    return found.select(*[changed.get(c, row.getField(c)).alias(c) for c in names])
