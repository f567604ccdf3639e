"""Secret scan: all rules run as one minimal automaton in a single pass over the bytes of each whole text.

Defined results: a null text counts as empty; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules, ends, longest, next_end
from .common import map_rows, text_bytes

#: Kind, pattern of the scan, what follows it in a whole match, whether letters match in either case, least
#: length. Matches under the least length are dropped. A hexadecimal run would accept in nearly every word, so its limit
#: also stands in the pattern. The scan looks for the marks of providers alone, and the rest of a match is followed from
#: there: long runs of several rules side by side would multiply the states of the combined automaton.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", "", True, 0),
    ("access", r"AKIA[A-Z0-9]+", "", False, 20),
    ("hex", r"[0-9a-f]{24,}", "", False, 24),
    ("github", r"gh[oprsu]_", r"[A-Za-z0-9]+", False, 40),
    ("private_key", r"-----BEGIN [A-Z]+ ?[A-Z]* ?KEY-----", "", False, 0),
    ("github_fine", r"github_pat_", r"[A-Za-z0-9_]+", False, 60),
    ("gitlab", r"glpat-", r"[A-Za-z0-9_\-]+", False, 26),
    ("slack", r"xox[abeoprs]-", r"[A-Za-z0-9\-]+", False, 24),
    ("google_api", r"AIza", r"[A-Za-z0-9_\-]+", False, 39),
    ("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]+", False, 24),
    ("sendgrid", r"SG\.", r"[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, 60),
    ("npm", r"npm_", r"[A-Za-z0-9]+", False, 40),
    ("pypi", r"pypi-AgE", r"[A-Za-z0-9_\-]+", False, 60),
    ("hugging", r"hf_", r"[A-Za-z0-9]+", False, 34),
    ("digitalocean", r"do[oprt]_v1_", r"[0-9a-f]+", False, 71),
    ("shopify", r"shp(at|ca|pa|ss)_", r"[0-9a-fA-F]+", False, 38),
    ("web_token", r"eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, 40),
]
BASE = ("assign", "access", "hex")
VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
MIN_VALUE = 6


@cache
def automata() -> tuple[Automaton, list[Automaton], list[Automaton], list[Automaton]]:
    """The combined automaton, and per rule an anchored one of whole matches forwards, one of the scan backwards, and the scan alone."""
    rules = [(pattern, fold) for _, pattern, _, fold, _ in RULES]
    whole = [compile_rules([(pattern + rest, fold)], anchored=True) for _, pattern, rest, fold, _ in RULES]
    return compile_rules(rules), whole, [compile_rules([r], anchored=True, reverse=True) for r in rules], [compile_rules([r]) for r in rules]


def find_spans(data: bytes, compiled=None) -> list[tuple[int, int, int]]:
    """(start, rule index, end) in bytes, leftmost and non-overlapping per rule, by start and then rule.

    Every rule looks at each byte a bounded number of times. A mark of a provider without what must follow it is not
    followed again within the stretch that was looked at: there the rest would end at the same byte. Where the scan
    accepts a match that begins inside an earlier one, the rule alone is scanned on from the end of that one.
    """
    scan, forwards, backwards, alone = compiled or automata()
    free, quiet, spans = [0] * len(RULES), [0] * len(RULES), []
    for end, mask in ends(scan, data):
        while mask:
            rule = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            if end <= free[rule] or end < quiet[rule]:
                continue
            start, _ = longest(backwards[rule], data, end, free[rule], -1)
            if start is None:
                quiet[rule] = next_end(alone[rule], data, free[rule])
                if end < quiet[rule]:
                    continue
                start, _ = longest(backwards[rule], data, end, free[rule], -1)
            stop, seen = longest(forwards[rule], data, start, len(data), 1)
            if stop is None:  # the mark of a provider without what must follow it
                free[rule] = seen
                continue
            free[rule] = stop
            if stop - start < RULES[rule][4]:
                continue
            if RULES[rule][0] == "assign" and len(VALUE.fullmatch(data, start, stop)[1]) < MIN_VALUE:
                continue
            spans.append((start, rule, stop))
    return sorted(spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and an array of (kind, start, end, value); offsets in code points."""
    compiled = automata()

    def make():
        def one(key, data):
            data = data or b""
            out, at, chars = [], 0, 0
            for start, rule, stop in find_spans(data, compiled):
                chars += len(data[at:start].decode())
                at = start
                value = data[start:stop].decode()
                out.append({"kind": RULES[rule][0], "start": chars, "end": chars + len(value), "value": value})
            return key, out

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_rows(text_bytes(docs, id_col, text_col), make, f"{id_col} {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>")
