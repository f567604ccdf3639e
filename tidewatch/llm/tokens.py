"""Token counts by two tiers of pre-token tables, a broadcast table of frequent ones and a cache per worker; token ids.

A pre-token here is a run of white space with the run of other characters after it. No token of the two kinds of
vocabulary crosses from one into the next, whatever their characters are, so a text's tokens are those of its
pre-tokens. A miss in both tiers is cut by the library's own pattern, restated with Python's character classes, and its
words are encoded by the bare model. Only where the restatement may differ (other numbers than decimal ones, code points
that Python's tables do not know, separators that Python takes for white space, a special token's string) the library
encodes that one pre-token, never the whole text.

Frequent pre-tokens are counted over all documents, by counters of bounded size that are merged as wholes. They change
speed only, never a result.

Defined results: a null text counts as empty and has no tokens; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_pieces, map_rows, text_bytes

#: The characters that Unicode calls white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")
WHITE = re.compile(f"[{SPACE}]")
#: Separators that are white space for Python's split and patterns, and not for Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The two vocabularies' own patterns; letters are word characters without digits and the low line.
BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

#: Bounds of the broadcast table, of a task's counter, of what a task reports, and of a worker's caches.
TABLE_ENTRIES = 1 << 17
COUNTED_ENTRIES = 1 << 18
REPORTED_ENTRIES = 1 << 14
MERGED_REPORTS = 16
CACHE_ENTRIES = 1 << 17
WORD_ENTRIES = 1 << 17
ODD_ENTRIES = 1 << 15
LONGEST_ENTRY = 64
#: Words that are encoded as one text, and text that a task encodes together, bytes; a longer text is taken alone.
JOINED_WORDS = 200
PIECE_BYTES = 2 << 20
#: Characters of texts that are cut into words together, white space allowing.
BLOCK_CHARACTERS = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@cache
def doubtful(c: str) -> bool:
    """Whether a character may count otherwise for the library than for Python's patterns."""
    return "\x1c" <= c <= "\x1f" or c == "İ" or unicodedata.category(c) in ("No", "Nl", "Cn")


def restated(pre_token: str) -> bool:
    """Whether the patterns above cut this pre-token as the library does."""
    if "<|" in pre_token:
        return False
    if pre_token.isascii():
        return not SEPARATORS.search(pre_token)
    return not any(map(doubtful, pre_token))


def normal_form(word: str) -> str:
    """As the word-level vocabulary normalises: composed, then each character in lower case by itself (no final sigma)."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


class Encoder:
    """The library's tokenizer of one file, and its bare model for the words of pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.alphabet = self.whole.model, byte_alphabet()
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = [t.id for t in self.model.tokenize("".join([self.alphabet[b] for b in word.encode()]))]
            if len(word) <= LONGEST_ENTRY:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def bytes_of(self, pre_token: str) -> list[int]:
        """Ids of a pre-token of a byte-level vocabulary."""
        if not restated(pre_token):
            return self.whole.encode(pre_token, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.word, BYTE_LEVEL.findall(pre_token))))

    def words_of(self, pre_token: str) -> list[int]:
        """Ids of a pre-token of a word-level vocabulary, which drops white space."""
        if not restated(pre_token):
            return self.whole.encode(pre_token, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.word, WORD_LEVEL.findall(normal_form(pre_token)))))


class Lookup(dict):
    """Pre-token to value: the broadcast table, and for the rest the worker's bounded cache."""

    def __init__(self, frequent: dict, value) -> None:
        super().__init__(frequent)
        self.value, self.cache = value, {}

    def __missing__(self, pre_token):
        found = self.cache.get(pre_token)
        if found is None:
            found = self.value(pre_token)
            if len(pre_token) <= LONGEST_ENTRY:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[pre_token] = found
        return found


def worker_lookup(kind: str, path: str, frequent, value) -> Lookup:
    """One encoder and cache per worker process and table, shared by the tasks that it runs."""

    def make() -> Lookup:
        encoder = Encoder(path)
        return Lookup(frequent.value, lambda w: value(encoder, w))

    return held((kind, path, frequent.id if hasattr(frequent, "id") else id(frequent)), make)


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(text)


def words(text: str) -> list[str]:
    """Pre-tokens without their white space."""
    return WORD.findall(text) if SEPARATORS.search(text) else text.split()


def frequent_pre_tokens(docs: DataFrame, cut, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The commonest pre-tokens of all documents, TABLE_ENTRIES at most.

    A task's counter that is full keeps its larger half, and a task reports its largest counts as one row. These rows are
    merged in two steps by counters of the same size: no pre-token is shuffled by itself.
    """

    def row(seen: Counter, most: int):
        kept = sorted(((-n, w) for w, n in seen.most_common(most) if n > 1))
        columns = [pa.array([[w for _, w in kept]], pa.list_(pa.string())), pa.array([[-n for n, _ in kept]], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["words", "counts"])

    def bounded(seen: Counter) -> Counter:
        return Counter(dict(seen.most_common(COUNTED_ENTRIES // 2))) if len(seen) > COUNTED_ENTRIES else seen

    def counted(batches):
        seen: Counter = Counter()
        for batch in batches:
            for data in batch.column(1).to_pylist():
                seen.update(cut((data or b"").decode()))
                seen = bounded(seen)
        yield row(Counter({w: n for w, n in seen.items() if len(w) <= LONGEST_ENTRY}), REPORTED_ENTRIES)

    def merged(most: int):
        def run(batches):
            seen: Counter = Counter()
            for batch in batches:
                for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen.update(dict(zip(words, counts, strict=True)))
                    seen = bounded(seen)
            yield row(seen, most)

        return run

    schema = "words array<string>, counts array<long>"
    reports = text_bytes(docs, id_col, text_col).mapInArrow(counted, schema)
    some = reports.repartition(MERGED_REPORTS).mapInArrow(merged(TABLE_ENTRIES), schema)
    found = some.repartition(1).mapInArrow(merged(TABLE_ENTRIES), schema).first()  # TABLE_ENTRIES words at most
    return list(found.words) if found else []


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text under a byte-level vocabulary; no pre-token is shuffled."""
    encoder = Encoder(path)
    frequent = docs.sparkSession.sparkContext.broadcast({w: len(encoder.bytes_of(w)) for w in frequent_pre_tokens(docs, pre_tokens, id_col, text_col)})

    def make():
        length = worker_lookup("count", path, frequent, lambda e, w: len(e.bytes_of(w))).__getitem__

        def one(key, data):
            return (key, len(data), sum(map(length, pre_tokens(data.decode())))) if data else (key, 0, 0)

        return one

    return map_rows(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


#: Classes of characters in the word-level pattern, a mark for doubtful ones, and characters not looked at yet.
BLANK, LETTER, DIGIT, OTHER, DOUBT, UNSEEN = 0, 1, 2, 3, 4, 255
#: Between texts: white space for the pattern; a text that holds it is in doubt anyway.
BETWEEN = "\x1c"


class WordIds:
    """Text to packed ids of a word-level vocabulary, for all words of a batch of texts at once.

    Texts are joined, normalised and cut by classes of characters as arrays, their distinct words by Arrow's dictionary.
    Words that the worker does not know are encoded together by the bare model, and fall apart at the tokens that end a
    word; what the last batches used is kept in two generations of bounded size. Words are spelled in the byte alphabet.
    A text that holds a doubtful character or the beginning of a special token goes pre-token by pre-token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark runs a task on every core
        self.encoder, self.new, self.old = Encoder(path), {}, {}
        self.bare = Tokenizer(self.encoder.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.odd: dict[str, bytes] = {}
        self.spelling = dict(enumerate(self.encoder.alphabet)) | {0x0A: "\n"}
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        vocabulary = self.encoder.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == UNSEEN).any():
            for code in np.unique(codes[found == UNSEEN]).tolist():
                c = chr(code)
                kind = BLANK if c.isspace() else DIGIT if c.isdecimal() else LETTER if c.isalnum() else OTHER
                self.classes[code] = kind | DOUBT * doubtful(c)
            found = self.classes[codes]
        return found

    def cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the matches of WORD_LEVEL and the stretches between them start, and which are matches."""
        kind = self.classes_of(codes) & OTHER
        starts = kind == DIGIT
        starts[0] = True
        starts[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero((codes == 0x27) & starts)
        if len(at):  # 's 't 'm 'd, and 're 've 'll, where a match starts
            padded = np.append(codes, [0, 0])
            first, second = padded[at + 1], padded[at + 2]
            one = np.isin(first, [*b"stmd"])
            two = np.isin(first, [*b"rv"]) & (second == 0x65) | (first == 0x6C) & (second == 0x6C)
            starts[at[one | two] + 1] = False
            after = np.concatenate([at[one] + 2, at[two] + 3])
            starts[after[after < len(codes)]] = True
        places = np.flatnonzero(starts)
        return places, kind[places] != BLANK

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words that are spelled in the byte alphabet."""
        texts = [" ".join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.bare.encode_batch_fast(texts, add_special_tokens=False)), np.dtype("<u4"))
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words) or (len(cut) and cut[-1] != len(ids)):  # a word that is not one word when joined: each by itself
            return {w: packed([t.id for t in self.encoder.model.tokenize(w)]) for w in words}
        raw, edges = ids.tobytes(), (4 * np.concatenate([[0], cut])).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, edges[:-1], edges[1:], strict=True)}

    def ids_of(self, words: list[str]) -> list[bytes]:
        if len(self.new) > WORD_ENTRIES:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            older = {w: v for i in gaps if (v := self.old.get(w := words[i])) is not None}
            learnt = older | self.encode_words([w for i in gaps if (w := words[i]) not in older])
            for i in gaps:
                found[i] = learnt[words[i]]
            self.new.update((w, v) for w, v in learnt.items() if len(w) <= LONGEST_ENTRY)
        return found

    def encode_odd(self, text: str) -> bytes:
        """A text in doubt: only pre-tokens that are in doubt themselves go to the library as they are."""
        found = []
        for w in words(text):
            ids = self.odd.get(w)
            if ids is None:
                ids = packed(self.encoder.words_of(w))
                if len(w) <= LONGEST_ENTRY:
                    if len(self.odd) >= ODD_ENTRIES:
                        self.odd.clear()
                    self.odd[w] = ids
            found.append(ids)
        return b"".join(found)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that hold nothing doubtful."""
        whole = normal_form(BETWEEN.join(["", *texts, ""]))
        codes, data = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
        places, matches = self.cut(codes)
        between = np.flatnonzero(codes == ord(BETWEEN))
        if len(data) == len(codes):
            edges = np.append(places, len(data)).astype(np.int32)
        else:
            widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(widths)])[np.append(places, len(codes))].astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(edges), pa.py_buffer(data)]).filter(pa.array(matches)).dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary), b"\n")[0].as_py()  # no word holds white space
        found = self.ids_of(joined.decode("latin-1").translate(self.spelling).split("\n") if joined else [])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts, ids = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), "<u4")
        which = parts.indices.to_numpy()
        n = lengths[which]
        before = np.concatenate([[0], np.cumsum(n)])
        coded = ids[np.repeat(firsts[which] - before[:-1], n) + np.arange(before[-1])].tobytes()
        ends = (4 * before[np.searchsorted(places[matches], between)]).tolist()
        return [coded[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            codes = np.frombuffer(BETWEEN.join(["", *(x for _, x in held)]).encode("utf-32-le"), "<u4")
            doubts = np.append(0, np.cumsum((self.classes_of(codes) & DOUBT) > 0))
            edges = np.cumsum([0, *(1 + len(x) for _, x in held)])
            odd = (np.diff(doubts[edges]) > 1).tolist()  # beyond the mark before it
            odd = [o or "<|" in x for o, (_, x) in zip(odd, held, strict=True)]
            plain = iter(self.encode_plain([x for o, (_, x) in zip(odd, held, strict=True) if not o]))
            for o, (i, x) in zip(odd, held, strict=True):
                found[i].append(self.encode_odd(x) if o else next(plain))
            held.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):  # a long text is cut at white space
                end = m.start() if len(text) - at > BLOCK_CHARACTERS and (m := WHITE.search(text, at + BLOCK_CHARACTERS)) else len(text)
                if held and size + end - at > BLOCK_CHARACTERS:
                    flush()
                    size = 0
                held.append((i, text[at:end]))
                size += end - at
                at = end
        if held:
            flush()
        return list(map(b"".join, found))


def encode_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and one end id, cut at `capacity`."""
    width, last = 4 * capacity, packed([end_id])

    def make():
        ids = held(("ids", path), lambda: WordIds(path))

        def piece(batch):
            rows = []
            for key, coded in zip(batch.column(0).to_pylist(), ids.encode([(x or b"").decode() for x in batch.column(1).to_pylist()]), strict=True):
                coded += last
                for n, at in enumerate(range(0, len(coded), width)):
                    part = coded[at : at + width]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            return dict(zip((id_col, "piece", "start", "length", "ids_crc32"), columns, strict=True))

        return piece

    return map_pieces(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long", PIECE_BYTES)
