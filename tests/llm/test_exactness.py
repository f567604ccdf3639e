"""Texts made to deceive hashes, hostile texts for the secret scan, and odd columns in the pipeline's stages."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate
from tidewatch.llm.decontaminate import Index, contamination
from tidewatch.llm.jaccard import keep_one, link_documents
from tidewatch.llm.secrets_scan import RULES, find_spans
from tidewatch.llm.trie import link_group
from tidewatch.llm.words import NOT_SPACE, word_hashes

THUE = "".join("ab"[i.bit_count() & 1] for i in range(2048))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def test_words_of_any_length_are_told_apart():
    """Polynomial hashes modulo 2**64 are equal for a Thue-Morse word and its complement."""
    for n in (16, 32, 33, 64, 512, 1024, 2048):
        _, _, found = word_hashes(np.frombuffer(f"{THUE[:n]} {OTHER[:n]} {THUE[:n].upper()}".encode(), np.uint8), NOT_SPACE)
        assert found[0] != found[1] and found[0] == found[2]
    long = np.frombuffer(b" ".join(b"w%d" % i for i in range(300_000)), np.uint8)  # over several strips
    assert len(set(word_hashes(long, NOT_SPACE)[2].tolist())) == 300_000


def test_jaccard_does_not_link_colliding_words(spark):
    rows = [(1, f"{THUE} one two three"), (2, f"{OTHER} one two three"), (3, f"{THUE} one two three")]
    found = {r.doc_id: r.component_id for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_links_of_hashes_are_verified():
    sets = [np.arange(20), np.arange(20), np.arange(20)]
    union = link_group(sets, [0, 1, 2], 85, 100, lambda i, j: {i, j} != {0, 1})
    assert union.root(0) == union.root(2) == union.root(1)  # 1 is linked by 2
    assert len({link_group(sets, [0, 1, 2], 85, 100, lambda i, j: False).root(i) for i in range(3)}) == 3


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_contamination_compares_words(spark, monkeypatch, most):
    """Below and above the bound of the broadcast the answer is the same, also where hashes are equal by force."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    tail = " one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, OTHER + tail), (2, THUE + tail)], "doc_id long, text string")
    items = spark.createDataFrame([(7, THUE + tail)], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, items).collect()}
    assert found == {1: (13, 0, [], False), 2: (13, 13, ["7"], True)}


def test_index_keeps_windows_of_one_hash_apart(monkeypatch):
    """With all windows on one hash, results rest on the words alone."""
    monkeypatch.setattr(decontaminate, "gram_hashes_at", lambda words, at, k: np.zeros(len(at), np.uint64))
    monkeypatch.setattr(decontaminate, "gram_hashes", lambda words, k: np.zeros(max(0, len(words) - k + 1), np.uint64))
    index = Index([("a", b"p q r"), ("b", b"p q s"), ("c", b"P q r")])
    hits = index.hits(decontaminate.Texts.of([b"x p q r y p q s"]))
    assert [(low, high, sorted(index.names[i] for i in items)) for low, high, items in hits] == [(1, 4, ["a", "c"]), (5, 8, ["b"])]


def test_index_memory_is_bounded():
    """The figure that stands beside BROADCAST_BYTES."""
    rng = np.random.default_rng(3)
    texts = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 9999, 40)).encode()) for i in range(8_000)]
    size = sum(len(x) for _, x in texts)
    index = Index(texts)
    arrays = [a for part in (index.prints, index.hashes, index.at, *[dict(enumerate(x)) for x in index.items.values()]) for a in part.values()]
    held = sum(a.nbytes for a in [*arrays, index.texts.data, index.texts.start, index.texts.end])
    assert held < 12 * size


HOSTILE = ["eyJ", "eyJa.", "eyJa.eyJ", "SG.", "SG.a ", "SG.a.", "password=token: ", "password", "password  ", "secret=", "a1b2", "AKIA", "ghp_", "glpat-", "github_pat_", "xoxb-", "AIza", "sk_live_", "npm_", "pypi-AgE", "hf_", "dop_v1_", "shpat_", "-----BEGIN A"]


def test_secret_scan_is_linear():
    """Twice the text takes about twice the time for marks of every rule, however they are repeated."""
    find_spans(b"")
    for mark in HOSTILE + ["password=token: " + "a" * 3000, "eyJ" + "a" * 3000 + ".eyJ"]:
        took = []
        for n in (40_000, 160_000):
            data = (mark * (n // len(mark) + 1))[:n].encode()
            began = time.perf_counter()
            find_spans(data)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.1, mark
    assert len(RULES) == 17


def test_secret_after_a_failed_mark_and_inside_a_match():
    token = "eyJ" + "g" * 20 + ".eyJ" + "h" * 20 + "." + "k" * 20
    assert [RULES[k][0] for _, k, _ in find_spans(f"eyJ{'g' * 50}.eyJ {token}".encode())] == ["web_token"]
    assert find_spans(b"password=token: " + b"g" * 50) == []  # the match ends before the colon, and its value is short
    assert [(a, b) for a, k, b in find_spans(b"password=token: zzz token=zzzzzz")] == [(20, 32)]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, `a.b` int, `x``y` int, m map<string,int>, s struct<p:int>, _row int, _bytes int, _text int"


@pytest.fixture
def odd(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from every hound in the yard today"
    row = lambda i, t, m: (i, t, "en", "web", 9, "z", 1, 2, m, (3,), 4, 5, 6)
    rows = [row(1, text, {"k": 1}), row(1, text, {"k": 1}), row(1, text, {"k": 2}), row(2, text, None), row(None, text, {"k": 1}), row(None, text, {"k": 1}), row(3, None, {}), row(4, "something else altogether is said here in a few words", {})]
    return spark.createDataFrame(rows, ODD_SCHEMA)


def test_keep_one_takes_any_column(odd):
    """Of equal rows one stays, rows of one id that differ stay, null ids stay; every name and type passes."""
    found = keep_one(odd)
    assert found.columns == odd.columns and found.schema["m"].dataType == odd.schema["m"].dataType
    kept = sorted((r.doc_id is None, r.doc_id or 0, sorted((r.m or {}).items())) for r in found.collect())
    assert kept == [(False, 1, [("k", 1)]), (False, 1, [("k", 2)]), (False, 3, []), (False, 4, []), (True, 0, [("k", 1)])]
    assert keep_one(odd.limit(0)).count() == 0
    renamed = odd.withColumnRenamed("doc_id", "d.id").withColumnRenamed("text", "t.x")
    assert keep_one(renamed, "d.id", "t.x").count() == 5


def test_all_stages_take_any_column(spark, small, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns
    assert docs.where(F.col("doc_id").isNull()).count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()
