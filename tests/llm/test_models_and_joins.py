"""Licence scan against brute force, models by held-out accuracy, the Jaccard join against all pairs, and the pipeline."""

from __future__ import annotations

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import common, crf, jaccard, langid, licenses, pii, quality
from tidewatch.llm import queries as q
from tidewatch.llm.trie import link_group


def odd_rows(spark):
    rows = [(1, None, "x", None), (2, "", None, "1"), (3, "one", "x", "2"), (3, "one", "x", "2"), (None, "one two three four five", None, None), (4, "a" * 40_000, "x", "2"), (5, "1 2 3 !", "x", "1")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")


def brute_licenses(text):
    """Licences of units, and of runs of words outside them: every start and end is tried for every template."""
    if text is None:
        return set()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    templates = {name: licenses.bigrams(t) for name, t in licenses.TEMPLATES.items()}

    def unit(u):
        words = re.findall("[a-z0-9]+", low(u))
        grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        best = max(((2 * len(grams & set(g)) / (len(grams) + len(g)), name) for name, g in templates.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        return best[1] if best[0] >= 0.8 else None

    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    found = {name for u in {text, *paragraphs, *text.split("\n")} if (name := unit(u))}
    if unit(text):
        return found
    rest = "\n".join("\x01" if unit(p) else "\n".join("\x01" if unit(x) else low(x.replace("\x01", " ")) for x in p.split("\n")) for p in paragraphs)
    words = re.findall("[a-z0-9\x01]+", rest)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    runs = []
    for name, own in templates.items():
        n, span = len(own), licenses.size_bounds(len(own))[1] + len(re.findall("[a-z0-9]+", licenses.TEMPLATES[name].lower())) - 1 - len(own)
        mine = set(own)
        for i in (i for i, g in enumerate(grams) if g in mine):
            best, held, shared = None, set(), 0
            for j in range(i, min(i + span, len(grams))):
                shared += grams[j] in mine and grams[j] not in held
                held.add(grams[j])
                dice = 2 * shared / (len(held) + n)
                if grams[j] in mine and dice >= 0.8 and (best is None or (dice, shared, -j) > best):
                    best = (dice, shared, -j)
            if best:
                runs.append((-best[1], -best[0], name, i, -best[2]))
    chosen = []
    for r in sorted(runs):
        if not any(r[3] <= c[4] and c[3] <= r[4] for c in chosen):
            chosen.append(r)
    return found | {r[2] for r in chosen}


def test_licenses_match_brute_force(spark, small):
    rng = random.Random(4)
    texts = [(i, "\n".join(rng.sample([*licenses.TEMPLATES.values(), "plain words here", "", " ", "MIT License", "Released under the  MIT license!!"], 3))) for i in range(60)]
    for i, t in list(texts):
        words = t.split(" ")
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = "x"
        texts.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: brute_licenses(t) for i, t in texts}
    assert any(got.values())
    assert licenses.scan_licenses(odd_rows(spark)).where("n_units > 0").count() == 0 and licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_inside_lines_and_over_paragraphs(spark):
    bsd = licenses.TEMPLATES["bsd-clauses"]
    apache = licenses.TEMPLATES["apache-2.0-notice"]
    texts = {
        1: ("The parser is released under the MIT License.", 1, "mit", 1.0),
        2: ("Copyright (c) 2021 Jane Doe. Released under the MIT License.", 1, "mit", 1.0),
        3: ("Copyright (c) 2020, A.\n\n" + " ".join(f"word{i}" for i in range(60)) + "\n\n" + bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ") + "\n\nTHIS SOFTWARE IS PROVIDED AS IS.", 1, "bsd-clauses", 1.0),
        4: ("See below. " + apache.replace("Unless", "So unless") + " Ask us for more about all of this, or else read the manual of the tool first and then some more of it, please.", 1, "apache-2.0-notice", None),
        5: ("One part is released under the MIT License. Others are licensed under CC BY 4.0. by their authors", 2, "cc-by-short,mit", 1.0),
        6: ("Released under the MIT License.\nand it was released under the MIT License.", 2, "mit", 1.0),
        7: ("The licence was not released under any name, the MIT press said.", 0, "", None),
    }
    docs = spark.createDataFrame([(i, x[0]) for i, x in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: (r.n_units, r.licenses) for i, r in got.items()} == {i: x[1:3] for i, x in texts.items()}
    assert all(got[i].best_dice == x[3] for i, x in texts.items() if x[3])


def test_license_bounds_lose_nothing():
    assert licenses.size_bounds(6) == (4, 9)
    words = set(licenses.anchor_words(licenses.TEMPLATES))
    for t in licenses.TEMPLATES.values():
        grams = licenses.bigrams(t)
        held = [g for g in grams if words & set(g.split())]
        assert len(held) > len(grams) - licenses.size_bounds(len(grams))[0]


def brute_classes(rows, numerator=85):
    word = re.compile("[^\x20\x09-\x0d]+")
    sets = {}
    for i, t in rows:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("most", [96, 3])
def test_jaccard_join_matches_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "GROUP_NODES", most)
    rng = random.Random(most)
    word = lambda: rng.choice(["the", "of", "and"] + [f"w{i}" for i in range(300)])
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else " \n".join(own)))
    rows += [(1000, ""), (1001, "a b"), (1002, "A  b"), (1003, None), (1004, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert got == brute_classes(rows)


def test_jaccard_copies_and_salted_rows(spark, monkeypatch):
    """Thousands of copies are one node; the shuffled form gives the same rows as the broadcast one."""
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.range(4000).selectExpr("id + 10 as doc_id", f"case when id % 4 = 0 then 'alone ' || id || ' ' || (id * 7) || ' a b c' else '{text}' || if(id % 100 = 1, ' one more', '') end as text")
    expected = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert {c for i, (_, c) in expected.items() if (i - 10) % 4} == {11} and all(expected[i][1] == i for i in expected if (i - 10) % 4 == 0)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()} == expected


def test_jaccard_odd_rows(spark):
    rows = jaccard.link_documents(odd_rows(spark)).collect()
    assert len(rows) == 7 and {(r.doc_id, r.component_id) for r in rows} == {(i, i) for i in (1, 2, 3, 4, 5, None)}
    assert jaccard.link_documents(odd_rows(spark).limit(0)).count() == 0


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 60, 40)) for _ in range(3)]
        sets = [np.unique(np.concatenate([np.delete(b, rng.integers(0, len(b), rng.integers(0, 4))), rng.integers(100, 200, rng.integers(0, 3))])).astype(np.uint64) for b in base for _ in range(6)]
        rank = rng.integers(0, 128, jaccard.SKETCH).astype(np.uint8)
        union = link_group(jaccard.trie_order(sets, rank), list(range(len(sets))), 85, 100)
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = max(up[i], up[j]), min(up[i], up[j])
                    up = [new if x == old else x for x in up]
        roots = [union.root(i) for i in range(len(sets))]
        assert all((roots[i] == roots[j]) == (up[i] == up[j]) for i in range(len(sets)) for j in range(i))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op6_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    docs = odd_rows(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(docs, langid.train_on(docs)).collect()} == {"und"}
    model = langid.fit([(b"the and of the", "en"), (b"der und die das", "de")])
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd_rows(spark), model).collect()}
    assert got[1] == got[2] == got[5] == "und" and got[4] in ("en", "de")
    assert langid.identify(odd_rows(spark).limit(0), model).count() == 0


def test_language_letters_and_strips(spark, monkeypatch):
    model = langid.fit([(b"the and of the", "en"), (b"der und die das", "de")])
    docs = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ ³_"), (3, "1 ²é"), (4, "\u4e2d"), (5, "٣")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred != "und" for r in langid.identify(docs, model).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    texts = [b"", b"a", b"ab", "été und so weiter".encode() * 9, b"the end of"]
    whole = langid.presence(texts)
    for strip in (1, 2, 3, 7, 40):
        monkeypatch.setattr(langid, "STRIP", strip)
        assert (langid.presence(texts) == whole).all()


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = q.op4_quality_classifier(spark, sf_dir).collect()
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(p == y for _, y, p in held) >= 0.95 * len(held)


def plain_quality(model, text):
    """The network as loops over chunks of 16 bytes, one step each."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    padded = list(text) + [quality.PAD] * (-len(text) % 8)
    rows = [padded[i : i + 8] for i in range(0, len(padded), 8)]
    rows += [[quality.PAD] * 8] * 2
    chunks = [(rows[i], rows[i + 1]) for i in range(len(rows) - 1)]
    value = lambda f, a, b: sum(float(p["embed"][c] @ p[side][8 * i : 8 * i + 8, f]) for side, half in (("left", a), ("right", b)) for i, c in enumerate(half))
    top = [max(value(f, a, b) for a, b in chunks) for f in range(quality.FILTERS)]
    on = [max(0.0, t + b) for t, b in zip(top, p["bias"], strict=True)]
    hidden = [np.tanh(sum(on[f] * p["mix"][f, j] for f in range(len(on))) + p["mix_bias"][j]) for j in range(quality.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(hidden, p["out"], strict=True)) + p["out_bias"][0])))


def test_quality_equals_plain_loops(monkeypatch):
    model = quality.fit([(b"good words here and there", 1), (b"%%% %%% ###", 0), ("été".encode(), 1)] * 5)
    rng = random.Random(1)
    texts = [b"", b"x", b"12345678", b"123456789", rng.randbytes(40), b"a" * 61, rng.randbytes(100)]
    expected = [plain_quality(model, t) for t in texts]
    for strip in (1 << 16, 1, 2, 5):
        monkeypatch.setattr(quality, "STRIP", strip)
        assert np.allclose(model.scores(texts), expected, atol=1e-4), strip


def test_quality_gradient_equals_differences():
    model = quality.fit([(b"good words here and there", 1), (b"%%% %%% ###", 0)] * 5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    texts, y = [b"good or bad ### words", b"%%%", b"and some more of it all"], np.array([1.0, 0.0, 0.0])
    rng = np.random.default_rng(2)
    _, grad = model.loss(texts, y)
    for k, g in grad.items():
        for at in map(tuple, rng.permutation(np.argwhere(np.abs(g) > 1e-6))[:4]):
            values = []
            for h in (1e-6, -1e-6):
                model.p[k][at] += h
                values.append(model.loss(texts, y)[0])
                model.p[k][at] -= h
            assert np.isclose((values[0] - values[1]) / 2e-6, g[at], rtol=1e-3, atol=1e-8), (k, at)


def test_language_equals_dense_kernel_ridge():
    """With every text a landmark, the features span the kernel: scores equal kernel ridge regression on the whole kernel."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(w) for _ in range(8)).encode(), lang) for lang, w in (("en", ["the", "and", "with", "that"]), ("de", ["der", "und", "mit", "dass"]), ("fr", ["les", "et", "avec", "que"])) for _ in range(12)]
    model = langid.fit(rows)

    def grams(t):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in t)
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))

    texts = [t for t, _ in rows]
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    y = np.where(np.array([lang for _, lang in rows])[:, None] == np.array(model.languages), 1.0, -1.0)
    centre = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    alpha = np.linalg.solve(centre + langid.RIDGE * len(rows) * np.eye(len(rows)), y - y.mean(0))
    new = [b"the und avec", b"with that", b"mit der und", b"que les"]
    kn = np.array([[kernel(a, b) for b in texts] for a in new])
    dense = (kn - kn.mean(1)[:, None] - k.mean(0) + k.mean()) @ alpha + y.mean(0)
    got = model.scores(new)
    assert np.allclose(got, dense, atol=0.02) and (got.argmax(1) == dense.argmax(1)).all()


def test_quality_odd_rows(spark):
    docs = odd_rows(spark)
    model = quality.fit([(b"good words here", 1), (b"%%% %%%", 0)] * 3)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.train_on(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality"))).constant == 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := pii.digits_of(s)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(pii.digits_of(s)) <= 15),
]


def test_personal_base_spans_match_the_patterns(spark, small):
    rng = random.Random(2)
    parts = ["a@b.c", "a", "@", ".", "1", "1.2", "256", ".3.4", "-", " ", "+", "+1", "(555)", "4111 1111 1111 1111", "12345678901234", "é", "_", "%", "+1 (555) 555-1234", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m[0]))


def test_personal_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "+1" * 50_000, "+1" + "(" * 200_000):
        pii.base_spans(text)


def test_personal_model_adds_and_keeps(spark):
    docs = spark.createDataFrame([(1, "call (212) 555-0199 now"), (2, "plain words and 12345 only"), (3, "mail x.y@z.org, thanks"), (4, None)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    spans = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find_personal(docs).collect()}
    assert spans == {1: [("model_phone", "(212) 555-0199")], 2: [], 3: [("email", "x.y@z.org")], 4: []}
    rows = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert rows == {1: ("call [PHONE] now", 16), 2: ("plain words and 12345 only", 26), 3: ("mail [EMAIL], thanks", 20), 4: (None, None)}
    assert pii.find_personal(odd_rows(spark)).count() == 7 and pii.redact(odd_rows(spark).limit(0)).count() == 0


def test_viterbi_equals_all_paths():
    """The best of all tag paths of every line, with strong and weak transitions, also where lines touch."""
    rng = np.random.default_rng(11)
    code_pool = np.array([0, 5, 11, 400, 9_000, 30_001])
    for round_ in range(150):
        tags = int(rng.integers(2, 5))
        weights = lambda: rng.normal(0, 1, (crf.FEATURES, tags)) + (np.arange(tags) == 0) * rng.choice([0, 0.4, 1.0])  # noqa: E731, B023
        model = crf.Crf([str(i) for i in range(tags)], weights(), weights(), weights(), rng.normal(0, rng.choice([0.5, 3]), (tags, tags)), rng.normal(0, 1, tags))
        line = np.sort(rng.integers(0, 4, int(rng.integers(1, 14))))
        code = rng.choice(code_pool, len(line))
        got = model.decode(code, line)
        e = [w[crf.features_of(code)].sum(1) for w in (model.before, model.here, model.after)]
        for n in np.unique(line):
            at = np.flatnonzero(line == n)
            score = e[1][at].copy()
            score[1:] += e[0][at[:-1]]
            score[:-1] += e[2][at[1:]]
            value = lambda p: score[range(len(p)), p].sum() + model.first[p[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
            best = max(value(p) for p in itertools.product(range(tags), repeat=len(at))) if len(at) <= 6 else None
            assert best is None or np.isclose(value(tuple(got[at])), best), round_


def test_crf_gradient_equals_differences():
    rng = np.random.default_rng(3)
    table = crf.Table(pii.labelled_table(5, 12), pii.TAGS)
    count = len(pii.TAGS)
    theta = {"before": rng.normal(0, 0.3, (crf.FEATURES, count)), "here": rng.normal(0, 0.3, (crf.FEATURES, count)), "after": rng.normal(0, 0.3, (crf.FEATURES, count)), "step": rng.normal(0, 0.3, (count, count)), "first": rng.normal(0, 0.3, count)}
    _, grad = table.loss(theta)
    for k, g in grad.items():
        for at in map(tuple, rng.permutation(np.argwhere(np.abs(g) > 1e-4))[:4]):
            values = []
            for h in (1e-5, -1e-5):
                theta[k][at] += h
                values.append(table.loss(theta)[0])
                theta[k][at] -= h
            assert np.isclose((values[0] - values[1]) / 2e-5, g[at], rtol=1e-3, atol=1e-7), k


def test_personal_model_precision_and_recall():
    """On sentences that were not learnt from: spans by kind, whole and of the right kind."""
    model, good, wrong, missed = pii.trained(), Counter(), Counter(), Counter()

    def spans(tags):
        return {(i, len(list(itertools.takewhile(lambda t: t == f"I-{x[2:]}", tags[i + 1 :]))), x[2:]) for i, x in enumerate(tags) if x.startswith("B-")}  # noqa: B023

    for words, gold in pii.labelled_table(99, 500):
        data = np.frombuffer(b" ".join(words), np.uint8)
        code = crf.shapes(data, *crf.tokens(data))
        known, found = spans(gold), spans([model.tags[i] for i in model.decode(code, np.zeros(len(code), int))])
        good.update(k for *_, k in known & found)
        wrong.update(k for *_, k in found - known)
        missed.update(k for *_, k in known - found)
    for k in pii.KINDS:
        assert good[k] >= 0.9 * (good[k] + wrong[k]) and good[k] >= 0.9 * (good[k] + missed[k]), k


def test_personal_kinds_beyond_the_base(spark):
    texts = {
        "SSN 123-45-6789": [("model_national_id", "123-45-6789")],
        "his number is 020 7946 0958 today": [("model_phone", "020 7946 0958")],
        "please meet Mr. John Smith at 12 Baker Street, London": [("model_name", "John Smith"), ("model_address", "12 Baker Street")],
        "order 555-123-4567 was sent": [],
        "call 555-123-4567 now": [("model_phone", "555-123-4567")],
        "phone: 5551234567": [("model_phone", "5551234567")],
        "in 2024-01-02 the Street was closed": [],
        "The Big Dog went. Then He ran": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find_personal(docs).collect()} == dict(enumerate(texts.values()))


def test_personal_long_line():
    """A line of 300,000 words is decoded in stretches, not a step a word."""
    text = ("plain words of a line " * 60_000 + "call 555-123-4567 now").encode()
    data = np.frombuffer(text, np.uint8)
    began = time.time()
    assert [data[a:b].tobytes() for a, b, _ in pii.model_spans(pii.trained(), data, np.array([len(data) + 1]))] == [b"555-123-4567"]
    assert time.time() - began < 20


def test_pipeline_stages_take_clashing_columns(spark, small):
    """Columns named as the operators' own ones pass through every stage unchanged."""
    clashing = ["score", "lang_pred", "_bytes", "_row", "_id", "_text", "_key", "n_words", "n_hit", "items", "contaminated", "node", "n", "prefix", "component_id", "spans", "piece", "length"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    for c in clashing:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), "doc_id"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        rows = after.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in clashing), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()


def test_cluster_needs_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802  Spark's name
            return None

    class Session:
        sparkContext = Context()  # noqa: N815  Spark's name
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_path(Session(), "x")


def test_pipeline_stages_keep_their_contract(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        known = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= set(known)
        if name == "language_id":
            assert ids == {i for i, t in known.items() if any(c.isalpha() for c in t or "")}
        if name == "ngram_jaccard_join":
            assert ids == {c for _, c in brute_classes(list(known.items())).values()}
        if name == "pii":
            assert ids == set(known) and not any(pii.base_spans(r.text) for r in after.collect())
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, small).count() == packed.count()


def test_buckets_meet_in_one_shuffle(spark, monkeypatch):
    """As by aggregate and join, also where a token is common to all nodes; each n-gram and its node are shuffled once."""
    rng = random.Random(31)
    nodes = [(rng.getrandbits(63) - (1 << 62), sorted({7, *(rng.randrange(-300, 300) << 50 for _ in range(rng.randint(1, 9)))})) for _ in range(2500)]
    known = spark.createDataFrame([*nodes, (5, [1 << 40])], "node long, prefix array<long>").repartition(3)
    holders = {}
    for node, prefix in [*nodes, (5, [1 << 40])]:
        for token in prefix:
            holders.setdefault(token, []).append(node)
    expected = sorted((token, node, min(x)) for token, x in holders.items() if len(x) > 1 for node in x)
    for part_tokens in (1 << 20, 10):
        monkeypatch.setattr(jaccard, "PART_TOKENS", part_tokens)
        found = jaccard.buckets_of(known)
        assert sorted(map(tuple, found.collect())) == expected
    plan = jaccard.buckets_of(jaccard.materialise(known, "nodes"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert jaccard.buckets_of(known.limit(0)).collect() == []
