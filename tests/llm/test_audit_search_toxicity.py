"""The filter audit and the lexical search against SQL and brute force, the noisy channel against all readings."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations, product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import deobfuscate, filter_audit, lexical, queries, toxicity
from tidewatch.llm.deobfuscate import Restorer, decode, doubtful, language_model, lattice, strips, trigram_counts
from tidewatch.llm.langid import held_out


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_lexical_search"])
def test_queries_equal_sql(spark, small, name):
    sql = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        sql.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    found = queries.QUERIES[name](spark, small)
    result = sql.execute(queries.ORACLES[name])
    given = [x[0] for x in result.description]
    assert sorted(given) == sorted(found.columns)
    assert sorted(tuple(r[c] for c in given) for r in found.collect()) == sorted(result.fetchall())


# --- filter audit


def brute_audit(rows, labels):
    """rows of (id, text, part); labels of (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    ids = defaultdict(set)
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for name, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))):
            if bad:
                ids[name].add(i)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [i for i, _, p in rows if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                hit = [i for i in left if i in ids[f]]
                left = [i for i in left if i not in ids[f]]
                unique = sum(1 for i in own if [g for g in "ABCDE" if i in ids[g]] == [f])
                out[part, "".join(order), step] = [len(left), len(hit), sum(i in ids[f] for i in gone), unique, sum(i in good for i in hit), sum(i in toxic for i in hit)]
                gone += hit
                shapley[f] += len(hit)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark):
    """Null texts, ids and parts, repeated ids with equal and different texts, copies, labels that contradict each other."""
    rng = random.Random(12)
    bodies = ["", None, "a b c", "word " * 250, " ".join(f"w{i}" for i in range(210)), "ABC DEF " + " ".join(f"v{i}" for i in range(220)), "x#y " + " ".join(f"u{i}" for i in range(205)), "\u0085  é\x1f\x0b b", "cost $5 AND MORE"]
    rows = [(i, rng.choice(bodies), rng.choice(["en", "de", None, "x|y"])) for i in range(60)] + [(7, "a b c", "en"), (7, bodies[4], "de"), (None, "a b c", "en"), (None, "Q", None), (3, None, "en"), (3, None, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, part int, _id string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels = [x for x in labels if x[0] is not None]
    found = filter_audit.audit(docs, filter_audit.failing_ids(docs), table).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) and got == brute_audit(rows, labels)


def test_audit_of_other_filters_and_empty_tables(spark):
    """Any tables of ids can be audited; no documents give no rows; filters that nobody fails give zeros."""
    docs = spark.createDataFrame([(i, "t", "en") for i in range(10)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ids = {"odd": docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("_id")), "large": docs.where("doc_id > 6").select(F.col("doc_id").alias("_id")), "never": docs.where("false").select(F.col("doc_id").alias("_id"))}
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filter_audit.audit(docs, ids, none).collect()}
    assert found["oddlargenever", 1] == (5, 5, 0, 3) and found["oddlargenever", 2] == (4, 1, 2, 1) and found["neverlargeodd", 1] == (10, 0, 0, 0) and len(found) == 18
    empty = docs.limit(0)
    assert filter_audit.audit(empty, filter_audit.failing_ids(empty), none).count() == 0


def test_audit_runs_no_python(spark, small):
    plan = queries.op12_filter_audit(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- lexical search


def brute_search(docs, items, top=20):
    terms = lambda t: [m.lower() for m in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    known = [(i, Counter(terms(t))) for i, t in docs]
    known = [(i, c) for i, c in known if c]
    n, total = len(known), sum(c.total() for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in known:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))[:top], 1)]
    return out


ITEM_KEY = lambda r: (r[0] is not None, str(r[0]), r[1], r[3], str(r[2]))


@pytest.mark.parametrize(("block", "bucket", "first"), [(4 << 20, 1000, 1 / 32), (400, 7, 1 / 3)])
def test_search_matches_brute_force(spark, monkeypatch, block, bucket, first):
    """Ties, repeated rows, nulls in any column, copies, one very long text, blocks of items and small buckets."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "FIRST", first)
    rng = random.Random(13)
    word = lambda: f"w{int(rng.paretovariate(0.6))}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(1000 + i, "same old text w1 w2 W3") for i in range(40)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w1 w2"), (200, None), (201, ""), (202, "é,É;ß w1\x00w2"), (203, "w1 " * 30_000 + "w77")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(8)] + [(50, "w1 w1 w2 é"), (50, "w1 w1 w2 é"), (50, "w3 W3"), (51, None), (52, "unseen words"), (None, "w2 w77"), (53, "")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(5)
    asked = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search_documents(frame, asked).collect()]
    assert sorted(found, key=ITEM_KEY) == sorted(brute_search(docs, [x for x in items if x[1] is not None]), key=ITEM_KEY)
    if block > 1000:
        assert lexical.search_documents(frame.limit(0), asked).count() == 0 and lexical.search_documents(frame, asked.limit(0)).count() == 0
        named = lexical.search_documents(frame.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), asked, top=3)
        assert named.schema["doc_id"].dataType.simpleString() == "string" and named.groupBy("item_id").agg(F.max("rank").alias("m")).agg(F.max("m")).first()[0] <= 4


def test_bounds_prune_and_lose_nothing():
    """In buckets by length some vectors are never scored, and none of the best is among them."""
    rng = np.random.default_rng(8)
    weights = rng.integers(0, 9000, 400)
    items = [{int(c): int(n) for c, n in zip(rng.choice(400, 25, replace=False), rng.integers(1, 3, 25), strict=True)} for _ in range(12)]
    search = lexical.Search.of(lexical.Block(list(range(12)), items, {}), weights)
    vectors = []
    for i in range(3000):
        codes = rng.choice(400, int(rng.integers(1, 40)), replace=False)
        if i % 250 == 0:
            codes = np.array(list(items[i // 250]))
        vectors.append((codes, rng.integers(50_000, 900_000, len(codes))))
    length = np.array([math.sqrt(float(np.sum(weights[c] * x.astype(float) ** 2))) for c, x in vectors])
    order = np.argsort(-length)
    exact = np.array([[sum(n * int(weights[c]) * int(x) for c, x in zip(*vectors[d], strict=True) if (n := item.get(int(c)))) for d in order] for item in items])
    scored = total = 0
    best = [lexical.Best(0) for _ in items]
    for at in range(0, len(order), 200):
        part = [vectors[d] for d in order[at : at + 200]]
        bucket = lexical.Bucket.of(length[order[at : at + 200]], np.array([len(c) for c, _ in part]), np.concatenate([c for c, _ in part]), np.concatenate([x for _, x in part]))
        for i in range(12):
            total += 200
            if search.length[i] * bucket.length.max() * lexical.SLACK < best[i].threshold:
                assert (exact[i][at : at + 200] < best[i].threshold).all()
                continue
            chosen = bucket.survivors(search, i, best[i].threshold)
            scored += int(chosen.sum())
            assert (exact[i][at : at + 200][~chosen] < best[i].threshold).all()
            scores = bucket.scores(search, i, chosen)
            assert (scores[chosen] == exact[i][at : at + 200][chosen]).all()
            best[i].take(scores, list(range(at, at + 200)), 20)
    assert all([s for s, _ in b.rows] == sorted(e, reverse=True)[:20] for b, e in zip(best, exact.tolist(), strict=True))
    assert scored < 0.9 * total


def test_terms_of_long_texts(monkeypatch):
    text = b"Ab,cd \xc3\xa9f " * 40 + b"x" * 100 + b" y"
    whole = lexical.terms_of(text)
    monkeypatch.setattr(lexical, "STRIP", 7)
    assert lexical.terms_of(text) == whole and whole[b"ab"] == 40 and whole[b"x" * 100] == 1


# --- toxicity


def test_trigrams_match_plain_counting():
    texts = ["The cat, the hat. é!", "", "a", "  x1y  ", "ZZ"]
    plain = Counter()
    for t in texts:
        u = v = 0
        for c in t + "\n":
            s = ord(c.lower()) - 96 if "a" <= c.lower() <= "z" else 27 if ord(c) > 127 else 0
            if s or v:
                plain[(u if v else 0) * 784 + v * 28 + s] += 1
            u, v = (v, s) if s else (0, 0)
    counts = trigram_counts([t.encode() for t in texts])
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(plain)


def test_viterbi_equals_all_readings():
    """Every path through the lattices of random short stretches, scored from its definition."""
    rng = random.Random(4)
    model = language_model(np.random.default_rng(4).integers(0, 40, 28**3))
    for _ in range(300):
        stretch = "".join(rng.choice("ab1$é.ss0 ") for _ in range(rng.randint(1, 5)))
        best = None
        for path in product(*[[*r, *([None] if skip is not None else [])] for r, skip, _ in lattice(stretch)]):
            u = v = 0
            value, out = 0.0, []
            for pick, (_, skip, same) in zip(path, lattice(stretch), strict=True):
                if pick is None:
                    value += skip
                    continue
                s, letter, cost = pick
                if same and s != v:
                    break
                value += cost + (model[u * 28 + v][s] if s or v else 0.0)
                out.append(letter)
                u, v = (v, s) if s else (0, 0)
            else:
                value += model[u * 28 + v][0] if v else 0.0
                if best is None or value > best[0] + 1e-9:
                    best = (value, {"".join(out)})
                elif abs(value - best[0]) <= 1e-9:
                    best[1].add("".join(out))
        assert decode(stretch, model) in best[1], stretch


BAD = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
LEET = str.maketrans("oiletas", "0113745")
FORMS = [lambda w: w.translate(LEET), lambda w: w.replace("a", "@").replace("i", "!").replace("s", "$"), " ".join, ".".join, "-".join, lambda w: "".join(c * 4 if c in "aeiou" else c for c in w), lambda w: w.upper(), lambda w: "  ".join(w.translate(LEET)), lambda w: w[:2] + "***" + w[2:]]


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, toxicity.train_on(docs, labels.where(~held_out("doc_id", 3, 1)))


def test_toxicity_held_out_accuracy(fitted):
    docs, labels, model = fitted
    known = labels.where(held_out("doc_id", 3, 1))
    rows = toxicity.score_toxicity(docs.join(known, "doc_id"), model).join(known, "doc_id").select("score", "toxic").collect()
    sure, toxic = [r for r in rows if r.score >= 0.7], [r for r in rows if r.toxic == 1]
    assert len(toxic) > 100 and sum(r.toxic for r in sure) >= 0.97 * len(sure) and sum(r.score >= 0.7 for r in toxic) >= 0.88 * len(toxic)


def test_disguised_words_are_found_and_clean_texts_left_alone(spark, fitted):
    docs, _, model = fitted
    clean = [r.text for r in docs.where("lang = 'en' and n_chars between 300 and 900").join(fitted[1].where("toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(60).collect()]
    plants = [(1000 * f + k, f"{clean[k][:150]} the {form(w)} of {form(BAD[k - 1])} {clean[k][150:300]}") for f, form in enumerate(FORMS) for k, w in enumerate(BAD)]
    odd = ["call 555-8013 or mail m4rk@x1.example.com", "sha d41d8cd98f00b204e9800998ecf8427e v2.10.3", "a b c d e f g", "I I I !!! $$$ 100%", "2nd 3rd 4th B2B H2O MP3 i18n", "www.example.com/a1/b2?c=3"]
    rows = plants + [(-1 - i, t) for i, t in enumerate(clean + odd)]
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    missed = [i for i, _ in plants if scores[i] < 0.7]
    assert len(missed) <= 3, missed
    assert not [i for i, s in scores.items() if i < 0 and s >= 0.7]


def test_toxicity_odd_rows(spark, fitted):
    """Nulls, empty and very long texts, repeated rows, clashing columns, empty tables, no labels, one kind of label."""
    _, labels, model = fitted
    rows = [(1, None), (2, ""), (3, "idiot stupid"), (3, "idiot stupid"), (None, "you idiot"), (4, "so " * 600_000 + "i d i o t"), (5, "1" * 3_000_000), (6, "a1" * 5_000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, toxic int")
    found = [(r.doc_id, r.score, r.found) for r in toxicity.score_toxicity(docs, model).collect()]
    by_id = dict((i, (s, f)) for i, s, f in found)
    assert len(found) == len(rows) and by_id[1] == by_id[2] and by_id[1][0] < 0.1 and by_id[3] == (by_id[3][0], ["idiot", "stupid"]) and by_id[3][0] > 0.9 and by_id[None][0] > 0.9 and by_id[4][1] == ["idiot"]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    none = labels.limit(0)
    for given, score in ((none, 0.0), (spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int"), 0.0), (spark.createDataFrame([(2, 1), (4, 1)], "doc_id long, toxic int"), 1.0)):
        rest = toxicity.score_toxicity(docs, toxicity.train_on(docs, given)).collect()
        assert {round(r.score, 6) for r in rest} == {score}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train_on(docs.limit(0), none)).count() == 0


def test_strips_and_cache_change_nothing(monkeypatch):
    model = language_model(trigram_counts([b"you idiot and the trash of stupid people " * 50]))
    text = b"the 1d10t and s t u p i d tr4sh.  " * 50
    whole = toxicity.words_of(text, Restorer(model))
    monkeypatch.setattr(deobfuscate, "STRIP", 100)
    assert b"".join(strips(text)) == text and len(list(strips(text))) > 10
    assert toxicity.words_of(text, Restorer(model, most=1)) == whole and whole["idiot"] == whole["stupid"] == whole["trash"] == 50


def test_doubtful_stretches():
    found = lambda t: [t.encode()[a:b].decode() for a, b in doubtful(np.frombuffer(t.encode(), np.uint8))]
    assert found("plain words, 42 and 3.14 (ok)") == []
    assert found("an 1d10t s t u p i d b.a.d sooo ttrr x tr***ash w*rd well-known --so the***") == ["1d10t", "s t u p i d", "b.a.d", "sooo", "ttrr", "tr***ash", "w*rd"]
    assert found("") == found(" ") == [] and found("a b") == [] and found("a b c") == ["a b c"]


def test_regression_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=200) > 0).astype(float)
    w, b = toxicity.regression(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (y - p) - toxicity.RIDGE * w).max() < 1e-4 and abs((y - p).sum()) < 1e-4
