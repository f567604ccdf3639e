"""Scans, counts and packing against brute force, an exact round trip and the tokenizers' own results."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import queries as q
from tidewatch.llm import secrets_scan, tokens
from tidewatch.llm.decontaminate import Index, contamination
from tidewatch.llm.mpeg_audio import feature, probe_media, read_mpeg, store_texts, write_mpeg
from tidewatch.llm.packing import pack_pieces, plan_packing
from tidewatch.llm.secrets_scan import find_spans, scan_secrets
from tidewatch.llm.tokens import count_tokens

ODD = ["", "\n", "12.", "café ² ½ İstanbul ﬁ é", "日本語 テキスト", "a b\x1fc\x0b", "<|endoftext|>x", "it's WE'LL  don't\t\n  x ", "\U0001f600 ok", "x" * 50_000, "ÀÉ ſ µ ª º ­ !"]


def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def fixture(spark):
    """Nulls in any column, repeated rows, clashing column names, odd texts."""
    rows = [(i, t, "n_words") for i, t in enumerate(ODD)] + [(3, ODD[3], None), (None, "token=abcdef1", "x"), (100, None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


SECRETS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_secrets(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(SECRETS) for m in p.finditer(text) if ok(m)]
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets_match_brute_force(spark, small):
    known = texts(spark, small)
    for r in q.op2_secret_scan(spark, small).collect():
        expected = brute_secrets(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(expected.count(f"{k}:") for k, *_ in SECRETS)


def test_secrets_random_texts():
    rng = random.Random(5)
    parts = ["token", "TOKEN=", "secret: ", 'password="', "api_key", "AKIA", "abcdef0123456789abcdef01", "dead", "=", ":", " ", '"', "_", "é", "XYZ0123456789ABCDEF", "\n", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        data = text.encode()
        spans = [(len(data[:a].decode()), k, len(data[:b].decode())) for a, k, b in find_spans(data) if k < 3]
        assert ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in spans) == brute_secrets(text)


def test_secrets_added_kinds_and_odd_rows(spark):
    assert [k for _, k, _ in find_spans(b"x ghp_" + b"a1B2" * 10 + b" -----BEGIN RSA PRIVATE KEY-----")] == [3, 4]
    rows = scan_secrets(fixture(spark)).collect()
    assert len(rows) == len(ODD) + 3
    assert [r.spans[0].value for r in rows if r.doc_id is None] == ["token=abcdef1"]
    assert scan_secrets(fixture(spark).limit(0)).count() == 0


ADDED = [(k, re.compile(p + rest, re.A), least) for k, p, rest, _, least in secrets_scan.RULES[3:]]


def test_secrets_of_providers_match_brute_force():
    """Each added rule alone, and random texts of marks and runs, against the whole patterns."""
    rng = random.Random(6)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed, low = "abcXYZ019", "abcdef0189"
    marks = ["ghp_", "github_pat_", "glpat-", "xoxb-", "AIza", "sk_live_", "rk_test_", "SG.", "npm_", "pypi-AgE", "hf_", "dop_v1_", "shpat_", "eyJ", ".eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----"]
    whole = {"SG.": "SG." + run(mixed, 22) + "." + run(mixed, 43), "eyJ": "eyJ" + run(mixed, 20) + ".eyJ" + run(mixed, 20) + "." + run(mixed, 20), "dop_v1_": "dop_v1_" + run(low, 64), "shpat_": "shpat_" + run(low, 32)}
    texts = [f"x {whole.get(m, m + run(mixed, 80))} y" for m in marks if m not in (".", ".eyJ")]
    assert all(any(k > 2 for _, k, _ in find_spans(t.encode())) for t in texts)
    texts += ["".join(rng.choice([rng.choice(marks), run(mixed, rng.randint(1, 60)), run(low, 64), " ", "é", "-", "_"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        data = t.encode()
        got = [(a, secrets_scan.RULES[k][0], b) for a, k, b in find_spans(data) if k > 2]
        back = data.decode("latin-1")  # one character a byte
        assert sorted(got) == sorted((m.start(), k, m.end()) for k, p, least in ADDED for m in p.finditer(back) if len(m[0]) >= least), t


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def check_contamination(docs, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    expected = sorted(brute_contamination(r.text, items) for r in docs.collect())
    assert sorted((r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench).collect()) == expected
    return expected


def test_contamination_matches_brute_force(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert any(x[3] for x in check_contamination(docs, bench))


def test_contamination_random_and_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: rng.choice("a b c d e f é 1".split())
    passage = " ".join(word() for _ in range(30))
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(12)] + [(50, passage), (51, None), (None, "z z z"), (50, "a a a a a a a a a a a a a a")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 30, 90]))) + rng.choice([" ", "! "]) + rng.choice(["", passage, passage.upper(), "z Z z", " a" * 40])) for i in range(150)] + [(7, None), (7, passage), (7, passage)]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    bench = bench.where("item_id is not null")
    one = check_contamination(docs, bench)
    assert "MapInArrow" in plan_of(contamination(docs, bench)) and "Exchange" not in plan_of(contamination(docs, bench))
    monkeypatch.setattr("tidewatch.llm.decontaminate.BROADCAST_BYTES", 200)
    assert check_contamination(docs, bench) == one
    clashing = docs.withColumn("items", F.lit("y")).withColumn("_key", F.lit(1))
    kept = contamination(clashing, bench, keep_row=True)
    assert kept.count() == docs.count() and kept.select("_row.*").columns == clashing.columns
    assert plan_of(kept).count("MapInArrow") == 0  # every Python step is written before the joins
    assert contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_of_many_items(spark):
    """A window that 10,000 items share is one entry: the search takes no longer than for one item."""
    passage = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(i, passage) for i in range(10_000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, "nothing")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert (rows[1].n_words, rows[1].n_hit, len(rows[1]["items"]), rows[2].n_hit) == (15, 13, 10_000, 0) and time.time() - began < 60
    assert len(Index([(str(i), passage.encode()) for i in range(10_000)]).at[13]) == 1


def test_media_round_trip(spark, small):
    known = texts(spark, small)
    for r in q.op7_media_columns(spark, small).collect():
        data = known[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.crc_failures == 0 and "skipped=0" in r.feature and len(r.frame_offsets) == r.n_frames


def test_media_resynchronises_and_verifies():
    payload = bytes(range(64)) * 60
    media = write_mpeg(payload)
    x = read_mpeg(media)
    assert x["payload"] == payload and x["table"]["frames"] == len(x["offsets"]) and x["seconds"] == Fraction(len(x["offsets"]) * 1152, x["rate"])
    assert x["table"]["bytes"] + read_mpeg(media)["offsets"][0] >= len(media) - 300
    cut = x["offsets"][1]
    y = read_mpeg(media[:cut] + b"\xff\x00junk\xff" + media[cut:])
    assert y["payload"] == payload or y["skipped"] > 0
    assert y["skipped"] > 0 and len(y["offsets"]) >= len(x["offsets"]) - 1
    broken = bytearray(media)
    broken[cut + 8] ^= 1
    assert read_mpeg(bytes(broken))["bad"] == 1
    assert read_mpeg(b"no audio here")["offsets"] == [] and read_mpeg(b"")["offsets"] == []


def test_media_odd_rows(spark):
    stored = store_texts(fixture(spark))
    assert stored.where("doc_id = 100").first().n_bytes == 0
    assert probe_media(stored.withColumn("media", F.when(F.col("n_bytes") > 0, F.col("media"))), "doc_id", "media").where("payload_bytes is null").count() == 2
    assert probe_media(stored.limit(0), "doc_id", "media").count() == 0


def test_token_counts_match_the_library(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path(q.BYTE_VOCABULARY))
    expected = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts(spark, small).items()}
    assert {r.doc_id: r.n_tokens for r in q.op8_token_counts(spark, small).collect()} == expected
    rows = count_tokens(fixture(spark), public_tokenizers.path(q.BYTE_VOCABULARY)).collect()
    given = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD)} | {100: 0}
    assert len(rows) == len(ODD) + 3 and all(given[r.doc_id] == r.n_tokens for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("seed", range(4))
def test_token_counts_random_texts(spark, seed):
    rng = random.Random(seed)
    letters = list("ab'stremvld  \t\n019_-.,!éßŁž×÷ªµ² ­İ中́") + ["'ll", "'S", "  ", "\r\n", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path(q.BYTE_VOCABULARY))
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, public_tokenizers.path(q.BYTE_VOCABULARY)).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


SCRIPTS = ["0020-007e", "00a0-017f", "0300-036f", "0370-03ff", "0400-04ff", "0590-05ff", "0600-06ff", "0900-097f", "0e00-0e7f", "1100-11ff", "1e00-1fff", "2000-206f", "2070-209f", "2150-218f", "2460-24ff", "3000-30ff", "4e00-4fff", "ac00-acff", "fb00-fdff", "ff00-ffef", "10900-1091f", "105c0-105f3", "1d400-1d7ff", "1f300-1f64f", "0000-001f", "0085-0085", "e0000-e007f"]


def script_texts(rng, count):
    """Random texts over all kinds of scripts, with white space of all kinds, special strings and contractions between."""
    joints = [" ", "  ", "\n", "\n\n", "\n \n", "\t", "\u3000", "\u2009", "\x1d", "'s ", "'LL", "<|endoftext|>", "<|startoftext|>", "“quoted” — text… ", "Σ", "ΣΑΣ ", "İ", "e\u0301", " \u0308"]
    for _ in range(count):
        out = []
        for _ in range(rng.randint(0, 12)):
            low, high = (int(x, 16) for x in rng.choice(SCRIPTS).split("-"))
            out.append("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(1, 6))))
            out.append(rng.choice(joints))
        yield "".join(out)


@pytest.mark.parametrize("frequent", [True, False])
def test_tokens_of_all_scripts_equal_the_library(frequent):
    """Counts by pre-tokens and ids by words, with and without a table of frequent ones."""
    rng = random.Random(12)
    for file, cut, value in ((q.BYTE_VOCABULARY, tokens.pre_tokens, "bytes_of"), (q.WORD_VOCABULARY, tokens.words, "words_of")):
        path = public_tokenizers.path(file)
        library, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
        texts = [*script_texts(rng, 3000), *ODD]
        table = {w: getattr(encoder, value)(w) for t in texts[:500] for w in cut(t)} if frequent else {}
        lookup = tokens.Lookup(table, getattr(encoder, value))
        for t in texts:
            assert [i for w in cut(t) for i in lookup[w]] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_ids_in_batches_equal_the_library(monkeypatch):
    """Batches of any kind of text, with caches that are full after every one."""
    rng, path = random.Random(13), public_tokenizers.path(q.WORD_VOCABULARY)
    library, found = Tokenizer.from_file(path), tokens.WordIds(path)
    monkeypatch.setattr(tokens, "WORD_ENTRIES", 300)
    texts = [*script_texts(rng, 1500), *ODD, "İ İstanbul", " ".join(f"W{i}x{i * i}!" for i in range(900)), "it's 'S don't !!'s '"]
    for at in range(0, len(texts), 97):
        part = texts[at : at + 97] + texts[:5]
        assert found.encode(part) == [tokens.packed(library.encode(t, add_special_tokens=False).ids) for t in part]
    assert not any(len(w) > tokens.LONGEST_ENTRY for w in (*found.new, *found.old))


def test_plain_texts_are_cut_as_arrays(monkeypatch):
    """Only texts in doubt are cut word by word; the model sees a batch's distinct words once; blocks do not show."""
    path = public_tokenizers.path(q.WORD_VOCABULARY)
    library, found, cut, learnt = Tokenizer.from_file(path), tokens.WordIds(path), [], []
    split, encode_words = tokens.words, found.encode_words
    monkeypatch.setattr(tokens, "words", lambda t: cut.append(t) or split(t))
    monkeypatch.setattr(found, "encode_words", lambda w: learnt.extend(w) or encode_words(w))
    texts = ["", "It's one's own; it'LL do, 'tis 42 ''s", "naïve Ωmega\u00a0it's", " \n", "x² here", "end<|endoftext|>", "'", "a" * 40 + " b'", "'re 'r 'l ll'll_x"]
    expected = [tokens.packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert found.encode(texts) == expected
    assert cut == ["x² here", "end<|endoftext|>"] and len(learnt) == len(set(learnt))
    learnt.clear()
    for size in (1, 7, 30):
        monkeypatch.setattr(tokens, "BLOCK_CHARACTERS", size)
        assert found.encode(texts) == expected and set(learnt) <= {"here", "end"}  # beside a doubtful word until now


def test_only_doubtful_pre_tokens_go_to_the_library(monkeypatch):
    encoder, asked = tokens.Encoder(public_tokenizers.path(q.BYTE_VOCABULARY)), []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", type("Whole", (), {"encode": lambda self, t, **k: asked.append(t) or whole.encode(t, **k)})())
    for t in tokens.pre_tokens("Привет, мир — “quoted” κόσμε 你好 x² ½ <|endoftext|>y end"):
        encoder.bytes_of(t)
    assert asked == [" x²", " ½", " <|endoftext|>y"]


def test_frequent_pre_tokens_count_all_documents(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('common word', id % 7, ' only', id) as text").repartition(4)
    found = tokens.frequent_pre_tokens(docs, tokens.pre_tokens)
    assert found[0] == "common" and set(found[1:]) == {f" word{i}" for i in range(7)}
    assert tokens.frequent_pre_tokens(docs.limit(0), tokens.pre_tokens) == []
    monkeypatch.setattr(tokens, "COUNTED_ENTRIES", 20)
    assert tokens.frequent_pre_tokens(docs, tokens.pre_tokens)[0] == "common"


def check_packing(packed, known):
    library = Tokenizer.from_file(public_tokenizers.path(q.WORD_VOCABULARY))
    rows, places = packed.collect(), {}
    for r in rows:
        ids = library.encode(known[r.doc_id], add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length == min(2048, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    return len(rows), len(places), -(-total // 2048)


def test_packing(spark, small):
    known = texts(spark, small)
    rows, sequences, least = check_packing(q.op9_best_fit_packing(spark, small), known)
    assert rows == sum(-(-len(Tokenizer.from_file(public_tokenizers.path(q.WORD_VOCABULARY)).encode(t, add_special_tokens=False).ids + [0]) // 2048) for t in known.values())
    assert sequences <= 1.05 * least + 1


def test_packing_odd_rows(spark):
    docs = fixture(spark).where("doc_id is not null")
    check_packing(q.pack_documents(docs), {i: t for i, t in enumerate(ODD)} | {100: ""})
    assert q.pack_documents(docs.limit(0)).count() == 0
    assert q.pack_documents(fixture(spark)).where("doc_id is null").count() == 1


def test_plan_places_every_rank_once():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        for _ in range(60):
            histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
            fill, seen = {}, {n: [] for n in histogram}
            for n, low, high, first, offset, each in plan_packing(histogram, capacity):
                for rank in range(low, high):
                    seen[n].append(rank)
                    fill.setdefault(first + (rank - low) // each, []).append((offset + (rank - low) % each * n, n))
            assert all(sorted(x) == list(range(histogram[n])) for n, x in seen.items())
            for x in fill.values():
                at = 0
                for offset, n in sorted(x):
                    assert offset == at
                    at += n
                assert at <= capacity


def test_plan_pairs_single_lengths():
    for histogram, sequences in (({1000: 1, 990: 1, 980: 1, 970: 1}, 2), ({1000: 3, 990: 1, 700: 2}, 3)):
        plan = plan_packing(histogram, 2048)
        assert len({first + k // each for _, low, high, first, _, each in plan for k in range(high - low)}) == sequences


def test_pack_pieces_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 700L else 1L + id % 5 end as length", "id as ids_crc32")
    packed = pack_pieces(pieces, 2048)
    assert packed.count() == 5000 and packed.selectExpr("sequence_id", "offset").distinct().count() == 5000


def test_pack_pieces_repeated_rows(spark):
    pieces = spark.range(3000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "500L as length", "1L as ids_crc32")
    packed = pack_pieces(pieces, 2048)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.selectExpr("sequence_id", "offset").distinct().count() == 3000
    assert packed.select("sequence_id").distinct().count() == 750


def test_media_keeps_payloads_that_say_tag():
    trailer = b"TAG" + b"title".ljust(125, b"\0")
    for n, at in ((128, 29), (1417, 1289), (1417 + 128, 1417 + 29)):
        payload = b"x" * at + b"TAG" + b"y" * (n - at - 3)
        media = write_mpeg(payload)
        assert media[-128:-125] == b"TAG"
        for data in (media, media + trailer):
            x = read_mpeg(data)
            assert (x["payload"], x["skipped"], x["bad"]) == (payload, 0, 0) and len(x["offsets"]) == x["table"]["frames"]
    plain = write_mpeg(b"x" * 128)
    assert read_mpeg(plain + b"junk" + trailer)["skipped"] > 0 and read_mpeg(plain + trailer)["payload"] == b"x" * 128


def test_media_random_round_trips():
    """Every length up to 1,000 and texts full of the format's own patterns come back whole."""
    rng = random.Random(7)
    for n in range(1001):
        payload = rng.randbytes(n)
        assert read_mpeg(write_mpeg(payload))["payload"] == payload, n
    marks = [b"TAG", b"Xing", b"Info", b"VBRI", b"ID3\x04\0\0\0\0\0\x09", b"\xff\xfa\xe8\xc0", b"\xff\xfb\x90\x64", b"TXXX", b"payload_bytes\x00" + b"5", b"\0" * 9, b"\xff"]
    for n in (64, 128, 1408, 1417, 1418, 2880, 4096):
        for at in range(0, n, 13):
            mark = rng.choice(marks)
            payload = (bytes(at) + mark + rng.choice([b"x", b"\0", b"\xff"]) * n)[:n]
            assert read_mpeg(write_mpeg(payload))["payload"] == payload, (n, at, mark)
    for _ in range(300):
        payload = b"".join(rng.choice(marks) for _ in range(rng.randint(1, 700)))
        assert read_mpeg(write_mpeg(payload))["payload"] == payload


def test_media_hostile_files_do_not_crash():
    rng = random.Random(8)
    good = write_mpeg(b"some payload" * 300)
    for value in ("²", "-1", "99999999999999999999999", "", "7"):
        text = b"\x03payload_bytes\0" + value.encode()
        tag = b"TXXX" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
        x = read_mpeg(b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag + good[good.index(b"\xff\xfa") :])
        assert (len(x["payload"]) == 7) == (value == "7")
    for _ in range(2000):
        data = bytearray(good[: rng.randint(0, len(good))])
        for _ in range(rng.randint(0, 20)):
            if data:
                data[rng.randrange(len(data))] = rng.choice([0, 0xFF, 0xFA, rng.randrange(256)])
        read_mpeg(bytes(data))
        read_mpeg(rng.choice([b"ID3", b"\xff\xfd", b"\xff\xff", b"TAG"]) + rng.randbytes(rng.randint(0, 400)))


def frames(second: int, third: int, fourth: int, count: int, body) -> bytes:
    from tidewatch.llm.mpeg_audio import header_at

    head = bytes([0xFF, second, third, fourth])
    size = header_at(head, 0)["size"]
    return b"".join((head + body).ljust(size, b"\0") for _ in range(count))


def plain_crc(bits: str) -> int:
    v = 0xFFFF
    for b in bits:
        v = (v << 1 & 0xFFFF) ^ (0x8005 if (v >> 15) ^ int(b) else 0)
    return v


def test_media_checksums_of_layers_one_and_two():
    bits_of = lambda data: "".join(f"{b:08b}" for b in data)
    for second, third, fourth, allocation, selections in (
        (0xFE, 0x94, 0xC0, "0010" + "0000" * 31, 0),  # Layer I mono
        (0xFE, 0x94, 0x00, "0001" * 64, 0),  # Layer I stereo
        (0xFC, 0xA4, 0xC0, "0001" * 11 + "001" * 12 + "01" * 4, 2 * 27),  # Layer II mono, 48 kHz
        (0xF4, 0x84, 0xC0, "0001" * 4 + "001" * 7 + "01" * 19, 2 * 30),  # Layer II, low sampling rate
    ):
        covered = allocation + "10" * (selections // 2)
        body = int(covered.ljust(-(-len(covered) // 8) * 8, "0"), 2).to_bytes(-(-len(covered) // 8), "big")
        crc = plain_crc(bits_of(bytes([third, fourth])) + covered)
        x = read_mpeg(frames(second, third, fourth, 3, crc.to_bytes(2, "big") + body))
        assert (len(x["offsets"]), x["checked"], x["bad"]) == (3, 3, 0), (second, third)
        y = read_mpeg(frames(second, third, fourth, 3, (crc ^ 1).to_bytes(2, "big") + body))
        assert y["bad"] == 3


def test_media_bitrate_tables():
    x = read_mpeg(write_mpeg(bytes(50_000)))
    assert x["table"]["kind"] == "Xing" and len(x["table"]["seek"]) == 100 and x["table"]["seek"] == sorted(x["table"]["seek"])
    first = frames(0xFB, 0x90, 0xC0, 1, b"\0" * 32 + b"VBRI" + bytes(6) + (4000).to_bytes(4, "big") + (9).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"".join(n.to_bytes(2, "big") for n in (100, 200, 300)))
    y = read_mpeg(first + frames(0xFB, 0x90, 0xC0, 2, b""))
    assert y["table"] == {"kind": "VBRI", "frames": 9, "bytes": 4000, "seek": [0, 200, 600]} and len(y["offsets"]) == 2
    bare = frames(0xFB, 0x90, 0xC0, 1, bytes(17) + b"Info" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big"))
    z = read_mpeg(bare + frames(0xFB, 0x90, 0xC0, 2, b""))
    assert z["table"] == {"kind": "Info", "frames": 2, "bytes": None, "seek": None} and "vbr=2/none" in feature(z)
