"""The ten operators against brute force, round trips and held-out rows, with nulls, ties, empties and odd columns."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import types
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, common, decontaminate, html_extract, line_dedup, ngram_join, quality_classifier, quality_rules, secret_scan, sentencepieces, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
ODD = ["", " \n\t", "one", "a b c d", "x " * 3000, "é ü 你好 🙂 " * 30, " no break "]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, __id string")


def corpus(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]


# ---------------------------------------------------------------- helpers


def test_word_hashes():
    texts = ["Ab cd\x0bef", "", "cd", None, "ef ab", "x" * 300_000 + " tail", "tail"]
    found = {}
    for lo, hi, h, b in common.words_of(pa.array(texts, pa.string()), True):
        found |= {r: h[b[r - lo] : b[r - lo + 1]].tolist() for r in range(lo, hi)}
    assert [len(found[i]) for i in range(7)] == [3, 0, 1, 0, 2, 2, 1]
    assert found[0] == [found[4][1], found[2][0], found[4][0]] and found[5][1] == found[6][0]
    long = " ".join(f"word{i}" for i in range(400_000))
    (_, _, h, _), = common.words_of(pa.array([long]), False)
    (_, _, last, _), = common.words_of(pa.array(["word399999"]), False)
    assert len(h) == 400_000 and h[-1] == last[0] and len(np.unique(h)) == 400_000


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 540)]
    of = {n: n for e in edges for n in e}

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in common.components(common.Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


# ---------------------------------------------------------------- 1 quality rules


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if runs[(w[i], w[i + 1], w[i + 2])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_quality_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame(spark, [*ODD, None, "l\nl\nl\n\n \n \n", "a b c a b c"], 10**6).select("doc_id", "text"))
    got = {r["doc_id"]: r for r in quality_rules.quality_report(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = got[r["doc_id"]]
        n, chars, symbols, lines, repeated = base_counts(r["text"])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert x["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and (not x["kept"] or not x["base_failed"])


def brute_distances(text):
    """(whether it is rejected for all, language, character distance, word distance) by plain counting."""
    kinds = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", None, "0123456789", " \t\n\r\x0b\x0c", ".,;:!?'\"()-"]
    of = lambda c: 3 if ord(c) > 127 else next((k for k, x in enumerate(kinds) if x and c in x), 7)
    letters, words = collections.Counter(map(of, text)), collections.Counter(WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))

    def distance(counts, shares):
        total, both = sum(counts.values()), 0.0
        for k in {*counts, *shares}:
            p, q = counts.get(k, 0) / total if total else 0, shares.get(k, 0)
            both += (p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0)
        return math.sqrt(max(0, both / 2)) if total else 0.0

    lists = {k: dict(zip(x.split()[::2], (float(y) / 100 for y in x.split()[1::2]), strict=True)) for k, x in quality_rules.WORD_REFERENCES.items()}
    known = {w for x in lists.values() for w in x}
    seen = collections.Counter()
    for w, n in words.items():
        seen[w if w in known else None] += n
    found, n = [], sum(words.values())
    for k, (language, shares) in enumerate(quality_rules.CHAR_REFERENCES.items()):
        char = distance(letters, {j: x / sum(shares) for j, x in enumerate(shares)})
        word = distance(seen, lists[language] | {None: 1 - sum(lists[language].values())})
        far = len(text) >= 200 and char > 0.2 + 1 / len(text) ** 0.5 or n >= 50 and word > 0.29 + 1 / n**0.5 or len(text) >= 200 and n >= 50 and char > 0.2 and word > 0.29
        found.append((far, char + word, k, language, char, word))
    return min(found)[:1] + min(found)[3:]


def test_quality_verdict_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame(spark, [*ODD, None, "short junk ### " * 4, "zz! " * 45], 10**6).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for least in (50, 3):
        for x in quality_rules.quality_report(docs, base_words=least).collect():
            text = texts[x["doc_id"]]
            far, language, char, word = brute_distances(text)
            assert x["language"] == language and x["char_distance"] == pytest.approx(char, abs=1e-7) and x["word_distance"] == pytest.approx(word, abs=1e-7)
            n, _, _, _, repeated = base_counts(text)
            assert x["kept"] == (n >= least and 100 * repeated <= 50 * n and not far)


def test_quality_guards(spark):
    """Texts too short for a histogram pass its rule, if the base rule lets them come to it."""
    junk = [" ".join(f"XQ{k}Z#{k}" for k in range(n)) for n in (10, 49, 60)]
    got = [r["kept"] for r in quality_rules.quality_report(frame(spark, junk), base_words=5).orderBy("doc_id").collect()]
    assert got == [True, False, False]
    words = [" ".join(f"gleam{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(n)) for n in (49, 60)]
    assert [(r["kept"], r["word_distance"] > 0.29) for r in quality_rules.quality_report(frame(spark, words), max_char=1.0, max_word=0.1, base_words=5).orderBy("doc_id").collect()] == [(True, True), (False, True)]


def test_quality_rules_keep_clean_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    report = quality_rules.quality_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    got = {r["quality"]: (r["n"], r["kept"]) for r in report.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1][0] == got[1][1] and got[0][1] < 0.4 * got[0][0]
    assert quality_rules.filter_quality(frame(spark, [None, ""])).columns == ["doc_id", "text", "label", "__id"]
    assert quality_rules.filter_quality(frame(spark, []).limit(0)).count() == 0


def test_quality_rules_reject_short_junk(spark):
    """Short texts that miss both references are rejected; one distance alone has the allowance of chance."""
    rng = random.Random(5)
    junk = " ".join("".join(rng.choices("XQZ#$7%w", k=5)) for _ in range(60))
    odd = " ".join("".join(rng.choices("aeioutnsrldcm", k=6)) for _ in range(60))
    got = {r["doc_id"]: r for r in quality_rules.quality_report(frame(spark, [junk, odd])).collect()}
    assert not got[0]["base_failed"] and not got[0]["kept"] and min(got[0]["char_distance"] / 0.2, got[0]["word_distance"] / 0.29) > 1
    assert got[1]["kept"] and got[1]["char_distance"] <= 0.2 and got[1]["word_distance"] > 0.29


def test_js_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.5, 0.5])
    assert quality_rules.js_distance(p, q)[0] == pytest.approx(np.sqrt(0.5)) and quality_rules.js_distance(p, p[0])[0] == 0


# ---------------------------------------------------------------- 2 classifier


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(frame(spark, ["", None], 10**6).select("doc_id", "text"))
    rows = quality_classifier.score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows) and len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    pairs = [a["score"] > b["score"] for a in held if a["quality"] == 1 for b in held if b["quality"] == 0]
    assert sum(pairs) / len(pairs) > 0.98
    empty = quality_classifier.score_quality(docs.limit(3), labels.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}


def test_dual_coordinate_descent():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)).astype(np.int32) for _ in range(200)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    w, b = quality_classifier.dual_coordinate_descent(rows, [np.ones(5) for _ in rows], y, np.full(200, 10.0), 20, 200)
    loss = lambda w, b: (w @ w + b * b) / 2 + 10 * sum(max(0, 1 - t * (w[r].sum() + b)) for r, t in zip(rows, y, strict=True))
    best = loss(w, b)
    assert all(best <= loss(w + d, b + e) + 1e-2 for d, e in [(rng.normal(0, 0.05, 20), rng.normal(0, 0.05)) for _ in range(50)])


# ---------------------------------------------------------------- 3 secrets


def base_spans(text):
    text, spans = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


SECRETS = ["", None, "🙂 password = 'abcdefgh12'", "password:token:abcdefghij", "TOKEN=short secret=longenough", "AKIAAKIAAKIA1234 AKIA12", "x" + "ab" * 20 + "é" + "0f" * 16, "api_key: aaaaaaaa api-key: bbbbbbbb apikey=cccccccc", "-----BEGIN RSA PRIVATE KEY-----"]


def test_secret_spans(spark):
    got = {r["doc_id"]: r for r in secret_scan.secret_report(frame(spark, SECRETS + SECRETS[2:4])).collect()}
    for i, text in enumerate(SECRETS + SECRETS[2:4]):
        base = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    assert got[8]["spans"] == "private_key:0:31"
    assert secret_scan.secret_report(frame(spark, []).limit(0)).count() == 0


def test_secrets_of_texts_full_of_matches(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("token=abcdefgh1", "secret: short", "AKIA" + "B" * 13, "f" * 33, "é🙂 plain")) for _ in range(n)) for n in (1, 127, 128, 129, 300, 40_000)]
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secret_scan.secret_report(frame(spark, texts)).collect()}
    assert time.perf_counter() - began < 60
    assert [got[i]["spans"] for i in range(len(texts))] == [",".join(base_spans(t)) for t in texts]


def test_secrets_keep_clashing_columns(spark):
    rows = [(1, "secret=abcdefgh1", 5, 6, 7, 8), (None, "secret=abcdefgh1", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "path int, text string, spans int, blob int, key int, rest int")
    got = secret_scan.scan_versions(spark, docs)
    assert got.columns == ["path", "text", "spans_own", "blob_own", "key", "rest", "blob", "spans"]
    assert {(r["path"], r["spans_own"], r["blob_own"], r["key"], r["rest"], len(r["spans"])) for r in got.collect()} == {(1, 5, 6, 7, 8, 1), (None, 5, 6, 7, 8, 1)}


def test_ledger_scans_only_the_unseen(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    versions = lambda rows: spark.createDataFrame(rows, "path string, text string, blob_name string")
    first = versions([("a", "secret=abcdefgh1", "v1"), ("b", "secret=abcdefgh1", "v1"), (None, "plain", "v1")])
    secret_scan.scan_versions(spark, first, ledger=ledger).count()
    assert spark.read.parquet(ledger).count() == 2
    second = secret_scan.scan_versions(spark, first.unionByName(versions([("a", "token: xxxxxxxxx", "v2"), ("c", "secret=abcdefgh1", "v2")])), ledger=ledger)
    assert {(r["path"], r["blob_name"], len(r["spans"])) for r in second.collect()} == {("a", "v1", 1), ("b", "v1", 1), (None, "v1", 0), ("a", "v2", 1), ("c", "v2", 1)}
    assert spark.read.parquet(ledger).count() == 3
    secret_scan.scan_versions(spark, first, ledger=ledger, rule_version="next").count()
    assert spark.read.parquet(ledger).count() == 5


# ---------------------------------------------------------------- 4 decontamination


def brute_tiles(doc, item, least):
    free_doc, free_item, total = [1] * len(doc), [1] * len(item), 0
    while True:
        best, found = 0, []
        for i, j in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while i + k < len(doc) and j + k < len(item) and free_doc[i + k] and free_item[j + k] and doc[i + k] == item[j + k]:
                k += 1
            if k >= max(best, 1):
                found, best = ([*found, (i, j)] if k == best else [(i, j)]), k
        if best < least:
            return total
        for i, j in found:
            if all(free_doc[i : i + best]) and all(free_item[j : j + best]):
                free_doc[i : i + best] = free_item[j : j + best] = [0] * best
                total += best


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(1, 10**6, 30).astype(np.uint64)
        parts = [item[a : a + rng.integers(1, 12)] for a in rng.permutation(25)[:4]]
        doc = np.concatenate([x for p in parts for x in (rng.integers(1, 10**6, rng.integers(0, 6)).astype(np.uint64), p)])
        assert decontaminate.covered(doc, item, 3)[1] == brute_tiles(list(doc), list(item), 3)


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(20))
    halves = " ".join(f"b{i}" for i in range(10, 20)) + " filler words here " + " ".join(f"B{i}" for i in range(10))
    docs = frame(spark, [f"start {item.upper()} end", halves, " ".join(f"b{i}" for i in range(6)), "clean text", *ODD, None])
    bench = spark.createDataFrame([(7, item, 0), (8, "too short", 0), (9, None, 0)], "item_id long, text string, doc_id int")
    for most in (1 << 20, 0):
        got = decontaminate.contaminated(docs, bench, benchmark_bytes=most).collect()
        assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got} == {(0, 7, 20), (1, 7, 20)}
    assert decontaminate.without_contaminated(docs, bench).count() == docs.count() - 2
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_ways_agree(spark):
    """Null and repeated ids, repeated rows, repeated words and frequent seeds: both ways give the rows of brute force."""
    rng = random.Random(6)
    words = lambda n, of=12: [f"w{rng.randrange(of)}" for _ in range(n)]
    items = [(7, words(20)), (None, words(30)), (7, words(12)), (8, ["x"] * 40), (9, words(4)), (8, ["x"] * 40), (10, [*"abcdefghij", *"abcdefghij"])]
    docs = [(None, items[0][1]), (1, items[0][1] + words(5) + items[1][1]), (1, items[1][1][15:] + items[1][1][:15]), (2, ["x"] * 25), (2, ["x"] * 25), (3, ["x"] * 300), (4, words(200)), (5, list("abcdefghij")), (6, [])]
    frames = spark.createDataFrame([(i, " ".join(t), 1) for i, t in docs], "doc_id int, text string, item_id int"), spark.createDataFrame([(i, " ".join(t), 1) for i, t in items], "item_id int, text string, rest int")
    want = collections.Counter()
    for i, d in docs:
        for j, t in items:
            size = brute_tiles(d, t, 5) if len(t) >= 5 else 0
            if len(t) >= 5 and size >= 0.5 * len(t):
                want[(i, j, size, len(t))] += 1
    for most in (1 << 20, 0):
        got = collections.Counter((r["doc_id"], r["item_id"], r["covered_words"], r["item_words"]) for r in decontaminate.contaminated(*frames, benchmark_bytes=most).collect())
        assert got == want
        left = decontaminate.without_contaminated(*frames, benchmark_bytes=most)
        assert left.columns == ["doc_id", "text", "item_id"] and sorted(r["doc_id"] for r in left.collect()) == sorted({i for i, _ in docs if i is not None} - {i for i, *_ in want})
    names = spark.createDataFrame([("a", "one two three four five six")], "doc_id string, text string")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(names, names.withColumnRenamed("doc_id", "item_id"), benchmark_bytes=0).collect()] == [("a", "a")]


# ---------------------------------------------------------------- 5 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "\\", "a\\<|im_start|>", "", None, "<<SYS>>x<</SYS>>\n", "é🙂 " * 40, "w " * 900, "[\\INST]"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "r\\o\nle"]), rng.choice(nasty), 5) for c in [*range(12), None] for t in range(rng.randint(1, 12))]
    rows += [(99, None, "user", "late", 5), (99, 1, "system", "S", 5), (99, 1, "system", "S", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    order = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    got = {r["conv_id"]: r for r in chat_format.chat_report(turns).collect()}
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in said if r[2] == "assistant")
        x = got[conv]
        assert x["n_turns"] == len(said) and x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in said).encode()).hexdigest()
    assert chat_format.chat_report(turns.limit(0)).count() == 0


def test_chat_windows_hold_the_budget(spark):
    rows = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"turn {t} " + "word " * (t % 17)) for t in range(120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.chat_windows(turns, budget=150, history=30, block=16).orderBy("window").collect()
    assert len(windows) > 5 and all(w["n_tokens"] <= 150 for w in windows)
    assert all(w["formatted"].startswith("<|im_start|>system\nturn 0 ") for w in windows)
    assert any(w["n_context"] > 1 for w in windows)
    for w in windows:
        for s in w["loss"]:
            assert w["formatted"][: s["start"]].endswith("<|im_start|>assistant\n") and w["formatted"][s["end"] :].startswith("<|im_end|>")
    assert sum(len(w["loss"]) for w in windows) == sum(r[2] == "assistant" for r in rows)


# ---------------------------------------------------------------- 6 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b\n", "<p>é</p>", 1), (1, "u", "<p>é</p>", 1), (2, None, None, 1), (4, "u", "", 1), (None, "u", "x", 1), (5, "u", "y" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {r["page_id"]: r for r in warc.warc_report(pages).collect()}
    assert len(got) == 6 and got[3]["refers_to"] == 1 and got[1]["record_type"] == "response" and got[4]["refers_to"] == 2
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), warc.digest_of(body))
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    read = spark.read.format("warc").load(path)
    assert {bytes(r["payload"]) for r in read.filter("record_type = 'response'").select("payload").collect()} == {"<p>é</p>".encode(), b"", b"x", b"y" * 300_000}
    assert read.filter("record_type = 'revisit'").count() == 2 and read.filter("record_type in ('revisit', 'none')").count() == 2
    assert warc.warc_report(pages.limit(0)).count() == 0


def test_warc_reads_other_archives(spark, tmp_path):
    made = [warc.page_record(i, f"http://a/{i}", b"z" * i, warc.digest_of(b"z" * i), None, "d") for i in range(0, 200_000, 40_000)]
    Path(tmp_path, "a.warc").write_bytes(b"".join(made))
    Path(tmp_path, "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    Path(tmp_path, "c.warc.gz").write_bytes(b"".join(warc.member(x, 1) for x in made))
    warc.register(spark)
    read = spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}")
    assert [r["n"] for r in read.groupBy("target_uri").agg(F.count("*").alias("n")).collect()] == [3] * 5
    lengths = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}")
    assert lengths.agg(F.sum("payload_length")).first()[0] == 3 * 400_000 and lengths.filter("payload is not null").count() == 0
    assert read.filter("target_uri = 'http://a/40000'").select("payload_length").distinct().collect()[0][0] == 40_000


def test_warc_members_of_many_records(spark, tmp_path):
    """Gzip members that hold several records, or a part of one, and header bytes beyond UTF-8."""
    made = [warc.page_record(i, f"http://a/{i}", b"z" * i, warc.digest_of(b"z" * i), None, "d") for i in (0, 1, 70_000, 200_000, 5)]
    made[1] = made[1].replace(b"X-Page-Id", b"X-Odd: caf\xe9\r\nX-Page-Id")
    raw = b"".join(made)
    Path(tmp_path, "a.warc.gz").write_bytes(gzip.compress(raw))
    Path(tmp_path, "b.warc.gz").write_bytes(gzip.compress(made[0] + made[1]) + gzip.compress(made[2] + made[3] + made[4]))
    Path(tmp_path, "c.warc.gz").write_bytes(warc.member(made[0], 1) + warc.member(made[1], 1) + gzip.compress(b"".join(made[2:])))
    Path(tmp_path, "d.warc.gz").write_bytes(b"".join(gzip.compress(raw[i : i + 999]) for i in range(0, len(raw), 999)))
    Path(tmp_path, "e.warc").write_bytes(raw)
    warc.register(spark)
    for payload in ("true", "false"):
        rows = spark.read.format("warc").option("verify", payload).option("payload", payload).load(f"file://{tmp_path}").collect()
        assert sorted(r["payload_length"] for r in rows) == sorted([0, 1, 5, 70_000, 200_000] * 5)
        assert sum(r["headers"].get("x-odd", "").startswith("caf") for r in rows) == 5
    wanted = spark.read.format("warc").load(f"file://{tmp_path}").filter("target_uri = 'http://a/70000'").collect()
    assert len(wanted) == 5 and {len(r["payload"]) for r in wanted} == {70_000}


# ---------------------------------------------------------------- 7 lines


def test_line_dedup(spark):
    log = [f"user u{i}9 logged in from host h{i}3 at gate" for i in range(4)]
    varied = [f"entry was posted by {n} in the general forum" for n in ("ann", "bob", "cleo", "dan")]
    texts = [f"own line number {w} of this text\n{log[i]}\n{varied[i]}\nshort one\nown line number {w} of this text" for i, w in enumerate(("alpha beta gamma", "delta rho", "pi", "kappa lambda mu nu"))]
    docs = frame(spark, [*texts, *ODD, None])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_dropped"] == 0
    for i in (1, 2, 3):
        lines = texts[i].split("\n")
        assert got[i]["text"].split("\n") == [lines[0], lines[3], lines[4]] and (got[i]["n_lines"], got[i]["n_dropped"]) == (5, 2)
    for i, text in enumerate(ODD):
        assert got[4 + i]["text"] == text
    assert got[4 + len(ODD)]["text"] is None and got[0]["__id"] == "y"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def bands_of(line):
    """(leaf, bands, masked tokens) of a line of five tokens or more."""
    t = ["<*>" if any(c.isdigit() for c in x) else x for x in line.split()]
    if len(t) < 5:
        return None
    cut = [3 + k * (len(t) - 3) // 6 for k in range(7)]
    return (len(t), *t[:3]), [t[a:b] for a, b in itertools.pairwise(cut)], t.count("<*>")


def brute_lines(docs, least=3):
    """Lines of (id, text) rows that agree with lines of enough rows on all bands, or on a half of them or more that fixes seven tokens."""
    lines = [(k, i, n, b) for k, (i, text) in enumerate(docs) for n, x in enumerate(text.split("\n")) if (b := bands_of(x))]
    gone = set()
    for k, i, n, (leaf, bands, masked) in lines:
        for kept in [range(6), *itertools.combinations(range(6), 3), *itertools.combinations(range(6), 4)]:
            if len(kept) < 6 and 3 + sum(len(bands[x]) for x in kept) - masked < 7:
                continue
            fits = {(j, of) for j, of, _, (other, theirs, hidden) in lines if other == leaf and all(theirs[x] == bands[x] for x in kept) and (len(kept) == 6 or hidden == masked or 3 + sum(len(theirs[x]) for x in kept) - hidden >= 7)}
            if len(fits) >= least and i > min(of for _, of in fits):
                gone.add((k, n))
    return sorted((i, "\n".join(x for n, x in enumerate(text.split("\n")) if (k, n) not in gone)) for k, (i, text) in enumerate(docs))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh12", k=rng.randint(4, 9))) for _ in range(40)]
    for _ in range(6):  # templates with variable fields
        words = rng.choices("abcdefgh1", k=rng.randint(8, 14))
        for _ in range(7):
            varied = words.copy()
            for _ in range(rng.randint(0, 4)):
                varied[rng.randrange(3, len(words))] = rng.choice("uvwxyz9")
            lines.append(" ".join(varied))
    docs = [(rng.randrange(30) if k < 40 else k, "\n".join(rng.choices(lines, k=6))) for k in range(80)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute_lines(docs)


def test_line_dedup_recall_and_prose(spark):
    """Log lines of up to four variable fields anywhere, against all pairs of lines that agree on six tenths of their tokens and on seven; prose stays."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows, docs = [], []
    for t in range(120):
        words = [word() for _ in range(rng.randint(9, 30))]
        fields = rng.sample(range(3, len(words)), 1 + t % 4)
        for _ in range(6):
            rows.append([word() if k in fields else w for k, w in enumerate(words)])
    few = {tuple(x) for x in rows if len(x) >= 14} - {tuple(x) for k, x in enumerate(rows) if k // 6 % 4 == 3}
    rng.shuffle(rows)
    docs = [(k, " ".join(x)) for k, x in enumerate(rows)]
    alike = lambda a, b: len(a) == len(b) and a[:3] == b[:3] and sum(x == y for x, y in zip(a, b, strict=True)) >= max(7, 0.6 * len(a))
    want = {k for k, x in enumerate(rows) if len(near := [j for j, y in enumerate(rows) if alike(x, y)]) >= 3 and k > min(near)}
    places = ("berlin", "rome", "oslo", "paris", "lima", "quito")
    six = [f"session opened for {n} by the scheduler on host node {p}" for n, p in zip(("ann", "bob", "cleo", "dan", "eve", "fay"), places, strict=True)]
    prose = [f"The old man walked {x}" for x in ("home", "away", "slowly")] + [f"It was a {x} day for the {y}" for x, y in (("cold", "birds"), ("warm", "men"), ("grey", "wind"))]
    docs += [(1000 + k, x) for k, x in enumerate(six)] + [(2000 + k, x) for k, x in enumerate(prose)]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("n_dropped > 0").collect()}
    assert len(got & want) >= 0.9 * len(want) and not {k for k in got if k < 1000} - want
    assert {k for k in want if tuple(rows[k]) in few} <= got  # up to three fields: all of them
    assert {k for k in got if k >= 1000} == set(range(1001, 1006))


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, "one two three four five six", 7, "r", 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, row string, gone int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines_own", "row", "gone", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, rows[0][1], 7, "r", 5, 1, 0)] + [(i, "", 7, "r", 5, 1, 1) for i in (1, 2, 3)]
    assert line_dedup.dedup_lines(docs, distinct_texts=True, long_tokens=50).filter("n_dropped > 0").count() == 0


# ---------------------------------------------------------------- 8 Jaccard join


def brute_components(rows):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    of = {i: i for i, _ in rows}

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            of[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_corpus(seed):
    rng = random.Random(seed)
    texts = corpus(seed, 60)
    hot = " ".join(rng.choices(texts[0].split(), k=12))
    for base in corpus(seed + 1, 6):
        for _ in range(12):
            w = (base + " " + hot).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return [*texts, *texts[:5], *ODD, None, ""]


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 3, "block_rows": 6, "cluster_bytes": 800}])
def test_jaccard_components(spark, limits):
    texts = near_corpus(11)
    rows = list(enumerate(texts)) + [(3, texts[3]), (4, texts[70])]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)


def test_jaccard_edges(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", None])
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    got = sorted(ngram_join.jaccard_components(nameless).collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(0, 0), (2, 2), (None, None)]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs.unionByName(docs)).collect()) == [0, 2, 2]


def test_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = np.unique(rng.integers(0, 3000, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(1, len(a) + 1)], rng.integers(0, 3000, rng.integers(1, 100)).astype(np.uint64)])
        x, y = ngram_join.count_vector(a), ngram_join.count_vector(b)
        groups = min(len(x), len(y))
        assert np.minimum(ngram_join.folded(x, groups), ngram_join.folded(y, groups)).sum() >= len(np.intersect1d(a, b))


def test_r_tree_join_loses_no_pair():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 6, (300, 16)).astype(np.uint16)
    points[100:200] = points[:100]
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngram_join.RTree(points, sizes)
    got = {(int(i), int(j)) for i, js in tree.join(tree, 75) for j in js}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    ok = (bound >= ngram_join.needed(sizes[:, None], sizes[None], 75)) & (100 * np.minimum(sizes[:, None], sizes) >= 75 * np.maximum(sizes[:, None], sizes))
    assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(ok)), strict=True))


# ---------------------------------------------------------------- 9 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/x">Menu</a></nav>
<div id="cookie-notice">We use cookies</div><div class="side-bar sidebar"><p>Links that are long enough to be taken for text, were it not for the name.</p></div>
<div class="wrap"><h1>Title &eacute;&amp;</h1><div class="post"><p><b>Bold.<br><p>First <a href=x>link</a> a &lt; b.<p>Second&nbsp;para<br>more</p><ul><li>one<li>two</ul></div>
<section id=comments><p>Nice! A long comment of a reader, which isn't the article's text at all.</p></section></div><form>Search</form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Title é& Bold. First link a < b. Second para more one two"
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "plain &amp; text", 1), (None, "u", "<p>" * 3 + "deep", 1), (6, "u", "<div>" * 5000 + "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain & text", 12), None: ("deep", 4), 6: ("x", 1)}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>one <svg class=x/> two</p><p>three <svg><svg><text>gone</text></svg><path/>gone</svg> four</p>", "one two three four"),
        ("<p>one <svg><path d='x'>gone<p>two</p><p>three</p>", "one two three"),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><math/><p>end</p>", "where x=2 holds end"),
        ("<p>one</p><noscript><p>two</p>", "one two"),
        ("<p>one</p><template><template>gone</template>gone</template><p>two</p><noscript>gone</noscript>", "one two"),
        ("<p>one</p><script>gone<p>gone</p>", "one"),
    ],
)
def test_html_foreign_and_raw_elements(body, want):
    assert html_extract.main_text(f"<html><body><article>{body}</article></body></html>") == want


PROSE = "This is a sentence of the article which is long enough to be dense."


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'data-id="ad"', 'data-x="a" title="class=ad"', 'class="no-sidebar"', 'class="share-price"', 'class="has-sidebar with-banner"', "data-role=navigation"])
def test_html_attributes_are_names_and_values(attributes):
    page = f"<body><div class='sidebar'>gone</div><article><h1>Head</h1><p>{PROSE}</p><div {attributes}><p>{PROSE}</p></div></article></body>"
    assert html_extract.main_text(page) == f"Head {PROSE} {PROSE}"
    assert html_extract.main_text(f"<body><p>{PROSE} <a href='/hidden-valley'>one</a> <a href=\"/x?id=promo\">two</a></p></body>") == f"{PROSE} one two"


def test_html_names_on_the_article():
    article = f"<article><h1>Head</h1><p>{PROSE}</p><section id='related-work'><h2>Work</h2><p>{PROSE}</p></section></article>"
    want = f"Head {PROSE} Work {PROSE}"
    comments = f"<section class='comments'><article class='comment'><p>{PROSE}</p></article><article><p>{PROSE}</p></article></section>"
    links = "<div class='nav-menu-main'><ul>" + "<li><a href='/x'>link</a></li>" * 9 + "</ul></div>"
    for name in ("page has-sidebar", "sidebar", "modal widget"):
        assert html_extract.main_text(f"<body><div class='{name}'>{links}{article}</div><div class=promo>gone</div></body>") == want
    assert html_extract.main_text(f"<body>{article}{comments}</body>") == want
    assert html_extract.main_text(f"<body>{article[:-10]}{comments}{links}</article></body>") == want
    assert html_extract.main_text(f"<body><div class='widget'><p>{PROSE}</p></div></body>") == PROSE


LONG_PROSE = " ".join(f"Sentence number {k} of the article says something that is new." for k in range(12))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='content no-sidebar'><p>{LONG_PROSE}</p></div><div class=sidebar>gone</div></body>", LONG_PROSE),
        (f"<body><div class='layout has-footer'><article><p>{LONG_PROSE}</p></article></div></body>", LONG_PROSE),
        (f"<body><article><p>{PROSE}</p><p class='notice-of-motion'>Moved.</p><p>{PROSE}</p></article></body>", f"{PROSE} Moved. {PROSE}"),
        (f"<body><article><p>{PROSE}</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article></body>", f"{PROSE} So x=1 holds."),
        (f"<body><div id=top><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div id=middle><h2>Head</h2><p>{LONG_PROSE}</p><p>{PROSE}</p></div><div id=bottom><a href=/c>About</a> <a href=/d>Contact</a></div></body>", f"Head {LONG_PROSE} {PROSE}"),
        (f"<table><tr><td><a href=/a>One</a><td><p>{LONG_PROSE}<p>{PROSE}</table>", f"{LONG_PROSE} {PROSE}"),
        (f"<div><p>{LONG_PROSE}</p><p>5 < 6 & 7 > 2 <3</p></div>", f"{LONG_PROSE} 5 < 6 & 7 > 2 <3"),
        (f"<p title=\"a > b\" data-x='>'>{PROSE}</p>", PROSE),
        (f"<!-- a > b --><!doctype html><?pi?><p>{PROSE}<!----> end</p><!-- never closed {PROSE}", f"{PROSE} end"),
    ],
)
def test_html_pages_of_other_kinds(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "<a '" * 250_000, '<a b="' * 160_000, "<div>" * 150_000 + "</p>" * 100_000, "<div>" * 100_000 + "</span>" * 60_000 + "x", "<span>" * 60_000 + "<div></div>" * 40_000, "<ul><li><span>" + "<b>" * 80_000 + "<li></li>" * 40_000, "<script>" + "</scrip" * 120_000, "<template>" * 90_000, "<noscript>" * 90_000, "<!--" * 200_000, "<svg><foreignObject>" + "<g>" * 80_000 + "<p></p>" * 60_000, "<div><header>" * 50_000, "<div class='x-ad'><h1>a" * 30_000, "<article>" * 60_000 + "y", "<" * 900_000, "<a" + " " * 900_000, "<a" + "/ =" * 300_000],
)
def test_html_takes_linear_time(page):
    """Pages of about a megabyte that are all unclosed tags, stray end tags or nesting."""
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 6


def test_html_equals_the_articles(spark):
    import html

    for r in html_extract.extract_pages(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split())


# ---------------------------------------------------------------- 10 SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepieces.Model.parse(Path(sentencepieces.MODEL).read_bytes())


def test_n_best_equals_enumeration(model):
    def every(s):
        if not s:
            yield 0.0, []
            return
        for k in range(1, len(s) + 1):
            i = model.ids.get(s[:k])
            if i is not None:
                yield from ((x + model.scores[i], [i, *rest]) for x, rest in every(s[k:]))

    for word in ("▁thane", "▁a", "xyz", "▁éaux", "aaaa"):
        want = sorted(every(word), key=lambda x: (-x[0], x[1]))[:5]
        got = sentencepieces.n_best(word, model, 5)
        assert [x[1] for x in got] == [x[1] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want])
        score, ids, loss = sentencepieces.viterbi(word, model)
        assert ids == want[0][1] and score == pytest.approx(want[0][0]) and (len(want) < 2 or loss == pytest.approx(want[0][0] - want[1][0]))


def tiny_model(pieces):
    """A model of these pieces, name to score."""
    ids = {p: i + 1 for i, p in enumerate(pieces)}
    begins = {x[:k]: -1 for x in ids for k in range(1, len(x))} | ids
    return sentencepieces.Model(["?", *pieces], ids, [-99.0, *pieces.values()], {}, 0, False, -99.0, begins, frozenset("".join(ids)) | {"▁"}, [b"?", *[p.encode() for p in pieces]])


def every_segmentation(s, model):
    if not s:
        return [(0.0, [])]
    return [(x + model.scores[i], [i, *rest]) for k in range(1, len(s) + 1) if (i := model.ids.get(s[:k])) for x, rest in every_segmentation(s[k:], model)]


@pytest.mark.parametrize("scores", [(-1, -1, -1, -1), (-1, -2, -3, -1), (-2, -3, -4, -1)])
def test_n_best_of_many_ties_equals_enumeration(scores):
    model = tiny_model(dict(zip(("a", "aa", "aaa", "b"), map(float, scores), strict=True)))
    for size in (1, 2, 9, 17):
        want = sorted(every_segmentation("a" * size, model), key=lambda x: (-x[0], x[1]))
        for n in (1, 2, 3, 7):
            assert sentencepieces.n_best("a" * size, model, n) == want[:n]
    rng = random.Random(8)
    for _ in range(60):
        pieces = {p: float(-rng.randint(1, 3)) for p in {*"ab", *("".join(rng.choices("ab", k=rng.randint(2, 4))) for _ in range(6))}}
        model, word = tiny_model(pieces), "".join(rng.choices("ab", k=rng.randint(1, 11)))
        want = sorted(every_segmentation(word, model), key=lambda x: (-x[0], x[1]))
        assert sentencepieces.n_best(word, model, 6) == want[:6]
        score, ids, loss = sentencepieces.viterbi(word, model)
        assert score == want[0][0] and ids == want[0][1] and loss == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)


def test_n_best_of_a_long_run_of_ties():
    """25 letters have 200,000 segmentations of which very many are equal; 20,000 letters are a matter of seconds."""
    model = tiny_model({"a": -1.0, "aa": -1.0, "b": -1.0})
    assert [x[1] for x in sentencepieces.n_best("a" * 25, model, 4)] == [[1, *[2] * 12], [2, 1, *[2] * 11], [2, 2, 1, *[2] * 10], [2, 2, 2, 1, *[2] * 9]]
    assert sentencepieces.n_best("a" * 20_001, model, 2)[1] == (-10_001.0, [2, 1, *[2] * 9_999])


def test_text_n_best_with_ties_between_words():
    """Texts of equal words: what is second best is decided by the ids of the whole text."""
    rng = random.Random(9)
    for _ in range(60):
        pieces = {"▁": -1.0} | {p: float(-rng.randint(1, 2)) for p in sorted({*"ab", *("".join(rng.choices("ab", k=rng.randint(2, 3))) for _ in range(4))} | {"▁" + "".join(rng.choices("ab", k=2))})}
        model = tiny_model(pieces)
        words = ["".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(2)]
        text = " ".join(rng.choices(words, k=3))
        encoder = sentencepieces.Encoder(model, n=4)
        want = sorted(every_segmentation(text.replace(" ", "▁"), model), key=lambda x: (-x[0], x[1]))[:4]
        assert encoder.n_best(text) == want, (pieces, text)


def test_encoder_with_a_small_cache(model):
    """A cache that is changed all the time gives the same segmentations."""
    small, large = sentencepieces.Encoder(model, most=8), sentencepieces.Encoder(model)
    for text in (" ".join(f"word{k % 7} thane{k}" for k in range(60)), "a b c a b c d e f g a"):
        assert small.n_best(text) == large.n_best(text) and len(small.cache) <= 4


def test_n_best_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(sentencepieces.MODEL).read_bytes())
    proto.trainer_spec.model_type = 1  # read its scores as a unigram model's
    raw = proto.SerializeToString()
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepieces.Encoder(sentencepieces.Model.parse(raw))
    score = lambda ids: sum(mine.model.scores[i] for i in ids)
    for word in ("the", "thanedble", "éaux", "Inth", "onston", "über", "of the and"):
        want = [score(x) for x in library.nbest_encode(word, nbest_size=3)]
        assert [score(x) for _, x in mine.n_best(word)] == pytest.approx(want, rel=1e-4)


def test_text_n_best_combines_words(model):
    encoder = sentencepieces.Encoder(model, n=4)
    text = "thane of ouble"
    whole = sentencepieces.n_best("▁" + text.replace(" ", "▁"), model, 4)
    assert [s for s, _ in encoder.n_best(text)] == pytest.approx([s for s, _ in whole])
    assert encoder.n_best(text)[0][1] == whole[0][1]


def test_text_of_one_best(model):
    three, one = sentencepieces.Encoder(model), sentencepieces.Encoder(model, n=1)
    for text in ("", "thane of ouble", "the the the ☃"):
        assert one.n_best(text) == three.n_best(text)[:1]


@pytest.mark.parametrize("scores", [(-1.0, -1.0, -1.0), (-1.0, -1.5, -2.0), (-2.0, -1.0, -3.0)])
def test_words_side_by_side_equal_one_by_one(model, scores):
    small = tiny_model(dict(zip(["a", "b", "ab"], scores, strict=True)))
    rng = np.random.default_rng(5)
    some = {"".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(200)} | {"c", "acb", "a" * 64}
    real = {"▁", "▁the", "the", "▁unbelievable", "▁été", "▁xqzjv9", "a" * 64, "▁日本", "straße"}
    for used, words in ((small, some), (model, real)):
        got = {w: rest for w, *rest in sentencepieces.viterbi_many(list(words), used)}
        for w in words:
            score, ids, loss = sentencepieces.viterbi(w, used)
            left_out = loss == 0 or any(c not in used.ids for c in w)
            assert (w in got) != left_out
            assert left_out or got[w] == [score, np.array(ids, np.int32).tobytes(), loss]
    assert sentencepieces.viterbi_many(["c"], small) == []
    together, alone = sentencepieces.Encoder(model), sentencepieces.Encoder(model)
    texts = [" ".join("".join(rng.choice(list("etaoinß☃"), rng.integers(1, 9))) for _ in range(k)) for k in (0, 1, 300, 50)]
    together.prepare([together.words(t) for t in texts])
    assert len(together.cache) > 200 and [together.n_best(t) for t in texts] == [alone.n_best(t) for t in texts]


def test_texts_together_make_each_word_once(model, monkeypatch):
    """Words of a batch are made once, however few of them are kept for the next."""
    made = []
    alone, together = sentencepieces.viterbi, sentencepieces.viterbi_many
    monkeypatch.setattr(sentencepieces, "viterbi", lambda word, model: made.append(word) or alone(word, model))
    monkeypatch.setattr(sentencepieces, "viterbi_many", lambda words, model: made.extend(words) or together(words, model))
    texts = [" ".join(f"thane{k} of{k % 9}" for k in range(100)), "", None, "of3 thane5 of4", " ".join(f"thane{k}" for k in range(99, -1, -1))]
    rows = pa.record_batch({"rest": pa.array(range(5)), "text": pa.array(texts)})
    monkeypatch.setattr(sentencepieces, "_ENCODERS", {})
    shared = types.SimpleNamespace(id=0, value=Path(sentencepieces.MODEL).read_bytes())
    (got,) = sentencepieces._encode(shared, 3, 8)(iter([rows]))
    assert sorted(made) == sorted({"▁" + w for text in texts for w in (text or "").split()})
    monkeypatch.undo()
    for text, row in zip(texts, got.to_pylist(), strict=True):
        changes = [[(x["at"], x["n"], x["ids"]) for x in y] for y in row["n_best_changes"]]
        assert row["round_trip"] and [(s, sentencepieces.applied(row["ids"], x)) for s, x in zip(row["n_best_scores"], changes, strict=True)] == sentencepieces.Encoder(model).n_best(text or "")


def test_words_are_cut_as_by_a_pattern(model):
    rng = random.Random(12)
    texts = ["", " ", "\n", "\n\n a", "a\n▁ b", "  a ", *["".join(rng.choices(" ▁ab☃é\n", k=rng.randint(0, 40))) for _ in range(200)]]
    pattern = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")  # a line's end is in no piece
    want = [pattern.findall("▁" + text.replace(" ", "▁")) if text else [] for text in texts]
    parts, ends = sentencepieces.Encoder(model).cut(texts)
    got = [w.decode("utf-32-le") for w in parts.to_pylist()]
    assert [got[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_sentencepiece_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.unionByName(frame(spark, [*ODD, None, "\n\n  two\tspaces ", "mark ▁ inside", "x" * 5000], 10**6).select("doc_id", "text"))
    got = {r["doc_id"]: r for r in sentencepieces.encoding_report(docs).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[10**6]["n_pieces"] == 0 and len(got) == docs.count()
    assert all(r["n_best_scores"] == sorted(r["n_best_scores"], reverse=True) for r in got.values())
    encoder = sentencepieces.Encoder(sentencepieces.Model.parse(Path(sentencepieces.MODEL).read_bytes()))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, r in got.items():
        assert [(s, sentencepieces.applied(r["ids"], x)) for s, x in zip(r["n_best_scores"], r["n_best_changes"], strict=True)] == encoder.n_best(texts[i])
    pieces = {r["doc_id"]: len(r["ids"]) for r in sentencepieces.encode_texts(docs.withColumn("ids", F.lit(1))).collect()}
    assert pieces == {k: r["n_pieces"] for k, r in got.items()}
