"""Conversation repair, source audit and toxicity against brute force and held-out rows, with nulls, ties, empties and odd columns."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_repair, source_audit, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ROLES = {"u": "user", "a": "assistant"}

# ---------------------------------------------------------------- 11 conversation repair


def cheapest(rows):
    """(cost, audit, turns) by search over all edit scripts in the order of cost and audit; rows: (role, text, must go, truncated)."""
    todo, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(todo)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in seen:
            continue
        seen.add((i, last))
        turn = "a" if last == "u" else "u"
        heapq.heappush(todo, (cost + 3, audit + "I", i, turn, (*out, (ROLES[turn], ""))))
        if i < len(rows):
            role, text, must, truncated = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, last, out))
            if not must:
                here = cost + 3 * truncated
                heapq.heappush(todo, (here + 3, audit + "R", i + 1, turn, (*out, (ROLES[turn], text))))
                if role[:1] == turn or role[:1] == "s" and last == "":
                    heapq.heappush(todo, (here, audit + "K", i + 1, role[:1], (*out, (role, text))))


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else " " if text is None else text
        text = re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else " " if role is None else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def repaired(rows):
    """The row of op11 of one conversation's rows."""
    turns = damaged(rows)
    known = [t for t, _, _ in turns if t is not None]
    seen, counts, marked = set(), collections.Counter(), []
    for _, role, text in turns:
        chars = WORD.findall(text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit, out = cheapest(marked)
    return (max(known) - min(known) + 1 - len({*known}) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_repair_by_brute_force(spark):
    """Odd roles, nulls, equal turns, repeated rows, a conversation of several blocks and one of which nothing is left."""
    rng = random.Random(4)
    texts = ["Hi.", "ok", "Yes!", "", "  \n", "What?  \n", "a. b", None, "é ü 🙂.", ".", "x\x85", "no break  "]
    rows = [(c, rng.choice([t, t, t, rng.randrange(9), None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += [(None, t, ("user", "assistant")[t % 2], f"x{t}.") for t in range(7)]
    rows += [(1000, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", "ok", f"y{t}.", f"z{t}"])) for t in range(700)]
    gone = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hello."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({"c": F.lit(1), "block": F.lit(2), "n": F.lit("x")})
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.repair_report(df).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got == {c: repaired(own) for c, own in by.items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert chat_repair.repair_report(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Well"), (1, 2, "user", "Well"), (1, 3, "tool", "Done.")]
    audits, turns = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert [(r["cost"], r["audit"]) for r in audits.collect()] == [(13, "KIKKDR")]
    assert [tuple(r)[2:] for r in turns.orderBy("position").collect()] == [(0, 0, "system", "Be kind.", "K"), (1, None, "user", "", "I"), (2, 1, "assistant", "Hello.", "K"), (3, 2, "user", "Well", "K"), (4, 3, "assistant", "Done.", "R")]
    audits, turns = chat_repair.repair(spark.createDataFrame([("x", 5, "user", "Hi.")], "conv_id string, turn long, role string, text string"))
    assert audits.first()["audit"] == "KI" and [r["role"] for r in turns.orderBy("position").collect()] == ["user", "assistant"]


def test_repair_stays_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    plan = chat_repair.repair_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- 12 source audit


def audited(rows, min_docs):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    n, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text)]
        n[lang, source].update(terms)
        docs[lang].update({*terms})
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        chance = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        p = {s: {t: chance(n[lang, s][t], sum(n[lang, s][k] for k in kept)) for t in kept} for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: chance(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((-f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:10]
            out += [(lang, s, part, o, -v, i) for part, own in (("pair", pair), ("term", term)) for i, (v, o) in enumerate(own, 1)]
    return sorted(out)


def test_sources_by_brute_force(spark):
    rng = random.Random(7)
    words = ["Alpha", "alpha", "beta", "Été", "été", "naïve", "x", "don't", "a1b", "ß", "🙂", " ", "ÀB", "tab\tstop", "Z", "q_r", "[w]", "日本"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", "en", None]), rng.choice(["s1", "s2", "Ü", "z", None, ""])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("rare word", "yy", None)] + [("again and again", "en", "s1")] * 12
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "docs": F.lit(3)}).repartition(6)
    got = sorted(tuple(r) for r in source_audit.divergences(df).collect())
    assert got == audited(rows, 10)
    assert [r[4:] for r in got if r[0] == "xx"] == [(0, 1), (0, 1)] and not [r for r in got if r[0] == "yy"]
    assert source_audit.divergences(df.limit(0)).count() == 0


def test_large_counts(spark):
    """Exact beyond what longs and doubles hold on the way."""
    huge = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(huge, huge, 3)], "n long, total long, v long")
    assert df.select(source_audit.probability(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (huge + 2) // (huge + 6)


def test_counts_are_given_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "HELD", 5)
    texts = ["a b c d e f", "a b", None, "g h i j k l", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["s"] * 5), pa.array(texts)], names=["lang", "source", "text"])
    parts = [b.to_pylist() for b in source_audit._counted(iter([batch]))]
    total = collections.Counter()
    for r in [r for p in parts for r in p]:
        total[r["term"]] += r["n"]
    assert len(parts) > 1 and total["a"] == 3 and total["l"] == 1 and total[None] == 0


# ---------------------------------------------------------------- 13 toxicity


def invented(seed, n, bad=("vile", "rotten", "grimbling", "grimblest")):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "lo", "mi", "re", "su", "no") for b in ("ber", "lin", "dor", "vak", "pel", "stum", "gra", "fex")]
    out = []
    for i in range(n):
        text = rng.choices([*words, "the", "and", "of"], k=rng.randint(5, 80))
        label = int(rng.random() < 0.25)
        for _ in range(rng.randint(1, 3) if label else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(text).capitalize(), label))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = invented(1, 900)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, score string, label double").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["score"], got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert all((s >= 0.5) == bool(p) for s, p, _ in held)
    assert sum(p == y for _, p, y in held) >= 0.97 * len(held)
    assert min(s for s, _, y in held if y) > 0.2


def test_toxicity_cases(spark):
    """Nulls, empties, repeated rows, contradicting labels, no labels, no rows."""
    rows = invented(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "vile"), (9000, None), (9001, ""), (9002, " \n"), (9003, "vile, rotten thing"), (9003, "vile, rotten thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000, None), (None, 1), (9003, 0), (9003, 1), (7, 5)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    own = [r["score"] for r in got if r["doc_id"] == 9003]
    assert own[0] == own[1] >= 0.5
    assert len({r["score"] for r in got if r["doc_id"] in (9000, 9001, 9002)}) == 1
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is False
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("cut", [40, 300])
def test_side_by_side_equals_alone(monkeypatch, cut):
    """Texts side by side, and one in slices, give what each gives alone."""
    rows = invented(3, 200)
    texts = [t.encode() for _, t, _ in rows]
    model = toxicity.train_network([toxicity.padded(next(toxicity.word_rows(np.frombuffer(t, np.uint8)))[0]) for t in texts], np.array([y for _, _, y in rows]), 0.0, epochs=2)
    texts += [b"", "Été vile".encode(), b"", b" . "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [model.margin(np.frombuffer(t, np.uint8)) for t in texts]
    both = model.margins(data, offsets)
    assert np.allclose([m for m, _ in alone], both[0], atol=1e-4) and [k for _, k in alone] == both[1].tolist()
    monkeypatch.setattr(toxicity, "SEGMENT", cut)
    monkeypatch.setattr(toxicity, "SLICE", 10 * cut)
    whole = b" ".join(texts)
    assert np.isclose(model.margin(np.frombuffer(whole, np.uint8))[0], model.unit(model.responses(toxicity.padded(np.concatenate([r for r, _ in toxicity.word_rows(np.frombuffer(whole, np.uint8))])))), atol=1e-4)
    assert np.allclose(model.scores(data, offsets), 1 / (1 + np.exp(-both[0])), atol=1e-4)


def test_signal_and_threshold():
    seen = np.array([[0, 5, 50, 90], [0, 10, 5, 1]])
    signal = toxicity.label_signal(seen, np.array([90, 10]))
    assert signal[0] == 0 and signal[1] > 5 and abs(signal[2]) < 0.6 and signal[3] < -3
    assert 1 < toxicity.best_threshold(np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) < 4
    assert toxicity.best_threshold(np.array([2.0, 2.0, 1.0]), np.array([1, 1, 0])) < 2
