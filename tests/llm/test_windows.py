"""Budgeted windows of conversations, turn by turn."""

import random

import regex
from pyspark.sql import functions as F

from factloom.llm import chat_format


def planned(turns, budget, history):
    """(texts of the context, texts of the span, assistant texts under the loss) of each window of one conversation."""
    size = lambda t: len(regex.findall(r"\p{L}{1,5}|\p{N}{1,3}|[^ \t\n\x0b\f\r\p{L}\p{N}]", t[1])) + chat_format.OVERHEAD
    system = turns[:1] if turns and turns[0][0] == "system" else []
    rest = turns[len(system) :]
    half = max(budget - history - sum(map(size, system)), 2) // 2
    room = min(history, half)
    spans, done, short = [], 0, 0  # tokens before a turn: of all, and of those that fit half a span
    last = None
    for t in rest:
        long = size(t) > half
        here = ("alone", len(spans)) if long else ("with others", short // half)
        if here != last or long:
            spans.append((done, []))
        spans[-1][1].append((t, done))
        last = here
        done += size(t)
        short += 0 if long else size(t)
    out = []
    if system and (not spans or size(rest[0]) > half):  # else the system turn stands in the first span
        out.append(([], [s[1] for s in system], []))
    for begin, span in spans:
        again = [t for _, own in spans for t, at in own if at < begin and begin - at <= room]
        texts, first = [t[1] for t, _ in span], [s[1] for s in system]
        loss = [t[1] for t, _ in span if t[0] == "assistant"]
        out.append((first + [t[1] for t in again], texts, loss) if out or not system else ([], first + texts, loss))
    return out


def test_windows_turn_by_turn(spark):
    rng = random.Random(11)
    rows, by = [], {}
    for c in range(40):
        turns = [("system", "be kind " * rng.randint(0, 9))] if rng.random() < 0.4 else []
        turns += [(("user", "assistant")[k % 2], f"{c}-{k} " + "word " * rng.choice([0, 1, 3, 8, 20, 60])) for k in range(rng.randint(1, 14))]
        by[c] = turns
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    budget, history = 60, 16
    windows = chat_format.chat_windows(df, budget, history, block=4)
    told = windows.select("conv_id", "window", "n_context", "formatted", F.transform("loss", lambda s: F.substr("formatted", s["start"] + 1, s["end"] - s["start"])).alias("loss")).collect()
    got = {}
    for r in sorted(told, key=lambda r: (r["conv_id"], r["window"])):
        texts = [x.split("\n", 1)[1] for x in r["formatted"].split("<|im_end|>\n")[:-1]]
        got.setdefault(r["conv_id"], []).append((texts[: r["n_context"]], texts[r["n_context"] :], r["loss"]))
    for c, turns in by.items():
        assert got[c] == planned(turns, budget, history), (c, turns)
