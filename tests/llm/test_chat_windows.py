"""Chat windows against a plain version of the same rules, and round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textmill.llm import chat_windows as C
from textmill.llm.queries import op11_chat_windows

SCHEMA = "conv_id long, turn long, role string, text string, part int, start long, form string"
MARK = re.compile(r"([<\[])(?=\\*/?(?:s>|(?:SYS|INST|ROLE)\]))")
TOKEN = re.compile(r"[^\W]+|[^\w\s]")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows_of(turns):
    return [(c, t, r, x, 1, 2, "f") for c, t, r, x in turns]


def formatted(role, text):
    text = MARK.sub(r"\1\\", text)
    if role == "system":
        return f"<s>[SYS]{text}[/SYS]</s>", 8, len(text)
    if role == "user":
        return f"<s>[INST]{text}[/INST]</s>", 9, len(text)
    if role == "assistant":
        return f"<s>{text}</s>", 3, len(text)
    named = MARK.sub(r"\1\\", role)
    return f"<s>[ROLE]{named}[/ROLE]{text}</s>", 16 + len(named), len(text)


def brute(turns, budget, history):
    """Windows of one conversation: (segment, window, text, repeated, loss, tokens)."""
    turns = [(r or "", x or "") for _, r, x in sorted(turns, key=lambda t: -1 if t[0] is None else t[0])]
    size = [len(TOKEN.findall(x)) + 4 for _, x in turns]
    start = [sum(size[:i]) for i in range(len(size))]
    system = formatted(*turns[0])[0] if turns[0][0] == "system" else ""
    fixed, lead = (size[0], 1) if system else (0, 0)
    out, i, window = [], 0, defaultdict(int)
    while i < len(turns):
        segment = start[i] // (C.SEGMENT * budget)
        first = not i and lead
        past = [] if first else [j for j in range(lead, i) if start[j] >= start[i] - history]
        used = (0 if first else fixed) + sum(size[j] for j in past)
        j = i
        while j < len(turns) and (j == i or used + start[j] + size[j] - start[i] <= budget) and start[j] // (C.SEGMENT * budget) == segment:
            j += 1
        text = ("" if first else system) + "".join(formatted(*turns[k])[0] for k in past)
        repeated, loss = len(text), []
        for k in range(i, j):
            form, before, n = formatted(*turns[k])
            if turns[k][0] == "assistant":
                loss.append((len(text) + before, len(text) + before + n))
            text += form
        out.append((segment, window[segment], text, repeated, loss, used + start[j - 1] + size[j - 1] - start[i]))
        window[segment] += 1
        i = j
    return out


@pytest.fixture(scope="module")
def turns():
    r = random.Random(2)
    some = lambda n: " ".join(r.choice(["ab", "cd,", "é", "[INST]", "</s>", "<\\s>", "[\\/ROLE]", "<", "[", "\\", "\n", "😀"]) for _ in range(r.randint(0, n)))
    out = [(c, t, r.choice(["user", "assistant", "tool", "</s>", None]) if t else r.choice(["system", "user", "assistant"]), some(30)) for c in range(30) for t in range(r.randint(1, 9))]
    out += [(100, t, ["user", "assistant"][t % 2] if t else "system", some(40)) for t in range(900)]  # many segments
    out += [(101, 0, "system", some(200)), (101, 1, "user", some(400)), (101, 2, "assistant", some(400)), (101, 3, "system", "late"), (101, 4, "assistant", None)]
    out += [(102, None, "user", "first"), (102, 0, "assistant", ""), (None, 0, "user", "no id"), (None, 1, "assistant", "yes")]
    out += [(103, 0, "assistant", "same"), (103, 0, "assistant", "same"), (104, 0, "user", "x " * 200_000)]
    return out


@pytest.mark.parametrize("budget,history", [(64, 16), (40, 0), (200, 199)])
def test_windows_by_definition(spark, turns, budget, history):
    df = spark.createDataFrame(rows_of(turns), SCHEMA).repartition(5)
    got = defaultdict(list)
    for w in C.chat_windows(df, budget, history).collect():
        got[w.conv_id].append((w.segment, w.window, w.text, w.repeated, [tuple(s) for s in w.loss], w.n_tokens))
    by = defaultdict(list)
    for c, *t in turns:
        by[c].append(t)
    assert set(got) == set(by)
    for c, t in by.items():
        assert sorted(got[c]) == brute(t, budget, history), c
        assert all(n <= budget or sum(len(C_turns) for C_turns in [re.findall("</s>", text[repeated:])]) == 1 for _, _, text, repeated, _, n in got[c])


def test_digests_are_read_back(spark, turns):
    df = spark.createDataFrame(rows_of(turns), SCHEMA)
    got = {r.conv_id: r for r in C.chat_digests(C.chat_windows(df, 64, 16)).collect()}
    by = defaultdict(list)
    for c, *t in turns:
        by[c].append(t)
    for c, t in by.items():
        t = sorted(t, key=lambda x: -1 if x[0] is None else x[0])
        learnt = "".join(x or "" for _, r, x in t if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(t), sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in t)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))


def test_escape_is_reversible(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "a"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e")).select("t", "e", C.unescaped(F.col("e")).alias("u")).collect()
    assert all(x.t == x.u and not re.search(r"</?s>|\[/?(SYS|INST|ROLE)\]", x.e) for x in rows)
    assert len({x.e for x in rows}) == len(set(texts))


def test_other_tokens_empty_tables_and_bad_budgets(spark, turns):
    df = spark.createDataFrame(rows_of(turns), SCHEMA)
    assert C.chat_windows(df, 64, 16, tokens=lambda t: F.lit(-5)).agg(F.max("n_tokens")).first()[0] <= 64
    none = spark.createDataFrame([], SCHEMA)
    assert C.chat_digests(C.chat_windows(none)).collect() == []
    with pytest.raises(ValueError):
        C.chat_windows(df, 10, 10)


def test_query_over_all_conversations(spark, sf):
    got = {r.conv_id: r for r in op11_chat_windows(spark, sf).collect()}
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    assert set(got) == set(by) | {-7} and got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].loss_chars == 21
    for c, t in by.items():
        t.sort()
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x or ''}\n" for _, r, x in t))
        assert got[c].formatted_chars == sum(len(w[2]) for w in brute(t, C.BUDGET, C.HISTORY))
