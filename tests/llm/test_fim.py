"""Fill-in-middle against its definition, the automaton against a step-by-step run."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from textmill.llm import fim as M
from textmill.llm import queries


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(i, text, draws=M.Draws()):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"{draws.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= draws.rate:
        return i, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < draws.spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return i, n, form, len(p), len(m), sha(out), sha(text)


def texts():
    r = random.Random(8)
    out = [(i, "".join(r.choice("<PSM>\nab é😀") for _ in range(r.randint(0, 50)))) for i in range(250)]
    out += [(300 + i, "".join(r.choice(["line\n", "\n", "é", "x", "\r\n", "<P", "M>"]) for _ in range(r.randint(0, 900)))) for i in range(60)]
    return out + [(1, None), (1, ""), (None, "a\nb\nc"), (None, "a\nb\nc"), (2, "\n"), (3, "\n" * 500), (4, "no feed " * 99), (5, "<P" * 99 + ">\n" + "z\n" * 99), (6, "é\n" * 99 + "<" + "S>" * 40)]


def docs(spark, rows):
    return spark.createDataFrame([(*x, "k", 1, 2, "psm") for x in rows], "doc_id long, text string, key string, at int, n int, form string").repartition(3)


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk,block", [(M.CHUNK, M.BLOCK), (17, 3), (64, 1)])
def test_documents_by_definition(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "BLOCK", block)
    rows = texts()
    monkeypatch.setattr(M.chunks_of, "__defaults__", (chunk,))
    assert table(M.fim_digests(*M.fill_in_middle(docs(spark, rows)))) == sorted((brute(*x) for x in rows), key=str)


def test_other_draws_and_empty_tables(spark):
    rows = texts()[:80]
    draws = M.Draws(rate=50, spm=20, seed=9)
    got = table(M.fim_digests(*M.fill_in_middle(docs(spark, rows), draws=draws)))
    assert got == sorted((brute(i, t, draws) for i, t in rows), key=str) and {x[2] for x in got} == {"plain", "psm", "spm"}
    assert table(M.fim_digests(*M.fill_in_middle(docs(spark, rows).limit(0)))) == []


def test_long_documents_by_the_default_chunks(spark):
    rows = [(i, ("é" * i + "\nline <x> of a long text\n") * 4000) for i in range(4)] + [(9, "x" * 100_000), (9, "x" * 100_000), (10, "<M" * 40_000 + ">" + "\n" * 40_000)]
    assert table(M.fim_digests(*M.fill_in_middle(docs(spark, rows)))) == sorted((brute(*x) for x in rows), key=str)


def test_functions_compose(spark):
    r = np.random.default_rng(5)
    for _ in range(300):
        data = r.choice(np.frombuffer(b"<PSM>\nab", np.uint8), int(r.integers(0, 40)))
        for s in range(M.STATES):
            state, opened = s, 0
            for b in data:
                opened += not state & 1
                state = M._step(state, M.CLASS[b])
            to, count = M.scan(data)
            assert (to[s], count[s]) == (state, opened)
        k = int(r.integers(0, len(data) + 1))
        a, b = (np.array([x]) for x in M.scan(data[:k])), (np.array([x]) for x in M.scan(data[k:]))
        to, opened = M.then(*a, *b)
        assert (to[0].tolist(), opened[0].tolist()) == M.scan(data)


def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(queries.OP12_SQL)
    got = queries.op12_fill_in_middle(spark, sf)
    assert want.columns == got.columns and table(got) == sorted(want.fetchall(), key=str)
