"""Nested JSON, lineage, patterns, normal forms and table functions on literals."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import nested, tables
from textmill.functions.unicode import nfkc
from textmill.operators import extract, lineage, split


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def masked(value):
    if isinstance(value, dict):
        return {k: nested.MASK if any(x in k.lower() for x in nested.SENSITIVE) else masked(v) for k, v in value.items()}
    if isinstance(value, list):
        return [masked(v) for v in value]
    if isinstance(value, str) and len(value) > nested.PREVIEW:
        return f"{value[: nested.PREVIEW]}…[+{len(value) - nested.PREVIEW}]"
    return value


def some_value(r, depth):
    kind = r.randrange(7 if depth else 4)
    if kind == 4 or kind == 5:
        return {r.choice(["a", "b", "API_Key", "my token", 'q"uote', "é"]): some_value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if kind == 6:
        return [some_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return [r.randint(-9, 9), r.choice(["", "x", 'a"\\\n', "é" * 250, "z" * 201]), None, r.random() < 0.5][kind]


def test_masking_at_any_depth(spark):
    r = random.Random(4)
    values = [some_value(r, 6) for _ in range(120)] + [{"a": [[[[{"Password": {"deep": [1]}}]]]]}, [], {}, "top", 7]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "no json"), (901, None)], "i long, j string")
    got = {x.i: x.redacted for x in nested.redacted(df, "i", "j").collect()}
    assert got.pop(900) is None and got.pop(901) is None
    assert {i: json.loads(x) for i, x in got.items()} == {i: masked(v) for i, v in enumerate(values)}


SCHEMA = {
    "type": "object",
    "required": ["a", "z"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "integer", "minimum": 2, "maximum": 5}}, "s": {"type": "string", "minLength": 2, "maxLength": 3}}},
        "e": {"enum": ["x", 3]},
        "n": {"type": "null"},
        "f": {"type": "number"},
        "m": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}},
    },
}


@pytest.mark.parametrize("value, want", [
    ({"a": {"b": [2, 5]}, "z": 1}, ["$.z: not allowed"]),
    ({"a": {"b": [1, 6, "x", 2.5]}}, ["$.a.b[0]: minimum", "$.a.b[1]: maximum", "$.a.b[2]: type", "$.a.b[3]: type", "$: no z"]),
    ({"a": [], "z": 0}, ["$.a: type", "$.z: not allowed"]),
    ({"a": {"s": "x"}, "e": "y", "n": 0, "f": True}, ["$.a.s: minLength", "$.e: enum", "$.f: type", "$.n: type", "$: no z"]),
    ({"a": {"s": "long", "other": 1}, "e": 3, "n": None, "f": 1}, ["$.a.s: maxLength", "$: no z"]),
    ({"a": {}, "m": [[True], [1, [False]], 3]}, ["$.m[1][0]: type", "$.m[1][1]: type", "$.m[2]: type", "$: no z"]),
    ([1], ["$: type"]),
])
def test_problems_at_any_depth(spark, value, want):
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "{"), (3, None)], "i long, j string")
    got = {x.i: x.problems for x in nested.schema_problems(df, "i", "j", SCHEMA).collect()}
    assert got == {1: sorted(want), 2: ["$: json"], 3: ["$: json"]}


def test_lineage_of_any_depth_and_cycles(spark):
    edges = [(i, i - 1) for i in range(1, 150)] + [(0, None), (200, 201), (201, 202), (202, 200), (203, 202), (300, 300), (400, 10), (400, 20)]
    df = spark.createDataFrame(edges, "node long, parent long")
    got = rows(lineage.ancestors(df, spark.createDataFrame([(149,), (203,), (300,), (400,), (0,)], "node long")))
    of = lambda s: sorted(x[1:] for x in got if x[0] == s)
    assert of(149) == [(i, 149 - i, False) for i in range(150)] and of(0) == [(0, 0, False)]
    assert of(203) == sorted([(203, 0, False), (202, 1, False), (200, 2, False), (201, 3, False), (202, 4, True)]) and of(300) == [(300, 0, False), (300, 1, True)]
    assert len(of(400)) == 1 + 11 + 21
    top = {x.node: (x.root, x.depth) for x in lineage.roots(df.filter("node < 400")).collect()}
    assert all(top[i] == (0, i) for i in range(150)) and {top[i] for i in (200, 201, 202, 203, 300)} == {(None, None)}
    assert lineage.roots(df.limit(0)).collect() == [] and lineage.ancestors(df.limit(0), df.select("node").limit(1)).count() == 1


def test_roots_against_plain_walks(spark):
    r = random.Random(8)
    parent = {i: r.choice([None, r.randrange(i)] if i else [None]) for i in range(300)}
    df = spark.createDataFrame(list(parent.items()), "node long, parent long")

    def walk(n):
        d = 0
        while parent[n] is not None:
            n, d = parent[n], d + 1
        return n, d

    assert {x.node: (x.root, x.depth) for x in lineage.roots(df).collect()} == {n: walk(n) for n in parent}


def test_compatibility_forms(spark):
    texts = ["ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ﬂow", "①②", "plain ascii", "é", "ｋ㎏", "", None]
    want = ["full width", "fine flow", "12", "plain ascii", "é", "kkg", "", None]
    assert [x.n for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(nfkc(F.col("t")).alias("n")).collect()] == want


def test_patterns_are_ranked_and_limited(spark):
    text = "Seen on 2024-01-05!\nAgain on 2023-02-06; and 2022-03-07!\nMail a.b@c.example.org now.\nRed, then: green, blue and grey\nalpha, beta and gamma rule\nunder the Apache License 2.0"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(x.kind, x.place): x.fields for x in extract.extracted(df).collect()}
    assert got[("date", 0)] == {"year": "2024", "month": "01", "day": "05"} and got[("date", 1)]["year"] == "2023" and ("date", 2) not in got
    assert [v for k, v in got.items() if k[0] == "address"] == [{"name": "a.b", "host": "c.example.org"}]
    assert {k[0] for k in got} == {"date", "address", "enumeration", "licence"}
    own = extract.extracted(df, (extract.Pattern("word", "(alpha)", ("w",), 1, 3),))
    assert own.count() == 0  # longer than the pattern allows


def test_table_functions_equal_the_operators(spark, sf):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.createOrReplaceTempView("docs_for_sections")
    got = spark.sql("select d.doc_id, s.section, s.level, s.heading, s.text from docs_for_sections d, lateral sections(d.text, 900) s")
    assert rows(got) == rows(split.bounded_sections(docs, 900).select("doc_id", "section", "level", "heading", "text"))
    assert spark.sql("select * from sections(cast(null as string), 10)").count() == 0
