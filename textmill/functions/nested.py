"""Nested JSON: masking by key and schema checks at any depth, over VARIANT.

A value is taken apart level by level: each level explodes the objects and
arrays of the one before with ``variant_explode``, so records of any size are
rows of their values. Masking puts the values together again from the deepest
level up; a schema check carries along which part of the schema a value belongs
to. The number of levels is that of the deepest record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.storage import checkpointed

# Parts of names whose values are masked, the mask, and the characters that a text keeps.
SENSITIVE = ("token", "secret", "password", "passwd", "api_key", "apikey", "authorization")
MASK, PREVIEW = "***", 200
LEVELS = 64


def json_text(s: Column) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.array(s))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def _kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number."""
    k = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(k == "OBJECT", "object").when(k == "ARRAY", "array").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k == "VOID", "null").when(k == "BIGINT", "integer").otherwise("number")


def _children(level: DataFrame) -> DataFrame:
    """(parent's columns as ``p``, pos, key, v) of the members of objects and arrays."""
    return level.select(F.struct(*level.columns).alias("p")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("p.v").outer())).withColumnRenamed("value", "v")


def _sensitive(key: Column) -> Column:
    hits = [F.contains(F.lower(key), F.lit(x)) for x in SENSITIVE]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def redacted(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(``id_col``, redacted): the JSON of each row with masked values under sensitive keys and long texts cut, at any depth; members in the order of their names. What is no JSON gives NULL. Ids are unique."""
    v = F.try_parse_json(F.col(json_col))
    level = checkpointed(rows.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), v.alias("v")).filter("v is not null").withColumn("kind", _kind(F.col("v"))))
    levels = [level]
    while len(levels) <= LEVELS:
        open_ = levels[-1].filter(F.col("kind").isin("object", "array") & ~_sensitive(F.col("key")))
        below = _children(open_.select("id", "path", "v")).filter("pos is not null").select("p.id", F.concat("p.path", F.array("pos")).alias("path"), "key", "v")
        below = checkpointed(below.withColumn("kind", _kind(F.col("v"))))
        if below.isEmpty():
            break
        levels.append(below)
    s = F.expr("variant_get(v, '$', 'string')")
    cut = F.concat(F.left(s, F.lit(PREVIEW)), F.lit("…[+"), (F.length(s) - PREVIEW).cast("string"), F.lit("]"))
    leaf = F.when(F.col("kind") == "string", json_text(F.when(F.length(s) > PREVIEW, cut).otherwise(s))).otherwise(F.to_json("v"))
    made = None
    for level in reversed(levels):
        own = level.select("id", "path", "key", "kind", F.when(_sensitive(F.col("key")), json_text(F.lit(MASK))).when(~F.col("kind").isin("object", "array"), leaf).alias("text"))
        if made is not None:
            member = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(json_text(F.col("key")), F.lit(":"), F.col("text")))
            joined = made.select("id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("pos"), member.alias("m"))
            joined = joined.groupBy("id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x.m), ",").alias("inside"))
            own = own.join(joined, ["id", "path"], "left")
        else:
            own = own.withColumn("inside", F.lit(None).cast("string"))
        inside = F.coalesce("inside", F.lit(""))
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        made = own.select("id", "path", "key", F.coalesce("text", whole).alias("text"))
    return rows.select(id_col).join(made.select(F.col("id").alias(id_col), F.col("text").alias("redacted")), id_col, "left")


@dataclass
class _Rules:
    """A schema as numbered rules with the numbers of their parts."""

    rules: list[dict] = field(default_factory=list)
    parts: list[tuple[int, str, int]] = field(default_factory=list)  # rule, member or "*" for items, rule of the part

    def add(self, schema: dict) -> int:
        n = len(self.rules)
        self.rules.append(schema)
        for name, part in (schema.get("properties") or {}).items():
            self.parts.append((n, f".{name}", self.add(part)))
        if "items" in schema:
            self.parts.append((n, "*", self.add(schema["items"])))
        return n


def _wrong_type(kind: Column, rule: dict) -> Column:
    want = rule.get("type")
    if want not in ("object", "array", "string", "integer", "number", "boolean", "null"):
        return F.lit(False)
    return ~kind.isin(*(("integer", "number") if want == "number" else (want,)))


def _own_problems(rule: dict) -> Column:
    """Texts of what is wrong with a value of the right type."""
    text, number = F.expr("try_variant_get(v, '$', 'string')"), F.expr("try_variant_get(v, '$', 'double')")
    is_text, is_number = F.col("kind") == "string", F.col("kind").isin("integer", "number")
    out = []
    if "enum" in rule:
        words, numbers = [x for x in rule["enum"] if isinstance(x, str)], [float(x) for x in rule["enum"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
        out.append(F.when(~((is_text & text.isin(*words)) | (is_number & number.isin(*numbers))), "enum"))
    for name, bad in (("minLength", lambda n: is_text & (F.length(text) < n)), ("maxLength", lambda n: is_text & (F.length(text) > n)), ("minimum", lambda n: is_number & (number < n)), ("maximum", lambda n: is_number & (number > n))):
        if name in rule:
            out.append(F.when(bad(rule[name]), name))
    for name in rule.get("required") or []:
        out.append(F.when((F.col("kind") == "object") & ~F.array_contains("members", name), f"no {name}"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def schema_problems(rows: DataFrame, id_col: str, json_col: str, schema: dict) -> DataFrame:
    """(``id_col``, problems array<string>): what is wrong with each row's JSON, as "path: rule", in the order of the texts; empty for none.

    Types, enums, lengths, ranges, required members, members that aren't allowed,
    and items of arrays are checked at any depth; nothing below a wrong type is.
    What is no JSON has the one problem "$: json". Ids are unique.
    """
    rules = _Rules()
    rules.add(schema)
    spark = rows.sparkSession
    parts = spark.createDataFrame(rules.parts or [(-1, "", -1)], "rule int, part string, next int")  # the size of the schema
    v = F.try_parse_json(F.col(json_col))
    level = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("at"), F.lit(0).alias("rule"), v.alias("v"))
    found = level.filter("v is null").select("id", F.lit("$: json").alias("problem"))
    level = checkpointed(level.filter("v is not null").withColumn("kind", _kind(F.col("v"))))
    wrong, own, closed = F.lit(False), F.array().cast("array<string>"), F.lit(False)
    for n, rule in enumerate(rules.rules):
        wrong = F.when(F.col("rule") == n, _wrong_type(F.col("kind"), rule)).otherwise(wrong)
        own = F.when(F.col("rule") == n, _own_problems(rule)).otherwise(own)
        if rule.get("additionalProperties") is False:
            closed = closed | (F.col("p.rule") == n)
    for _ in range(LEVELS):
        keys = F.when(F.col("kind") == "object", F.json_object_keys(F.to_json("v"))).otherwise(F.array().cast("array<string>"))
        level = level.withColumn("members", keys).withColumn("wrong", wrong)
        texts = F.when(F.col("wrong"), F.array(F.lit("type"))).otherwise(own)
        found = found.unionByName(level.select("id", "at", F.explode(texts).alias("t")).select("id", F.concat("at", F.lit(": "), "t").alias("problem")))
        below = _children(level.filter(~F.col("wrong") & F.col("kind").isin("object", "array")).select("id", "at", "rule", "v")).filter("pos is not null")
        below = below.withColumn("part", F.when(F.col("key").isNull(), "*").otherwise(F.concat(F.lit("."), "key"))).withColumn("rule", F.col("p.rule"))
        below = below.join(F.broadcast(parts), ["rule", "part"], "left")
        here = F.concat("p.at", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("part")))
        below = checkpointed(below.select("p", "key", "next", here.alias("at"), "v"))
        found = found.unionByName(below.filter(closed & F.col("key").isNotNull() & F.col("next").isNull()).select("p.id", F.concat("at", F.lit(": not allowed")).alias("problem")))
        level = below.filter("next is not null").select("p.id", "at", F.col("next").alias("rule"), "v").withColumn("kind", _kind(F.col("v")))
        if level.isEmpty():
            break
    problems = found.groupBy("id").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    return rows.select(F.col(id_col)).join(problems.withColumnRenamed("id", id_col), id_col, "left").select(id_col, F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))
