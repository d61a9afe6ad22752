"""Queries of nested records, lineage, patterns, normal forms and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import nested, tables
from textmill.functions import text as tx
from textmill.functions.unicode import nfkc
from textmill.operators import extract, lineage
from textmill.plans.registry import Tables, query

SENT_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def records(t: Tables) -> DataFrame:
    """(conv_id, record): a conversation as one nested JSON record with keys in it."""
    turn = F.struct("turn", "role", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("session_Token"), "text")
    g = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x.role.alias("role"), x["session_Token"].alias("session_Token"), x.text.alias("text"))).alias("turns"))
    auth = F.struct(F.struct(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("api_key"), F.lit("basic").alias("kind")).alias("by"))
    return g.select("conv_id", F.to_json(F.struct(auth.alias("auth"), F.col("conv_id").alias("conv"), "turns")).alias("record"))


@query("""select conv_id, md5('{"auth":{"by":{"api_key":"***","kind":"basic"}},"conv":' || conv_id || ',"turns":[' || string_agg('{"role":' || to_json(role)::varchar || ',"session_Token":"***","text":' || to_json(case when length(text) > 200 then left(text, 200) || '…[+' || (length(text) - 200) || ']' else text end)::varchar || '}', ',' order by turn) || ']}') as digest from conversations group by conv_id""")
def nested_redaction(t: Tables) -> DataFrame:
    """Records with masked values and cut texts at any depth."""
    return nested.redacted(records(t), "conv_id", "record").select("conv_id", F.md5("redacted").alias("digest"))


SCHEMA = {
    "type": "object",
    "required": ["lang", "turns"],
    "properties": {
        "auth": {"type": "object"},
        "conv": {"type": "integer", "minimum": 5},
        "turns": {"type": "array", "items": {"type": "object", "additionalProperties": False, "properties": {"role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 30, "maxLength": 900}}}},
    },
}


@query("""with c as (select conv_id, turn, role, length(text) as n, row_number() over (partition by conv_id order by turn) - 1 as i from conversations),
p as (select conv_id, '$: no lang' as problem from c group by conv_id union all select conv_id, '$.conv: minimum' from c group by conv_id having conv_id < 5 union all select conv_id, '$.turns[' || i || '].session_Token: not allowed' from c
union all select conv_id, '$.turns[' || i || '].role: enum' from c where role not in ('user', 'assistant') union all select conv_id, '$.turns[' || i || '].text: minLength' from c where n < 30 union all select conv_id, '$.turns[' || i || '].text: maxLength' from c where n > 900)
select conv_id, string_agg(problem, '|' order by problem) as problems from p group by conv_id""")
def nested_problems(t: Tables) -> DataFrame:
    """What is wrong with records against a nested schema."""
    return nested.schema_problems(records(t), "conv_id", "record", SCHEMA).select("conv_id", F.array_join("problems", "|").alias("problems"))


def replies(t: Tables) -> DataFrame:
    """(node, parent): every turn and the one that it replies to."""
    number = lambda turn: F.col("conv_id") * 1000 + turn
    return t.conversations.select(number(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, number(F.col("turn") - 1)).alias("parent"))


REPLIES = "rp as (select conv_id * 1000 + turn as node, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent from conversations)"


@query(f"with recursive {REPLIES}, up as (select node as start, node, 0 as depth from rp where parent is null or parent in (select node from rp) union all select up.start, rp.parent, up.depth + 1 from up join rp on rp.node = up.node where rp.parent is not null) select start, node, depth from up")
def reply_lineage(t: Tables) -> DataFrame:
    """Every turn with all turns above it."""
    edges = replies(t)
    return lineage.ancestors(edges, edges).select("start", "node", "depth")


@query(f"with {REPLIES} select node, node - node % 1000 as root, (node % 1000)::bigint as depth from rp")
def reply_roots(t: Tables) -> DataFrame:
    """The first turn above every turn, and how far up it is."""
    return lineage.roots(replies(t))


@query("with s as (select doc_id, unnest(" + SENT_SQL + ") as s, generate_subscripts(" + SENT_SQL + ", 1) - 1 as place from documents), x as (" + " union all ".join(f"select doc_id, place, '{p.kind}' as kind, {p.limit} as most, " + " || '|' || ".join(f"regexp_extract(s, '{p.regex}', {i + 1})" for i in range(len(p.fields))) + f" as found from s where regexp_extract(s, '{p.regex}', 1) <> '' and length(regexp_extract(s, '{p.regex}', 1)) <= {p.longest}" for p in extract.PATTERNS) + ") select doc_id, kind, place::int as place, found from (select *, row_number() over (partition by doc_id, kind order by place) as r from x) where r <= most")
def extracted_facts(t: Tables) -> DataFrame:
    """Dates, addresses, enumerations and licences that documents name, a few of each kind per document."""
    got = extract.extracted(t.documents)
    order = F.create_map(*(x for p in extract.PATTERNS for x in (F.lit(p.kind), F.array(*map(F.lit, p.fields)))))
    return got.select("doc_id", "kind", "place", F.array_join(F.transform(F.try_element_at(order, "kind"), lambda f: F.try_element_at("fields", f)), "|").alias("found"))


@query()
def page_sanitized(t: Tables) -> DataFrame:
    """Visible text of pages in the compatibility form, which SQL doesn't have."""
    p = t.pages.select("page_id", nfkc(tx.stripped_markup(F.col("html"))).alias("s"))
    return p.select("page_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query()
def section_function(t: Tables) -> DataFrame:
    """Sections by the table function, called laterally from SQL."""
    tables.register(t.spark)
    return t.spark.sql("select d.doc_id, s.section, s.level, s.heading, s.text from {docs} d, lateral sections(d.text, 1800) s", docs=t.documents.filter("text is not null"))


@query("""with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as r from events),
g as (select user_id, event_id, value, r, value <= 300 as admitted, case when value <= 300 then round(value, 6) else 0.0 end as used from o where r = 1 union all
select o.user_id, o.event_id, o.value, o.r, g.used + o.value <= 300, case when g.used + o.value <= 300 then round(g.used + o.value, 6) else g.used end from g join o on o.user_id = g.user_id and o.r = g.r + 1)
select user_id as key, event_id as seq, value::double as cost, admitted, used::double as used from g""")
def budget_function(t: Tables) -> DataFrame:
    """The budget guard as a table function over partitions of a table."""
    tables.register(t.spark)
    calls = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").cast("double").alias("cost"))
    return t.spark.sql("select * from budget_guard(table({calls}) partition by (key) order by (seq), 300.0D)", calls=calls)
