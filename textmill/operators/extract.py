"""Facts from sentences by patterns with capture groups, ranked and limited per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as tx


@dataclass(frozen=True)
class Pattern:
    """A kind of fact: a regular expression, names for its groups, how many sentences of a document count, and characters that its first group may have."""

    kind: str
    regex: str
    fields: tuple[str, ...]
    limit: int = 2
    longest: int = 40


#: Patterns of dates, addresses, enumerations and quantities.
PATTERNS = (
    Pattern("date", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", ("year", "month", "day")),
    Pattern("address", r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])", ("name", "host")),
    Pattern("enumeration", r"([A-Za-z]{4,}), ([A-Za-z]{4,}) and ([A-Za-z]{4,})", ("first", "second", "third")),
    Pattern("licence", r"(?:under|with) the ([A-Z][A-Za-z]+(?: [A-Z0-9][A-Za-z0-9.]*)*) [Ll]icense", ("name",), 1),
)


def extracted(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, place, sentence, fields map<string, string>): of each pattern the first match of a sentence, for as many sentences of a document as it allows, in order.

    A sentence is a candidate for every pattern; matches with an empty or too
    long first group don't count. Null and empty texts have none. All patterns
    are tried in one pass over the sentences.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.sentences(F.col(text_col))).alias("place", "sentence"))
    tried = F.array(*(F.struct(F.lit(p.kind).alias("kind"), F.lit(p.limit).alias("limit"), F.lit(p.longest).alias("longest"), F.map_from_arrays(F.array(*map(F.lit, p.fields)), F.array(*(F.regexp_extract("sentence", p.regex, i + 1) for i in range(len(p.fields))))).alias("fields"), F.regexp_extract("sentence", p.regex, 1).alias("first")) for p in patterns))
    hits = F.filter(tried, lambda x: (x["first"] != "") & (F.length(x["first"]) <= x.longest))
    rows = s.select("doc_id", "place", "sentence", F.inline(hits)).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("place")))
    return rows.filter(F.col("r") <= F.col("limit")).select("doc_id", "kind", "place", "sentence", "fields")


# Fixed values, as in SQL: where sentences end (U+0001 parts them too), what is a keyword, and what is trimmed.
ENDS, KEYWORD, BLANK = re.compile("(?<=[。！？!?；;.\n])|\x01"), re.compile(r"[a-z][a-z0-9_\-]{4,}"), " \t\n\f\r"
DIGIT = re.compile("[0-9]")


def _outermost(words: list[str]) -> int:
    """How many of different words stand in no other of them: those that occur once in all of them."""
    line = "\n".join(words)
    return sum(line.find(w, line.find(w) + 1) < 0 for w in words)


def _dense(text: str, most: int, least: int, longest: int) -> list[tuple[int, int, str]]:
    """(-score in thousandths, place, sentence) of the densest sentences of a text, see ``densest``."""
    best: list[tuple[int, int, str]] = []
    place = -1
    for raw in ENDS.split(text):
        s = raw.strip(BLANK)
        if not s:
            continue
        place += 1
        n = len(s)
        if not least <= n <= longest:
            continue
        keys = list(dict.fromkeys(KEYWORD.findall(s.lower())))
        if not keys:
            continue
        plain = (300 if DIGIT.search(s) else 0) + (-5 * (n - 110) if n > 110 else 500 if n >= 26 else 0)
        # no sentence that later words can't lift above the last one kept needs its words compared
        bar = -best[-1][0] if len(best) == most else 0
        if 150 * min(len(keys), 20) + plain <= bar:
            continue
        score = 150 * min(_outermost(keys), 20) + plain
        if score > bar:
            best = sorted([*best, (-score, place, s)])[:most]
    return best


def densest(docs: DataFrame, most: int, least: int, longest: int) -> DataFrame:
    """(doc_id, i, s, score): of each row the ``most`` sentences that ask most to become a question, by ``tx.information`` of the distinct keywords that no other contains, the earlier first on ties.

    Sentences of ``least`` to ``longest`` characters are candidates; those
    without a keyword or a score don't count. A text is read once, where it is
    (Arrow batches), so only what may be chosen goes on.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for at, text in enumerate(b.column(1)):
                got = _dense(text.as_py() or "", most, least, longest)
                rows += [at] * len(got)
                found += got
            score, i, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(i, pa.int32()), pa.array(s, pa.string()), pa.array([-x / 1000 for x in score], pa.float64())], names=["doc_id", "i", "s", "score"])

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, s string, score double")
