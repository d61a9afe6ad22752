"""Licence recognition by sentence rules.

Texts that mention licensing are cut into sentences, wherever lines break; the
sentences are normalised to their words and mapped to identifiers: whole known
sentences by a table, statements that name a licence by the table of names. The
sequence of identifiers is then matched against ordered rules, the longest
first: each sentence serves one rule, and those of a rule stand at most ``GAP``
sentences apart.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import by_arrow, rows_out

GAP = 6
#: Each known sentence holds one of these, and each statement one, or a short name behind "under" or "subject to".
MARKS = ("licen", "rights reserved", "copyright", "warrant", "redistrib", "unencumbered", "public domain", "spdx", "creative commons", "permission", "advertising materials", "endorse or promote", "special exception", "classpath", "copy of the mpl", "anyone is free to copy", "held liable", "be liable", "public domain", "origin of this software", "plainly marked")
SHORT = re.compile(r"(?<![a-z])(?:[al]?gpl|mpl|bsl|bsd|epl|cc|mit|isc|wtfpl|apache|zlib|expat)(?![a-uw-z])")

# Sentences of public licences, in lower case without punctuation; "*" stands for any words.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-short-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files *",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind *",
    "mit-bare-warranty": "the software is provided as is without warranty of any kind",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement *",
    "bsd-endorse": "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages *",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software *",
    "apache-file": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at *",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gnu-hope": "this * is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu-see": "see the gnu * general public license for more details",
    "gnu-see-plain": "see the gnu general public license for more details",
    "gnu-copy": "you should have received a copy of the gnu * public license along with this *",
    "gnu-exception": "as a special exception *",
    "gnu-classpath": "* classpath exception *",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at *",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license *",
    "boost-notice": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software *",
    "boost-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented *",
    "zlib-marked": "altered source versions must be plainly marked as such *",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software *",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc0": "to the extent possible under law * has waived all copyright and related or neighboring rights to *",
    "public-domain": "* released into the public domain",
    "public-domain-state": "* is in the public domain",
    "all-rights": "* all rights reserved *",
}
# Names of licences in statements, as patterns over normalised words, and the identifiers they mean.
VERSION = r"(?: (?:version|v|ver) ?| v?)(?P<{0}>{1})"
NAMES = [
    ("AGPL-{v}", r"(?:gnu )?affero general public license|gnu agpl|agpl", "3"),
    ("LGPL-{v}", r"(?:gnu )?(?:lesser|library) general public license|gnu lgpl|lgpl", "2 1|2|3"),
    ("GPL-{v}", r"(?:gnu )?general public license|gnu gpl|gpl", "1|2|3"),
    ("MPL-{v}", r"mozilla public license|mpl", "1 0|1 1|2 0|2"),
    ("EPL-{v}", r"eclipse public license|epl", "1 0|2 0|1|2"),
    ("Apache-{v}", r"apache(?: software)?(?: license)?", "1 0|1 1|2 0|2"),
    ("BSL-1.0", r"boost software license", "1 0"),
    ("BSD-3-Clause", r"(?:3|three) clause bsd(?: style)?(?: license)?|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license", ""),
    ("BSD-2-Clause", r"(?:2|two) clause bsd(?: style)?(?: license)?|bsd (?:2|two) clause(?: license)?|(?:simplified|free) bsd license", ""),
    ("BSD", r"bsd(?: style)? license", ""),
    ("MIT", r"(?:mit|expat)(?: style)?(?: license)?", ""),
    ("ISC", r"isc license", ""),
    ("Zlib", r"zlib(?: libpng)? license", ""),
    ("Artistic-{v}", r"artistic license", "1 0|2 0"),
    ("Unlicense", r"unlicense", ""),
    ("WTFPL", r"wtfpl", ""),
    ("CC0-1.0", r"(?:creative commons |cc ?)(?:zero|0)(?: public domain dedication)?", "1 0"),
    ("PostgreSQL", r"postgresql license", ""),
    ("EUPL-{v}", r"european union public license|eupl", "1 0|1 1|1 2"),
]
CC_WORDS = {"attribution": "BY", "by": "BY", "noncommercial": "NC", "nc": "NC", "sharealike": "SA", "sa": "SA", "noderivatives": "ND", "noderivs": "ND", "nd": "ND"}
CC = re.compile(r"(?:creative commons|cc)(?P<parts>(?: (?:attribution|by|noncommercial|non commercial|nc|sharealike|share alike|sa|noderivatives|noderivs|no derivatives|nd))+)(?: (?:version |v ?)?(?P<v>[1-4])(?: (?P<m>[0-9]))?)?")
SAID = r"\b(?:released|licensed|distributed|available|provided|published|covered|redistribute|modify|governed|used|use|subject|relicensed)\b(?: \S+){0,6}? (?:under|by|to)(?: (?:an?|the|terms?|conditions?|of|either|version|and|or|gnu|full|permissive|open|source))* "
LATER = r"(?P<later>(?: of the license)?(?: only| or (?:at your option )?(?:any )?(?:later|newer)(?: version)?)?| ?\+)"
STATEMENTS = [(ident, re.compile(rf"(?:{name})(?: license)?(?: as published by the free software foundation)?(?: either)?(?:{VERSION.format('v', versions or '1')}(?![0-9]))?(?: 0(?![0-9]))?(?: license)?{LATER}(?![a-z])")) for ident, name, versions in NAMES]
OPEN = re.compile(SAID)

# Ordered rules; longer ones before their parts. A name in angle brackets is what a statement said.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSL-1.0", ("boost-grant", "boost-notice", "mit-warranty", "mit-liability")),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-marked")),
    ("Zlib", ("zlib-grant",)),
    ("<Apache>", ("Apache", "apache-file", "apache-copy", "apache-basis", "apache-see")),
    ("<Apache>", ("Apache", "apache-file")),
    ("<GNU> WITH exception", ("GNU", "gnu-hope", "gnu-see", "gnu-copy", "gnu-exception")),
    ("<GNU> WITH exception", ("GNU", "gnu-exception")),
    ("<GNU>", ("GNU", "gnu-hope", "gnu-see", "gnu-copy")),
    ("<GNU>", ("GNU", "gnu-hope", "gnu-see")),
    ("<MPL>", ("MPL", "mpl-copy")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0",)),
    ("<Apache>", ("Apache",)),
    ("<GNU>", ("GNU",)),
    ("<MPL>", ("MPL",)),
    ("<other>", ("other",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("all-rights",)),
]
ALIAS = {"public-domain-state": "public-domain", "mit-short-grant": "mit-grant", "mit-bare-warranty": "mit-warranty", "boost-warranty": "mit-warranty", "gnu-see-plain": "gnu-see", "gnu-classpath": "gnu-exception"}
EXACT = {s: ALIAS.get(i, i) for i, s in SENTENCES.items() if "*" not in s}
#: The exact ones by their last words: a heading or a copyright line may stand before a sentence without a stop.
TAILS: dict[str, list[str]] = {}
for _s in EXACT:
    TAILS.setdefault(" ".join(_s.split()[-4:]), []).append(_s)
#: The others as patterns: any words, or none, where the star stands.
OPEN_ENDED = [(ALIAS.get(i, i), re.compile(re.escape(s).replace(r"\ \*\ ", " (?:.* )?").replace(r"\*\ ", "(?:.* )?").replace(r"\ \*", "(?: .*)?"))) for i, s in SENTENCES.items() if "*" in s]
#: Sentences end at a stop and white space, at a colon or semicolon before a capital, a digit or a bullet, and at lines without words.
END = re.compile(r"(?<=[.!?])(?<![ (]v\.)(?<!\bVer\.)[\"')\]]*\s+|(?<=[:;])\s+(?=[^\w\n]*[A-Z0-9])|\n[^\w\n]*(?:\n[^\w\n]*)+")
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)")
#: A label at the start of a line, as in headers and package files, and its value.
LABEL = re.compile(r"^[^\w\n]*licen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?([^\n\"',;]{2,60})", re.IGNORECASE | re.MULTILINE)
#: What may stand behind a licence's name in a heading: the date of its text.
DATED = re.compile(r"(?: [0-9]{1,2})?(?: (?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4})?")
#: A statement behind one of these says the opposite.
DENIED = re.compile(r"\b(?:not|never|cannot|nor|n t|isn t|aren t|wasn t)(?: \S+){0,2} $")
SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def marked(low: str) -> bool:
    """A lower-cased text could hold a licence sentence."""
    return any(x in low for x in MARKS) or ("under" in low or "subject to" in low) and SHORT.search(low) is not None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences that have words."""
    at = 0
    for a, b in [*((m.start(), m.end()) for m in END.finditer(text)), (len(text), len(text))]:
        if WORD.search(text, at, a):
            yield at, a
        at = b


def normalised(sentence: str) -> str:
    """Lower-case words alone, dots as blanks, one spelling of license; the number of a list item goes."""
    s = " ".join(WORD.findall(sentence)).lower().replace(".", " ").replace("licence", "license").replace("noncommercial", "nc").replace("non commercial", "nc").replace("share alike", "sa").replace("no derivatives", "nd")
    return re.sub(r"^(?:[0-9]|[a-e]|i{1,3}) (?=[a-z])", "", s)


def statements(s: str) -> list[tuple[str, str]]:
    """(class, identifier) of the licences that a normalised sentence says to be under, in order."""
    out = []
    for said in OPEN.finditer(s):
        if DENIED.search(s, 0, said.start()):
            continue
        at = said.end()
        while True:
            m = next((x for x in ((i, p.match(s, at)) for i, p in STATEMENTS) if x[1]), None)
            if m:
                found, end = _named(*m), m[1].end()
            elif c := CC.match(s, at):
                parts = "-".join(dict.fromkeys(CC_WORDS[w] for w in c["parts"].split()))
                found, end = ("other", f"CC-{parts}" + (f"-{c['v']}.{c['m'] or 0}" if c["v"] else "")), c.end()
            else:
                break
            if found not in out:
                out.append(found)
            # "the MIT license or the Apache license": the statement goes on
            more = re.compile(r" (?:license )?(?:or|and)(?: (?:an?|the|under|terms|of|either))* ").match(s, end)
            if not more:
                break
            at = more.end()
    return out


def _named(ident: str, m: re.Match) -> tuple[str, str]:
    version = (m["v"] or "").replace(" ", ".")
    kind = "GNU" if "GPL" in ident else ident.partition("-")[0] if ident.startswith(("Apache", "MPL")) else "other"
    if "{v}" in ident:
        name = ident.format(v=version + ("" if "." in version else ".0")) if version else ident.partition("-")[0]
    else:
        name = ident
    if kind == "GNU" and version:
        name += "-or-later" if m["later"] and ("later" in m["later"] or "newer" in m["later"] or "+" in m["later"]) else "-only"
    return kind, name


def titled(s: str) -> list[tuple[str, str]]:
    """(class, identifier) of the licence whose name, with a version and a date, is all that a normalised text says."""
    s = re.sub(r"\b([al]?gpl|mpl|epl|eupl)v?([0-9])", r"\1 v\2", s.removeprefix("the "))
    for ident, p in STATEMENTS:
        if (m := p.match(s)) and DATED.fullmatch(s, m.end()):
            return [_named(ident, m)]
    if (c := CC.match(s)) and c.end() == len(s):
        return [("other", "CC-" + "-".join(dict.fromkeys(CC_WORDS[w] for w in c["parts"].split())) + (f"-{c['v']}.{c['m'] or 0}" if c["v"] else ""))]
    return []


def expression(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of an SPDX expression; an exception belongs to the licence before it."""
    out: list[tuple[str, int, int]] = []
    joins = False
    for x in SPDX_ID.finditer(text):
        if x.group().upper() in ("OR", "AND"):
            continue
        if x.group().upper() == "WITH":
            joins = bool(out)
        elif joins:
            name, a, _ = out.pop()
            out.append((f"{name} WITH {x.group()}", a, x.end()))
            joins = False
        else:
            out.append((x.group(), *x.span()))
    return out


def _at_end(s: str) -> str | None:
    """Identifier of the longest known sentence that a normalised one ends with."""
    found = [x for x in TAILS.get(" ".join(s.rsplit(" ", 4)[-4:]), ()) if s.endswith(" " + x)]
    return EXACT[max(found, key=len)] if found else None


def identifiers(text: str) -> list[tuple[str, str, int, int, int]]:
    """(identifier, name said, place among the sentences, start, end) of the known sentences and statements."""
    out = []
    for place, (a, b) in enumerate(sentences(text)):
        if not marked(text[a:b].lower()):
            continue
        s = normalised(text[a:b])
        known = EXACT.get(s) or _at_end(s) or next((i for i, p in OPEN_ENDED if p.fullmatch(s)), None)
        said = statements(s) or (titled(s) if "license" in s else [])
        out += [(kind, name, place, a, b) for kind, name in said]
        if known and not (said and known in ("public-domain", "all-rights")):
            out.append((known, "", place, a, b))
    return out


def match_rules(ids: list[tuple[str, int]], gap: int = GAP) -> list[tuple[int, list[int]]]:
    """(rule, places in ids) of each match: rules in order, each from the first unused identifier on, the next ones being the nearest unused that follow within ``gap`` sentences."""
    used, out = [False] * len(ids), []
    where: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(ids):
        where.setdefault(name, []).append(k)
    for r, (_, rule) in enumerate(RULES):
        if not all(x in where for x in rule):
            continue
        for first in where[rule[0]]:
            if used[first]:
                continue
            got = [first]
            for want in rule[1:]:
                places = where[want]
                at = bisect.bisect_right(places, got[-1])
                while at < len(places) and used[places[at]] and ids[places[at]][1] - ids[got[-1]][1] <= gap:
                    at += 1
                if at == len(places) or ids[places[at]][1] - ids[got[-1]][1] > gap:
                    break
                got.append(places[at])
            if len(got) == len(rule):
                for k in got:
                    used[k] = True
                out.append((r, got))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) of each match of a rule and each SPDX identifier, by start."""
    if not text or not marked(text.lower()):
        return []
    out = [(x, m.start(), m.end()) for m in SPDX.finditer(text) for x, _, _ in expression(m[1])]
    for m in LABEL.finditer(text):
        out += [(name, m.start(), m.end()) for _, name in titled(normalised(m[1].replace("+", " or later")))]
    ids = [x for x in identifiers(text) if not any(a <= x[3] and x[4] <= b for _, a, b in out)]
    for r, got in match_rules([(x[0], x[2]) for x in ids]):
        name = re.sub(r"<\w+>", lambda _: ids[got[0]][1], RULES[r][0])
        out.append((name, ids[got[0]][3], ids[got[-1]][4]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def license_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_licenses, licenses, spans) per row: distinct names in alphabetical order, and name:start:end of every match by start (code points). Null and empty texts have none; rows keep their number, other columns are ignored."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            yield rows_out({"doc_id": (pa.int64(), b.column(0).to_pylist()), "n_licenses": (pa.int64(), [len({x[0] for x in g}) for g in got]), "licenses": (pa.string(), [",".join(sorted({x[0] for x in g})) for g in got]), "spans": (pa.string(), [",".join(f"{n}:{a}:{e}" for n, a, e in g) for g in got])})

    return by_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), f, "doc_id long, n_licenses long, licenses string, spans string")
