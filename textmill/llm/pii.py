"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns are found exactly. The field adds spans that they don't see:
obfuscated addresses, national phone numbers, grouped or dotted numbers, IPv6
addresses, bank accounts, national identity numbers, access keys and passwords.
It scores whole candidate segments of at most ``MAX_TOKENS``
tokens with features of the whole span (shape, digit count, Luhn sum,
neighbouring words), and a dynamic program over segmentations chooses
boundaries and kinds jointly; base spans are fixed segments there. It is
trained here, by gradient ascent on the likelihood of synthetic sentences, with
the forward and backward sums of the same recursion.

Candidates are looked for only from tokens near five digits, an @, a spelt
address, a long run or an assigned secret, one of which every candidate holds;
from other tokens none starts.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import by_arrow, rows_out

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "id")
MAX_TOKENS = 18
#: No kind has more digits than a bank account or an IPv6 address.
MOST_DIGITS = 34
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LONGEST = 64
AT = re.compile("@")
#: Beyond ASCII, what could be a digit to str.isdigit(): Latin letters aren't.
RARE_DIGIT = re.compile("[\u00b2\u00b3\u00b9\u0300-\U0010ffff]")
#: Where the signs of a spelt address start.
SPELT = re.compile(r"(?i)(?=[ \[(]at[\]) ] ?[a-z0-9]+ ?[ \[(]dot)")
#: An address with its signs spelt.
SPELT_ADDRESS = re.compile(r"(?i)[a-z0-9._]+(?: dot [a-z0-9]+)?(?: at | ?[\[(]at[\])] ?)[a-z0-9]+(?:(?: dot | ?[\[(]dot[\])] ?)[a-z0-9]+)*(?: dot | ?[\[(]dot[\])] ?)[a-z]+")
#: One token that could be a key, and where the value of a secret starts.
RUN = re.compile(r"(?<![^\W_])(?:(?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,}|[A-Z]{16,})(?![^\W_])")
CUE = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?$")
GIVEN = re.compile(r" ?[\"']?(?=[^\W_])")
EQUALS = re.compile("[:=]")
#: No candidate with five digits holds one: a word beside a blank, a line that starts with a token.
APART = re.compile(r"[^\W\d_]{2,} | [^\W\d_]{2,}|\n\S")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    """The Luhn sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # the local part is what precedes an @, back to the last match at most
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out)


def _shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", s)))


CUES = {"email": "mail", "mail": "mail", "contact": "mail", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "account": "card", "iban": "iban", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "pwd": "secret", "bank": "iban", "ssn": "id", "passport": "id", "social": "id"}


#: Addresses with a run of zeros left out.
SHORT_IP = re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![\w:])")


def mod_97(s: str) -> bool:
    """The check digits of a bank account hold."""
    s = s.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(s: str, before: str, assigned: bool = False) -> list[str]:
    """Whole-span features of a segment with the last word before it, and whether it stands where the value of a secret starts."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    shape = _shape(s)
    f = [f"digits={min(digits, 20)}", f"share={int(4 * digits / len(s))}", f"first={shape[0]}", f"last={shape[-1]}", f"cue={CUES.get(before.lower(), '-')}"]
    f.append("luhn" if 12 <= digits <= 19 and not letters and luhn("".join(c for c in s if c.isdigit())) else "no-luhn")
    if "@" in s:
        f.append("at-sign")
    if re.search(r"(?i)[ \[(]at[ \])].*[ \[(]dot[ \])]", s):
        f += ["spelt-at-dot", f"dots={len(re.findall('(?i)dot', s))}"]
    if re.fullmatch(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", s):
        f.append("four-parts")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s):
        f.append("national")
    if re.fullmatch(r"[A-Za-z0-9_]+", s) and digits and letters:
        f.append(f"mixed-run={min(len(s) // 8, 4)}")
        if re.fullmatch(r"[0-9a-f]+", s):
            f.append("hex")
        if not any(c.islower() for c in s):
            f.append("upper-run")
        if re.fullmatch(r"[A-Z]{4}[A-Z0-9]{16}", s):
            f.append("twenty-upper")
    if re.fullmatch(r"[A-Z]{16,}", s):
        f.append("upper-letters")
    if s.count(":") > 3 and re.fullmatch(r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}", s):
        f += ["colon-groups", f"colons={s.count(':')}"]
    if "::" in s and SHORT_IP.fullmatch(s):
        f.append("short-groups" if digits else "scoped-words")
    if re.match(r"[A-Z]{2}[0-9]{2}", s):
        f.append("check-digits" if mod_97(s) else "account-like")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
        f.append("three-two-four")
    if re.fullmatch(r"0[0-9]{2,4}[ /-][0-9 ]{5,9}", s):
        f.append("zero-led")
    if assigned:
        f.append("assigned")
    if s[0] in "([" and s[-1] not in ")]" or s[0] in "-., ":
        f.append("ragged")
    f.append(f"blanks={min(s.count(' '), 4)}")
    return [*f, ""]


def starts(text: str, x: int, y: int) -> list[tuple[int, int]]:
    """Merged stretches of text[x:y], by start, in which every candidate starts: at most LONGEST characters before what it must hold."""
    digits = [m.start() for m in DIGIT.finditer(text, x, y)]
    if not text.isascii() and (rare := [m.start() for m in RARE_DIGIT.finditer(text, x, y) if m.group().isdigit()]):
        digits = sorted(digits + rare)
    near = [(b - LONGEST, a) for a, b in zip(digits, digits[4:]) if b - a < LONGEST and not APART.search(text, a, b + 1)]
    near += [(m.start() - LONGEST, m.start()) for m in AT.finditer(text, x, y)]
    if "dot" in text[x:y].lower():
        near += [(m.start() - LONGEST, m.start()) for m in SPELT.finditer(text, x, y)]
    # the pattern of runs is tried only where a word is long enough
    if any(len(w) >= 16 and RUN.search(w) for w in text[x:y].split()):
        near += [(m.start(), m.start()) for m in RUN.finditer(text, x, y)]
    if "::" in text[x:y]:
        near += [(m.start(), m.start()) for m in SHORT_IP.finditer(text, x, y)]
    near += [(at, at) for at in assigned(text, x, y)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(near):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def assigned(text: str, x: int, y: int) -> set[int]:
    """Where values of secrets start in text[x:y]: behind a cue and an equals sign or colon."""
    out = set()
    for m in EQUALS.finditer(text, x, y):
        value = GIVEN.match(text, m.end(), y)
        if value and CUE.search(text[max(x, m.start() - 16) : m.start()]):
            out.add(value.end())
    return out


def candidates(text: str, tokens: list[tuple[int, int]], near: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """Token ranges [i, j) that could be an entity: 6 to 64 characters on one line, ends that are no stray signs, and digits, a spelt or signed address, a run or the whole value of a secret. ``near``: stretches in which all of them start."""
    begins = [a for a, _ in tokens]
    values = assigned(text, tokens[0][0], tokens[-1][1]) if tokens else set()
    which = range(len(tokens)) if near is None else sorted({i for a, b in near for i in range(bisect_left(begins, a), bisect_right(begins, b))})
    for i in which:
        a = begins[i]
        if not (text[a].isalnum() or text[a] in "+(["):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            b = tokens[j - 1][1]
            if b - a > LONGEST or "\n" in text[tokens[j - 1][0] - 1 : tokens[j - 1][0]]:
                break
            if b - a < 6 or not text[b - 1].isalnum():
                continue
            s = text[a:b]
            if a in values and not re.search(r"[\s\"'<>]", s) and (b == len(text) or text[b] in " \t\n\"',;.<>)" or b == tokens[-1][1]) or j == i + 1 and RUN.fullmatch(s) or "::" in s and (m := SHORT_IP.match(text, a)) and m.end() == b:
                yield i, j
                continue
            if b - a < 7:
                continue
            digits = sum(c.isdigit() for c in s)
            # an address has one name before its sign: words before it are no part of it
            if 5 <= digits <= MOST_DIGITS and not re.search(r"[^\W\d_]{2,} | [^\W\d_]{2,}", s) or "@" in s and " " not in s or SPELT_ADDRESS.fullmatch(s):
                yield i, j


NONE = [0.0] * len(KINDS)


class Field:
    """A semi-Markov conditional random field: weights of the kinds per feature."""

    def __init__(self) -> None:
        self.w: dict[str, list[float]] = {}

    def segments(self, text: str, tokens: list[tuple[int, int]], near: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, list[str], float]]:
        """(i, j, kind, features, score) of all candidate entities."""
        out, values = [], assigned(text, tokens[0][0], tokens[-1][1]) if tokens else set()
        for i, j in candidates(text, tokens, near):
            before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
            if i > 1 and not before.isalnum():
                before = next((text[a:b] for a, b in reversed(tokens[max(0, i - 4) : i]) if text[a].isalpha()), "")
            f = features(text[tokens[i][0] : tokens[j - 1][1]], before, tokens[i][0] in values)
            scores = map(sum, zip(NONE, *[w for x in f if (w := self.w.get(x))]))
            out += [(i, j, k, f, score) for k, score in enumerate(scores)]
        return out

    def decode(self, n: int, segments: list[tuple[int, int, int, list[str], float]]) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens: its entities. A token outside scores 0, ties go outside."""
        ending: dict[int, list] = defaultdict(list)
        for s in segments:
            ending[s[1]].append(s)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s in ending[j]:
                if best[s[0]] + s[4] > best[j] + 1e-12:
                    best[j], back[j] = best[s[0]] + s[4], s
        out, j = [], n
        while j:
            s = back[j]
            if s:
                out.append((s[0], s[1], s[2]))
            j = s[0] if s else j - 1
        return out[::-1]

    def learn(self, data: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Stochastic gradient ascent on the log likelihood."""
        for turn in range(rounds):
            for text, gold in data:
                tokens = [m.span() for m in TOKEN.finditer(text)]
                segments, n = self.segments(text, tokens), len(tokens)
                fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
                ending, starting = defaultdict(list), defaultdict(list)
                for s in segments:
                    ending[s[1]].append(s)
                    starting[s[0]].append(s)
                for j in range(1, n + 1):
                    fwd[j] = fwd[j - 1]
                    for s in ending[j]:
                        fwd[j] = add(fwd[j], fwd[s[0]] + s[4])
                for i in range(n - 1, -1, -1):
                    bwd[i] = bwd[i + 1]
                    for s in starting[i]:
                        bwd[i] = add(bwd[i], bwd[s[1]] + s[4])
                true = set(gold)
                step = rate / (1 + turn)
                for i, j, k, f, score in segments:
                    p = math.exp(min(0.0, fwd[i] + score + bwd[j] - fwd[n]))
                    hit = (tokens[i][0], tokens[j - 1][1], k) in true
                    if hit or p > 1e-4:
                        for x in f:
                            w = self.w.setdefault(x, [0.0] * len(KINDS))
                            w[k] += step * ((hit - p) - decay * w[k])


def synthetic(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` sentences of invented words with entities and with numbers and runs that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "sh", "ti", "ou")) for _ in range(r.randint(1, 4)))
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    num = lambda k: some("0123456789", k)
    hexa = lambda k: some("0123456789abcdef", k)

    def card() -> str:
        while True:
            d = "4" + num(15)
            if luhn(d):
                return r.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))))

    def iban() -> str:
        land, rest = r.choice(("DE", "FR", "ES", "GB", "NL")), num(r.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        d = f"{land}{check:02d}{rest}"
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, len(d), 4))))

    def email() -> str:
        name = r.choice((word(), f"{word()} dot {word()}", f"{word()}.{num(2)}"))
        return r.choice((f"{word()}.{num(2)}@{word()}.example.com", f"{name} at {word()} dot com", f"{word()}[at]{word()}[dot]org", f"{word()} (at) {word()} (dot) net", f"{name} at {word()} dot co dot uk"))

    make = {
        0: email,
        1: lambda: r.choice((r.choice((".", " . ")).join(str(r.randint(1, 255)) for _ in range(4)), ":".join(hexa(4) for _ in range(8)), f"2001:db8::{hexa(4)}:{num(2)}:{hexa(4)}", f"fe80::{hexa(r.randint(1, 4))}", f"{hexa(4)}:{hexa(4)}::{hexa(r.randint(1, 4))}")),
        2: card,
        3: lambda: r.choice((f"0{r.randint(1, 9)} " + " ".join(num(2) for _ in range(4)), f"0{r.randint(1, 9)}." + ".".join(num(2) for _ in range(4)), f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}", f"0{num(3)} {num(7)}", f"0{num(2)}/{num(7)}")),
        4: lambda: r.choice(("AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), some("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", 32))),
        5: iban,
        6: lambda: f"{num(3)}-{num(2)}-{num(4)}",
    }
    # digests, commits and identifiers are runs of hexadecimal digits too: without a cue they are no secrets
    digest = lambda: r.choice(("commit ", "md5 ", "sha1 ", "sha256: ", "rev ", "digest ", "checksum ", "etag ", "", "", "")) + r.choice((hexa(40), hexa(32), hexa(64), hexa(12), "-".join(map(hexa, (8, 4, 4, 4, 12)))))
    none = (digest, digest, digest, lambda: r.choice(("add::face", "bad::cafe", "dead::beef::add")), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(5), lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"version {num(1)}.{num(2)}.{num(3)}", lambda: num(14), lambda: f"{num(4)} {num(4)}", lambda: f"{word()} {num(3)}", lambda: f"{num(3)}.{num(5)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{word()}{num(6)}", lambda: f"isbn {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 8), lambda: f"{word()} at {word()} {word()}")
    cues = {0: ("email", "contact"), 1: ("host", "server"), 2: ("card", "account"), 3: ("phone", "call", "tel"), 4: ("token =", "key:", "secret"), 5: ("bank", "iban"), 6: ("ssn", "social")}
    values = (lambda: hexa(r.randint(8, 20)), lambda: hexa(r.choice((32, 40))), lambda: word() + num(r.randint(1, 3)), lambda: word() + some("!#%&", 1) + num(2) + word(), lambda: make[4]())
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(0, 2)):
            k = r.randrange(7)
            if k == 4 and r.random() < 0.5:
                text += " " + r.choice(("password=", "token = \"", "api_key: ", "passwd: ", "secret='", "pwd="))
                s = r.choice(values)()
                if len(s) < 6:
                    continue
            else:
                text += " " + (r.choice(cues[k]) + " " if r.random() < 0.3 else word() + " ")
                s = make[k]()
            gold.append((len(text), len(text) + len(s), k))
            text += s + (text[gold[-1][0] - 1] if text[gold[-1][0] - 1] in "\"'" else "") + r.choice((" ", ". ", ", ")) + word()
        if r.random() < 0.6:
            text += " " + r.choice(none)() + " " + word()
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> dict[str, list[float]]:
    """Weights of the field; the same in every process."""
    field = Field()
    field.learn(synthetic())
    return dict(field.w)


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each as (start, kind, end) by start, then kind."""
    base = base_spans(text)
    more = []
    # base spans are fixed: tokens beside them are decoded between them
    at = 0
    for s, e in [*sorted((s, e) for s, _, e in base), (len(text), len(text))]:
        near = starts(text, at, s) if s - at >= 7 else []
        if near:
            tokens = [m.span() for m in TOKEN.finditer(text, at, s)]
            more += [(tokens[i][0], k, tokens[j - 1][1]) for i, j, k in field.decode(len(tokens), field.segments(text, tokens, near))]
        at = max(at, e)
    return base, sorted(set(base + more))


def pii_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them as kind:start:end; n_secret, n_iban, n_id, n_added (spans beside the base ones) and n_spans count those.

    Offsets are code points, ends exclusive. Null and empty texts have no spans.
    Rows keep their number.
    """
    weights = trained()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.w.update(weights)
        for b in batches:
            got = [find(t or "", field) for t in b.column(1).to_pylist()]
            text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            counts = {f"n_{KINDS[k]}": (pa.int64(), [sum(x[1] == k for x in base) for base, _ in got]) for k in range(4)}
            yield rows_out({"doc_id": (pa.int64(), b.column(0).to_pylist()), **counts, "base_sha256": (pa.string(), [hashlib.sha256(text(base).encode()).hexdigest() for base, _ in got]), "spans": (pa.string(), [text(spans) for _, spans in got]), **{f"n_{KINDS[k]}": (pa.int64(), [sum(x[1] == k for x in spans) for _, spans in got]) for k in (4, 5, 6)}, "n_added": (pa.int64(), [len(spans) - len(base) for base, spans in got]), "n_spans": (pa.int64(), [len(spans) for _, spans in got])})

    return by_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), f, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_iban long, n_id long, n_added long, n_spans long")
