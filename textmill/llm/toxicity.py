"""Toxicity scores from a learnt lexicon, matched with Levenshtein automata.

Learning takes a bounded sample of labelled rows. Terms are words, or stems of
four letters and more, that occur almost only in toxic texts and in many
different contexts, so copies of one text give no terms. Scoring walks every
word through the union of the terms' Levenshtein automata intersected with the
terms' trie, determinised as it goes: a state is a set of (trie node, errors,
...), and dead states end a word after few letters. An error is a letter too
many, too few or another, or two neighbours swapped. Terms of five letters and
more allow one, of nine and more two; an error in the first letter is the only
one of its word. Shorter terms match exactly. Hits are
weighed by context: those between quotation marks or after a reporting word
count apart from others, and so does the densest window. A logistic regression
over these features gives the score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import bounded_sample, by_arrow, rows_out, written
from textmill.llm.word_table import WordTable, batches_of

#: Labelled rows per class that learning takes at most.
SAMPLE = 6000
WINDOW = 12
FEATURES = 6
QUOTES = '"“”«»„'
REPORTING = {"said", "says", "wrote", "quote", "quoted", "quoting", "word", "words", "term", "called", "dit", "mot", "sagte", "wort", "dijo", "palabra"}
LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
WORDS = re.compile(r"[^\W\d_]+")
#: Characters beyond ASCII that are no letters; those that show nothing; digits and signs that stand for letters inside words.
MARKS, HIDDEN, LEET = re.compile(r"[^\w\x00-\x7f]|(?![\x00-\x7f])\d"), regex.compile(r"\p{Cf}"), re.compile(r"[013457$](?=[^\W\d_])")
LETTERS = dict(zip("013457$", "oieasts"))


def plain(text: str) -> str:
    """Lower-cased, without characters that show nothing, quotation marks as ``"`` and other marks beyond ASCII as blanks, single digits between letters as the letters that they look like."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(lambda m: '"' if m[0] in QUOTES else " ", HIDDEN.sub("", text))
    return LEET.sub(lambda m: LETTERS[m[0]] if m.start() and WORDS.match(text, m.start() - 1) else m[0], text)


@dataclass
class Lexicon:
    """Terms with weights; ``stem`` terms match as prefixes. ``coef`` are the regression's."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    stems: list[bool] = field(default_factory=list)
    coef: list[float] = field(default_factory=lambda: [0.0] * FEATURES)


def allowed(term: str) -> int:
    """Errors that a term allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Lazily determinised intersection of the terms' trie with their Levenshtein automata.

    An element of a state is (node, errors, letter that has to follow a swap,
    whether no error may follow).
    """

    STATES = 100_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.cap: list[int] = [0]  # errors that a term at or below the node allows
        for n, term in enumerate(lexicon.terms):
            at = 0
            for c in ["", *term]:
                if c:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.ends.append([])
                        self.cap.append(0)
                    at = self.next[at][c]
                self.cap[at] = max(self.cap[at], allowed(term))
            self.ends[at].append(n)
        self.reset()

    def reset(self) -> None:
        """Forgets the determinised states."""
        self.sets = [frozenset({(0, 0, "", False)})]
        self.number = {self.sets[0]: 0}
        self.move: list[dict[str, int]] = [{}]
        self.stop: list[tuple[float, int, int] | None] = [None]  # best stem that ends here
        self.whole: list[tuple[float, int, int] | None] = [None]  # best term if the word ends here

    def _best(self, elements: set, stems: bool) -> tuple[float, int, int] | None:
        lex, best = self.lexicon, None
        for node, errors, swap, _ in elements:
            for n in self.ends[node] if not swap else ():
                if (lex.stems[n] or not stems) and errors <= allowed(lex.terms[n]):
                    key = (-errors, lex.weights[n], n)
                    best = max(best, key) if best else key
        return best and (lex.weights[best[2]], -best[0], best[2])

    def _more(self, node: int, errors: int, closed: bool) -> bool:
        return not closed and errors < self.cap[node]

    def _missing(self, elements: set) -> set:
        """The elements, and those after letters of a term that the word leaves out."""
        out, todo = set(elements), list(elements)
        while todo:
            node, errors, swap, closed = todo.pop()
            for to in self.next[node].values() if not swap and self._more(node, errors, closed) else ():
                new = (to, errors + 1, "", not node)
                if errors < self.cap[to] and new not in out:
                    out.add(new)
                    todo.append(new)
        return out

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, errors, swap, closed in self._missing(self.sets[state]):
            if swap:
                if c == swap:
                    out.add((node, errors, "", closed))
                continue
            more = self._more(node, errors, closed)
            for x, to in self.next[node].items():
                if x == c:
                    out.add((to, errors, "", closed))
                elif more and errors < self.cap[to]:
                    out.add((to, errors + 1, "", not node))  # another letter
                    if c in self.next[to] and errors < self.cap[self.next[to][c]]:
                        out.add((self.next[to][c], errors + 1, x, not node))  # x has to follow
            if more:
                out.add((node, errors + 1, "", not node))  # a letter too many
        key = frozenset(out)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.move.append({})
            self.stop.append(self._best(key, True))
            self.whole.append(self._best(self._missing(key), False))
        self.move[state][c] = self.number[key]
        return self.number[key]

    def match(self, word: str) -> tuple[float, int, int] | None:
        """(weight, errors, term) of the term that the word is, or starts with, with fewest errors."""
        if len(self.sets) > self.STATES:
            self.reset()
        state, best = 0, None
        for c in word:
            to = self.move[state].get(c)
            state = self._step(state, c) if to is None else to
            if (hit := self.stop[state]) and (not best or hit[1] < best[1]):
                if not hit[1]:
                    return hit
                best = hit
            if not self.sets[state]:
                return best
        hit = self.whole[state]
        return hit if hit and (not best or hit[1] < best[1]) else best


class Scorer:
    """Features and scores of texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self.table = WordTable(self._encode, [np.float32])

    def _encode(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weight of each word's hit, negative for one with an error; nothing without a hit."""
        hits = [self.automaton.match(w.decode("utf-8", "replace")) for w in words]
        return [(np.array([-h[0] if h[1] else h[0] for h in hits if h], np.float32), np.array([bool(h) for h in hits], np.int64))]

    def features(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Constant, exact hits, hits with an error, densest window, quoted hits, hits per root of the length."""
        for part in batches_of([plain(t).encode("utf-8", "surrogatepass") for t in texts]):
            data = b"\n".join(part) + b"\n"
            is_letter = np.concatenate(([False], LETTER[np.frombuffer(data, np.uint8)], [False]))
            starts, ends = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]), np.flatnonzero(~is_letter[1:] & is_letter[:-1])
            ((weights, borders),) = self.table.lookup(data, starts, ends)
            hits = np.flatnonzero(np.diff(borders))
            first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in part]))))
            cuts = np.searchsorted(hits, first)
            for n in range(len(part)):
                a, b = cuts[n], cuts[n + 1]
                x = np.zeros(FEATURES)
                x[0] = 1
                if b > a:
                    at, w = hits[a:b] - first[n], weights[a:b].astype(float)
                    quoted = np.array([self._quoted(data, starts, int(h), int(first[n])) for h in hits[a:b]])
                    open_w = np.where(quoted, 0, np.abs(w) * np.where(w < 0, 0.5, 1))
                    total = np.concatenate(([0], np.cumsum(open_w)))
                    x[1] = np.log1p(np.where(quoted | (w < 0), 0, w).sum())
                    x[2] = np.log1p(np.where(quoted | (w > 0), 0, -w).sum())
                    x[3] = np.log1p((total[np.searchsorted(at, at + WINDOW)] - total[:-1]).max())
                    x[4] = np.log1p(np.abs(w[quoted]).sum())
                    x[5] = open_w.sum() / np.sqrt(first[n + 1] - first[n] + 10)
                yield x

    @staticmethod
    def _quoted(data: bytes, starts: np.ndarray, hit: int, first: int) -> bool:
        """Between quotation marks on one line within 60 bytes, or within three words after a reporting word."""
        s = int(starts[hit])
        before = data[max(s - 60, 0) : s].rpartition(b"\n")[2].decode("utf-8", "ignore")
        after = data[s : s + 60].partition(b"\n")[0].decode("utf-8", "ignore")
        if sum(before.count(q) for q in QUOTES) % 2 and any(q in after for q in QUOTES):
            return True
        return not REPORTING.isdisjoint(WORDS.findall(before)[-3:])

    def score(self, texts: list[str]) -> list[float]:
        """Scores from 0 to 1."""
        x = np.array(list(self.features(texts))).reshape(-1, FEATURES)
        return (1 / (1 + np.exp(-np.clip(x @ np.array(self.lexicon.coef), -30, 30)))).tolist()


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, pos, neg, contexts) over the sample: words, and prefixes of 4 to 8 letters; contexts is a bit set of neighbours in toxic texts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}

        def rows() -> pa.RecordBatch:
            cols = list(zip(*counts.values())) or [(), (), ()]
            out = rows_out({"term": (pa.string(), [t for t, _ in counts]), "whole": (pa.bool_(), [w for _, w in counts]), **{c: (pa.int64(), list(v)) for c, v in zip(("pos", "neg", "contexts"), cols)}})
            counts.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORDS.findall(plain(text or ""))
                around = ["", *words, ""]
                seen: dict[str, int] = defaultdict(int)
                for i, w in enumerate(words):
                    if len(w) >= 3:
                        seen[w] |= 1 << (hash_of(around[i] + " " + around[i + 2]) & 63)
                terms: dict[tuple[str, bool], int] = defaultdict(int)
                for w, bits in seen.items():
                    terms[w, True] |= bits
                    for k in range(4, min(len(w), 8) + 1):
                        terms[w[:k], False] |= bits
                for key, bits in terms.items():
                    c = counts.setdefault(key, [0, 0, 0])
                    c[0 if toxic else 1] += 1
                    if toxic:
                        c[2] |= bits - (1 << 64) if bits >> 63 else bits
                if len(counts) > 400_000:
                    yield rows()
        if counts:
            yield rows()

    partial = by_arrow(sample.select("text", "toxic"), f, "term string, whole boolean, pos long, neg long, contexts long")
    return partial.groupBy("term", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("bit_count(bit_or(contexts))").alias("contexts"))


def hash_of(s: str) -> int:
    """A hash that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def _choose(rows: list, n_pos: int, n_neg: int) -> Lexicon:
    """The longest term of each chain of prefixes with the same support; as a word if its whole words alone have that support."""
    weight = lambda pos, neg: float(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))
    whole = {r.term: r for r in rows if r.whole}
    stems = {r.term: r for r in rows if not r.whole}
    longest: dict[str, object] = {}  # of each stem: the stem one letter longer, and the whole word, of the most support
    fullest: dict[str, object] = {}
    for t in sorted(stems):
        if t[:-1] not in longest or stems[t].pos > longest[t[:-1]].pos:
            longest[t[:-1]] = stems[t]
    for t in sorted(whole):
        for k in range(4, len(t) + 1):
            if t[:k] in stems and (t[:k] not in fullest or whole[t].pos > fullest[t[:k]].pos):
                fullest[t[:k]] = whole[t]
    chosen: dict[str, tuple[float, bool]] = {}
    for term, r in stems.items():
        if term[:-1] in stems:
            continue
        while (longer := longest.get(r.term)) is not None and longer.pos >= 0.95 * r.pos:
            r = longer
        full = fullest.get(r.term)
        if full is not None and full.pos >= 0.9 * r.pos:
            chosen[full.term] = (weight(full.pos, full.neg), False)
        else:
            chosen[r.term] = (weight(r.pos, r.neg), True)
    covered = {c for c, (_, stem) in chosen.items() if stem}
    for term, r in whole.items():
        if not any(term[:k] in covered for k in range(4, len(term) + 1)):
            chosen.setdefault(term, (weight(r.pos, r.neg), False))
    best = sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))
    return Lexicon([t for t, _ in best], [w for _, (w, _) in best], [s for _, (_, s) in best])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> list[float]:
    """Logistic regression by damped Newton steps; classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[0] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - reg * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Lexicon:
    """Learns from labelled rows whose crc32(id as text) mod 5 isn't 0; at most ``sample`` ids of each class, chosen by hash.

    Labels that disagree count as toxic. Of several texts of an id, the least
    counts, null ones last; null ids and labels that aren't 0 or 1 don't. Without
    rows of both classes no text is toxic beyond the share of the toxic class.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and crc32(cast(id as string)) % 5 <> 0").groupBy("id").agg(F.max("toxic").alias("toxic"))
    part = [bounded_sample(rows.filter(F.col("toxic") == c), sample, "id") for c in (0, 1)]
    chosen = part[0].union(part[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most 2 x sample rows of two numbers, so the broadcast is bounded
    train = written(texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(coef=[float(np.log((n_pos + 1) / (n_neg + 1)))] + [0.0] * (FEATURES - 1))
    train = train.repartition(max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pure = _term_counts(train).filter((F.col("pos") >= max(3, n_pos // 400)) & (F.col("pos") / n_pos >= 10 * F.col("neg") / n_neg) & (F.col("contexts") >= F.least(F.lit(24), F.greatest(F.lit(4), F.col("pos") / 2))))
    # terms of a bounded sample
    lexicon = _choose(sorted(pure.collect(), key=lambda r: (r.term, r.whole)), n_pos, n_neg)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in batches:
            yield rows_out({"x": (pa.list_(pa.float64()), [x.tolist() for x in scorer.features([t or "" for t in b.column(0).to_pylist()])]), "y": (pa.int32(), b.column(1).to_pylist())})

    got = by_arrow(train, f, "x array<double>, y int").collect()  # at most 2 x sample rows
    lexicon.coef = _fit(np.array([r.x for r in got]), np.array([r.y for r in got], float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row. Words are runs of letters of ``plain`` texts, of any length. Null and empty texts get the score of a text without hits; a null id isn't held out; repeated rows score alike. Other columns are ignored."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in batches:
            s = scorer.score([t or "" for t in b.column(2).to_pylist()])
            yield rows_out({"doc_id": (pa.int64(), b.column(0).to_pylist()), "held_out": (pa.bool_(), b.column(1).to_pylist()), "score": (pa.float64(), s), "predicted": (pa.int32(), [int(v >= 0.5) for v in s])})

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return by_arrow(docs.select(F.col(id_col).cast("long"), held, F.col(text_col).cast("string")), f, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents with scores below 0.5, all columns as they are. Null and empty texts stay unless the regression says otherwise of texts without hits; rows with a null id and repeated rows are decided by their texts. No shuffle."""
    at = docs.columns.index(text_col)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in batches:
            yield b.filter(pa.array([s < 0.5 for s in scorer.score([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

    return by_arrow(docs, f, docs.schema)
