from __future__ import annotations

import numpy as np
import xxhash

from textmill.llm.components import connected_components
from textmill.llm.shared import bounded_sample
from textmill.llm.shingle_hash import fingerprint, shingles, words
from textmill.llm.simhash import bucket_links, drop_near_duplicates, near_duplicate_groups, simhash_components
import textmill.llm.simhash as simhash_module


def plain_fingerprint(text):
    ws = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]
    parts = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 3 else [b" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def union_find(ids, linked):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_plain_one(odd_texts):
    assert [fingerprint(t, 3) for _, t in odd_texts] == [plain_fingerprint(t) for _, t in odd_texts]


def test_components_are_those_of_all_pairs(spark, odd_docs, odd_texts, no_docs):
    got = simhash_components(odd_docs).collect()
    assert len(got) == len(odd_texts)
    prints = [(i, plain_fingerprint(t)) for i, t in odd_texts]
    ids = sorted({i for i, _ in prints if i is not None})
    pairs = [(a, b) for a, x in prints for b, y in prints if a is not None and b is not None and bin(x ^ y).count("1") <= 2]
    want = union_find(ids, pairs)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == set(prints)
    assert simhash_components(no_docs).count() == 0


def test_dense_buckets_are_split_without_loss(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = int(r.integers(0, 1 << 63))
    prints = {base}
    while len(prints) < 60:
        x = base
        for b in r.integers(0, 63, int(r.integers(1, 4))):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate(prints)], "id long, sig array<long>")
    monkeypatch.setattr(simhash_module, "MAX_BUCKET", 4)
    got = union_find(range(len(prints)), [(e.a, e.b) for e in bucket_links(nodes, 2, 2).collect()])
    assert got == union_find(range(len(prints)), [(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints) if bin(x ^ y).count("1") <= 2])


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (30, 30)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 20: 20, 21: 20}


def test_near_copies_leave_one(odd_docs, odd_texts, no_docs):
    groups = {(r.doc_id, r.group_id) for r in near_duplicate_groups(odd_docs).collect()}
    a, b = (set(shingles(words(t), 5)) for t in (odd_texts[0][1], odd_texts[2][1]))
    assert len(a & b) / len(a | b) >= 0.8
    assert {(1, 1), (2, 1), (3, 1), (14, 1), (4, 4), (5, 4), (6, 4), (12, 12)} <= groups
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 3, 14, 5} & set(ids) and ids.count(12) == 1 and {7, 8, 9, 10, 13} <= set(ids)
    assert drop_near_duplicates(no_docs).count() == 0


def test_dense_buckets_of_long_signatures_are_linked(spark, monkeypatch):
    r = np.random.default_rng(4)
    rest = [int(x) for x in r.integers(0, 1 << 62, 3)]
    # a chain in one segment: neighbours differ in 9 bits there, others in 18 and more, and ids are shuffled
    low = [sum(((i + 1 + k) // 2 % 2) * (511 << 9 * k) for k in range(2)) for i in range(4)]
    sigs = [x | y << 18 for x in low for y in (0, 31, 31 << 5)]
    order = r.permutation(len(sigs)).tolist()
    nodes = spark.createDataFrame([(order[i], [x, *rest]) for i, x in enumerate(sigs)], "id long, sig array<long>")
    monkeypatch.setattr(simhash_module, "MAX_BUCKET", 4)
    got = union_find(range(len(sigs)), [(e.a, e.b) for e in bucket_links(nodes, 8, 9).collect()])
    assert got == union_find(range(len(sigs)), [(order[i], order[j]) for i, x in enumerate(sigs) for j, y in enumerate(sigs) if (x ^ y).bit_count() <= 9])


def test_many_texts_of_one_signature_leave_one(spark, monkeypatch):
    r = np.random.default_rng(5)
    ws = [f"w{x}" for x in r.integers(0, 10**6, 60)]
    texts = [" ".join(w.upper() if i >> k & 1 else w for k, w in enumerate(ws)) for i in range(10)]
    texts += [" ".join(ws + ws[:k]) for k in range(1, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash_module, "MAX_BUCKET", 4)
    assert [x.doc_id for x in drop_near_duplicates(docs).collect()] == [0]


def similar_texts():
    """A template family: a and b are near copies, c has a's words in reverse; the signatures of a and c are equal."""
    r = np.random.default_rng(6)
    ws = [f"w{x}" for x in r.integers(0, 10**6, 200)]
    a, b = " ".join(ws), " ".join(ws[:100] + ["other"] + ws[101:])
    return [(1, " ".join(ws[::-1])), (2, a), (3, b), (4, " ".join([*ws[100:], *ws[:100]])), (5, " ".join(ws[50:] + ws[:50]))]


def test_similar_pairs_off_the_forest_are_found(spark, monkeypatch):
    texts = similar_texts()
    sets = {i: set(shingles(words(t), 5)) for i, t in texts}
    want = union_find(sets, [(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert want[2] == want[3] == 2 and want[1] == 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for part in (1024, 2):
        monkeypatch.setattr(simhash_module, "PART", part)
        assert {x.doc_id: x.group_id for x in near_duplicate_groups(docs).collect()} == want


def test_near_copies_with_names_of_its_own(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "row", "mark", "n", "id", "sig", "text_key", "group_id", "a", "b", "key"]
    docs = spark.createDataFrame([(i, text, *["x"] * (len(names) - 1)) for i in (3, 1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[1:]))
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]


def test_hot_fingerprints_take_the_broadcast(spark, odd_docs, monkeypatch):
    import textmill.llm.shared as shared

    want = sorted(map(str, simhash_components(odd_docs).collect()))
    groups = sorted(map(str, near_duplicate_groups(odd_docs).collect()))
    monkeypatch.setattr(shared, "HOT", 1)
    assert sorted(map(str, simhash_components(odd_docs).collect())) == want
    assert sorted(map(str, near_duplicate_groups(odd_docs).collect())) == groups


def test_sample_is_the_same_in_every_partitioning(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as v")
    got = [sorted(r.id for r in bounded_sample(df.repartition(n), 100, "id").collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 100


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    one, other = "one text that nothing else repeats", "quite another document that shares nothing with the first one at all"
    docs = spark.createDataFrame([(5, None, "a"), (5, None, "b"), (9, one, "x"), (9, other, "y"), (None, one, "z"), (None, "third words of no id", "n"), (None, "third words of no id", "m"), (3, "third words of no id", "k")], "doc_id long, text string, n string")
    got = {tuple(r) for r in drop_near_duplicates(docs).collect()}
    assert got == {(5, None, "a"), (9, one, "x"), (9, other, "y"), (3, "third words of no id", "k")}
    assert [tuple(r) for r in drop_near_duplicates(docs.filter("doc_id is null")).filter("n <> 'z'").collect()] == [(None, "third words of no id", "m")]


def mixed_corpus():
    """Families of near copies of several sizes and similarities, exact and blank copies, repeated ids, nulls."""
    r = np.random.default_rng(11)
    some = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    out = []
    for _ in range(25):
        base = some(int(r.integers(30, 300)))
        out.append(" ".join(base))
        for _ in range(int(r.integers(0, 6))):
            ws = list(base)
            for at in r.integers(0, len(ws), int(r.integers(0, max(2, len(ws) // 20)))):
                ws[at] = f"x{int(r.integers(0, 9999))}"
            out.append(" ".join(ws))
    out += [" ".join(some(int(r.integers(1, 60)))) for _ in range(80)] + ["", None, " \n", "A b", "a  B"]
    rows = [(i // 2 if i % 17 == 0 else i if i % 23 else None, t, i) for i, t in enumerate(out)]
    return [rows[i] for i in r.permutation(len(rows))]


def test_near_dedup_by_definition(spark):
    """Every pair that is linked reaches the similarity, nine of ten that reach it are found, and exactly one row of each group stays."""
    rows = mixed_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    sets = {n: set(shingles(words(t), 5)) for _, t, n in rows}
    similar = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ns = [n for _, _, n in rows]
    pairs = [(a, b) for i, a in enumerate(ns) for b in ns[:i] if similar(a, b)]
    want = union_find(ns, pairs)
    kept = {r.n for r in drop_near_duplicates(docs).collect()}
    groups = {}
    for n in ns:
        groups.setdefault(want[n], set()).add(n)
    assert all(kept & g for g in groups.values()), "a group lost all its documents"
    right = sum(len(kept & g) == 1 for g in groups.values() if len(g) > 1)
    assert right >= 0.9 * sum(len(g) > 1 for g in groups.values())
    of = {n: (i, t) for i, t, n in rows}
    for g in groups.values():
        if len(kept & g) == 1:
            i, _ = of[next(iter(kept & g))]
            ids = [of[n][0] for n in g if of[n][0] is not None]
            assert i == min(ids, default=None)
    again = {r.n for r in drop_near_duplicates(docs.repartition(7)).collect()}
    assert again == kept


def threshold_corpus():
    """Families of texts of 6 to 900 words with similarities about the bound, on a template that all share, and a text of few words."""
    r = np.random.default_rng(21)
    template = [f"t{x}" for x in r.integers(0, 3000, 150)]
    out = []
    for n in (6, 12, 30, 60, 120, 300, 500, 900) * 3:
        base = [f"w{x}" for x in r.integers(0, 4000, n)] + template[: n // 4]
        for edits in (0, *r.integers(max(1, n // 70), n // 35 + 3, 5).tolist()):
            ws = list(base)
            for at in r.permutation(len(ws))[:edits].tolist():
                ws[at] = f"x{int(r.integers(0, 10**6))}"
            out.append(" ".join(ws))
    out += [" ".join([*template, *(f"v{x}" for x in r.integers(0, 10**6, 25))]) for _ in range(20)] + ["few words"]
    return [(i, out[j]) for i, j in enumerate(r.permutation(len(out)).tolist())]


def test_near_copies_are_those_of_all_pairs(spark, monkeypatch):
    texts = threshold_corpus()
    sets = {i: set(shingles(words(t), 5)) for i, t in texts}
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert sum(0.8 <= x < 0.85 for x in share.values()) > 20 and sum(0.75 <= x < 0.8 for x in share.values()) > 20
    want = union_find(sets, [p for p, x in share.items() if x >= 0.8])
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for part in (1024, 3):
        monkeypatch.setattr(simhash_module, "PART", part)
        assert {x.doc_id: x.group_id for x in near_duplicate_groups(docs).collect()} == want
    # and without what SimHash finds first
    assert {x.doc_id: x.group_id for x in near_duplicate_groups(docs, distance=-1).collect()} == want
