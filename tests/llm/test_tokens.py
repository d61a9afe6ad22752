from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textmill.llm.checksums import crc32c
from textmill.llm.piece_codec import PieceCodec
from textmill.llm.pieces import codec, piece_ids
from textmill.llm.token_records import WordIds, cached_encoder, frames, from_varints, read_token_records, unframed, varints, write_token_records
from textmill.llm.word_table import WordTable

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_records_against_the_library(odd_docs, odd_texts, no_docs, library):
    got = read_token_records(write_token_records(odd_docs, WORD, 1)).collect()
    order = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert read_token_records(write_token_records(no_docs, WORD, 1)).count() == 0


@given(st.lists(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " ", "it's.", "Abc, "])), max_size=6).map("".join), max_size=5))
@settings(max_examples=60, deadline=None)
def test_word_ids_property(texts):
    encode = cached_encoder(WORD)
    for t, (payload, n) in zip(texts, encode(texts)):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert from_varints(payload).tolist() == ids and n == len(ids)


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_pieces_property(text):
    c = codec(PIECE)
    ((ids, digits),) = c.encode([text])
    assert ids.tolist() == c.library.encode(text) and digits.decode() == ",".join(map(str, ids.tolist()))
    assert c.differing == 0


def test_units_that_differ_are_counted(monkeypatch):
    c = PieceCodec(PIECE)
    texts = [r[0] for r in __import__("pyarrow.parquet", fromlist=["x"]).read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pandas().head(300).itertuples(index=False)]
    assert len(list(c.encode(texts))) == 300 and c.differing == 0
    broken = PieceCodec(PIECE)
    monkeypatch.setattr(broken, "merge", lambda units: (np.concatenate([broken.symbol[[ord(x) for x in u]] for u in units]), np.array([len(u) for u in units])))
    with pytest.warns(RuntimeWarning, match="differ"):
        ((ids, _),) = broken.encode(["hello there"])
    assert broken.differing > 0 and ids.tolist() == c.library.encode("hello there")


def test_damage_is_found():
    record = bytearray(frames([varints(np.array([1, 300, 70000]))])[0])
    assert from_varints(unframed([bytes(record)])[0]).tolist() == [1, 300, 70000]
    for at in range(len(record)):
        record[at] ^= 1
        with pytest.raises(ValueError):
            unframed([bytes(record)])
        record[at] ^= 1
    with pytest.raises(ValueError):
        unframed([bytes(record[:9])])


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums_of_many_parts():
    r = random.Random(2)
    parts = [b"123456789", b"", *(r.randbytes(k) for k in (1, 2, 63, 64, 65, 127, 128, 129, 4000)), *(r.randbytes(r.randint(0, 300)) for _ in range(40))]
    assert crc32c(parts).tolist() == [plain_crc32c(p) for p in parts] and crc32c(parts)[0] == 0xE3069283
    assert crc32c([]).tolist() == []


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_words_of_one_hash_are_told_apart():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for n in (256, 1024, 4096):
        pair = [thue_morse(n, x, y) for x, y in (("a", "b"), ("b", "a"), ("ab", "cd"), ("cd", "ab"))]
        texts = [pair[0], pair[1], " ".join(pair), pair[3], pair[2] + " " + pair[1]]
        for t, (payload, _) in zip(texts, WordIds(WORD)(texts)):
            assert from_varints(payload).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
        for t, (ids, _) in zip(texts, PieceCodec(PIECE).encode(texts)):
            assert ids.tolist() == sp.encode(t)


def test_very_long_texts_and_units(monkeypatch):
    r = random.Random(3)
    unspaced = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/中文é") for _ in range(60_000))
    spaced = " ".join("".join(r.choice(("an", "er", "th", "on", "Ti", "é", ", ")) for _ in range(r.randint(1, 4))) for _ in range(800_000))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert len(spaced) > 1 << 22
    for t in (unspaced, spaced, spaced[:5000] + unspaced[:5000] + "\n" + spaced[:3000]):
        ((payload, n),) = WordIds(WORD)([t])
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert n == len(want) and from_varints(payload).tolist() == want
        ((ids, digits),) = PieceCodec(PIECE).encode([t])
        assert ids.tolist() == sp.encode(t) and digits == ",".join(map(str, ids.tolist())).encode()


def test_a_full_table_starts_anew(monkeypatch):
    import textmill.llm.word_table as w

    monkeypatch.setattr(w, "CAP", 3)
    t = WordTable(lambda words: [(np.array([len(x) for x in words]), np.ones(len(words), np.int64))], [np.int64])
    for text in (b"a bb ccc ", b"dddd a bb ", b"eeeee a ", b"a bb ccc dddd eeeee ffffff a bb ggggggg "):
        blanks = [i for i, c in enumerate(text) if c == 32]
        starts = np.array([0, *[b + 1 for b in blanks[:-1]]])
        ((got, borders),) = t.lookup(text, starts, np.array(blanks))
        assert got.tolist() == [len(x) for x in text.split()] and len(borders) == len(got) + 1


def test_piece_table_against_the_library(odd_docs, odd_texts, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for i, t in odd_texts:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, piece_ids(odd_docs, PIECE).collect()), key=key) == sorted(want, key=key)
    assert piece_ids(no_docs, PIECE, texts=True).count() == 0
