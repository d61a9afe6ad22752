"""SentencePiece encoding and decoding as a table operator; the codec is in piece_codec."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.piece_codec import PieceCodec
from textmill.llm.shared import by_arrow, rows_out

#: Words that a worker keeps from one task to the next at most.
KEPT_WORDS = 150_000

_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; with ``texts`` also ids and decoded.

    Every whole text is encoded; null and empty texts have no ids and decode to
    the empty text. Rows keep their number, repeated ones too.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            got = [(ids.tolist(), text) for ids, text in c.encode([t or "" for t in b.column(1).to_pylist()])]
            back = c.decode([ids for ids, _ in got])
            digest = lambda s: hashlib.sha256(s).hexdigest()
            out = {"doc_id": (pa.int64(), b.column(0).to_pylist()), "n_tokens": (pa.int64(), [len(ids) for ids, _ in got]), "ids_sha256": (pa.string(), [digest(s) for _, s in got]), "decoded_sha256": (pa.string(), [digest(t.encode("utf-8", "surrogatepass")) for t in back])}
            if texts:
                out |= {"ids": (pa.list_(pa.int32()), [ids for ids, _ in got]), "decoded": (pa.string(), back)}
            yield rows_out(out)
        if c.table.n > KEPT_WORDS:
            c.table.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return by_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), f, schema, rows=64)
