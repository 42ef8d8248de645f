"""Whole texts to token ids and back, as DataFrames."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlight.llm.bpe import loaded, unpack
from gridlight.llm.tables import map_columns


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has no ids.

    ``vocabulary`` is the path of a byte-level vocabulary file that every worker can read.  Rows are independent, so
    nulls in ``id_col``, repeated rows and ties stay as they are; other columns are left out."""
    def run(texts):
        pairs = loaded(vocabulary)
        return [id_lists([pairs.encode_packed(t or "") for t in texts])]
    return map_columns(docs, [text_col], run, "ids array<int>", [id_col])


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null or no ids give an empty text."""
    def run(ids):
        pairs = loaded(vocabulary)
        return [[pairs.decode(x or ()) for x in ids]]
    return map_columns(tokens, [ids_col], run, "text string", [id_col])


def id_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids of several texts as one Arrow list array."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encoded_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for.

    A null or empty text has no tokens.  Rows are independent, so nulls, repeated rows and ties stay as they are."""
    def run(texts):
        pairs = loaded(vocabulary)
        counts, ids, decoded, lists = [], [], [], []
        for text in texts:
            packed = pairs.encode_packed(text or "")
            back = pairs.decode_bytes(unpack(packed)).decode("utf-8", "replace")
            counts.append(len(packed) // 4)
            ids.append(sha256(packed).hexdigest())
            if with_ids:
                lists.append(packed)
            decoded.append(sha256(back.encode()).hexdigest())
        return [counts, ids, decoded, *([id_lists(lists)] if with_ids else [])]
    return map_columns(docs, [text_col], run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, [id_col])
