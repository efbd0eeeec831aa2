"""BPE encoding and decoding of whole texts (operator 4).

Each task cuts its texts into pre-tokens on their bytes, looks the known words up in its cache and merges the new
ones in batched rounds (bpe.Bpe.merge). Nothing is shuffled. Defined cases: a null text counts as empty and has no
ids; rows that repeat are encoded each; an empty table gives no rows; columns other than the two named are not
read; strings of special tokens in a text become their ids, as the tokenizers library does it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from . import textvec as tv
from .spaces import documents, small_batches


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """id_col, n_tokens and the named outputs of every text.

    Outputs: ids (little-endian unsigned 32-bit), decoded (the bytes that the ids decode to), and of either its
    SHA-256 in hex, ids_sha256 and decoded_sha256, so that only digests leave the task.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long" + "".join(f", {c} {'string' if c.endswith('_sha256') else 'binary'}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = bpe.load(path)
        for batch in batches:
            buf, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off):
                ids, count = bpe.encode_texts(cache, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                made = {"ids": _rows(ids.astype("<u4").view(np.uint8), count * 4)}
                if any(c.startswith("decoded") for c in outputs):
                    size = np.concatenate([[0], np.cumsum(cache.bpe.piece_len[ids])])
                    edge = np.concatenate([[0], np.cumsum(count)])
                    made["decoded"] = _rows(np.frombuffer(cache.bpe.decode(ids), np.uint8), np.diff(size[edge]))
                for c in outputs:
                    if c.endswith("_sha256"):
                        made[c] = pa.array([hashlib.sha256(x).hexdigest() for x in made[c.removesuffix("_sha256")].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count), *(made[c] for c in outputs)], [id_col, "n_tokens", *outputs])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def _rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of every row of ids; bytes that are not UTF-8 become replacement characters."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path).bpe
        for batch in batches:
            texts = [model.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return small_batches(encoded.select(id_col, ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path(), outputs=("ids_sha256", "decoded_sha256"))
