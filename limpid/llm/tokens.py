"""Byte-level BPE of whole texts, and back.

``encode`` appends the ids as packed little-endian unsigned 32-bit integers,
``decode`` turns packed ids into bytes, ``encode_and_decode`` does both in one
pass. All are maps without a shuffle; a task
holds a few megabytes of texts at a time and a bounded memory of pieces.
Appends and edits of single texts: ``prefix_bpe.EncodedText``.

Defined cases: null and empty texts have no ids; texts of any length are encoded
whole; strings of special tokens are ordinary text; repeated rows are encoded
each; an empty table gives an empty result; columns that are called like an
output are replaced; packed ids that are null decode to no bytes, an id outside
the table is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from limpid.llm.common import map_texts, tidy
from limpid.llm.prefix_bpe import encoder

RANKS = "byte_bpe_50k.tiktoken"


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", output: str = "ids") -> DataFrame:
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def start():
        pack_all = encoder(ranks, pattern).pack_all
        return lambda texts: [pack_all(texts)]

    return map_texts(docs, text, [StructField(output, BinaryType())], start)


def encode_and_decode(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded",
) -> DataFrame:
    """The packed ids of every text, and the bytes that these give back."""
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def start():
        made = encoder(ranks, pattern)

        def both(texts: list[str]) -> list[list[bytes]]:
            packed = made.pack_all(texts)
            return [packed, [made.unpack(x) for x in packed]]

        return both

    return map_texts(docs, text, [StructField(ids, BinaryType()), StructField(decoded, BinaryType())], start)


def decode(rows: DataFrame, ranks: str | None = None, pattern: str | None = None, ids: str = "ids", output: str = "decoded") -> DataFrame:
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kept = [f for f in rows.schema.fields if f.name.lower() != output.lower()]
    schema, names = StructType([*kept, StructField(output, BinaryType())]), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = encoder(ranks, pattern).unpack
        for batch in batches:
            made = pa.array([unpack(x or b"") for x in batch.column(ids).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [made], names=[*names, output])

    return rows.select(*(f"`{c}`" for c in names)).mapInArrow(tidy(run), schema)
