"""Token ids of whole texts in grammar-compressed files, and back.

Documents are dealt to contiguous ranges of their id, each range writes its ids in
blocks (``repair.py``), in order. The files are a table of blocks that Spark
writes, so that a lost task leaves no half file, on any storage Spark knows.
Global positions come from the blocks' token counts, one small row per block.

Defined cases: null and empty texts have the end id alone; equal document ids are
ordered by a hash of their text, then by their place in the input; a null id comes
first and is read back as null; texts of any length are encoded whole, and a block
takes a longer text alone; an empty table gives an empty result; only the id and
the text are read.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from limpid.llm.common import byte_slices, tidy
from limpid.llm.repair import END, Block, pack
from limpid.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
FIRST_FREE = 49_408
# ids of a block and text bytes of a range, about
BLOCK_IDS = 1 << 20
RANGE_BYTES = 32 << 20
# pieces that a process remembers of late, and as many from before
CACHE_PIECES = 150_000
# the tokenizer's file cuts texts by [\p{L}]+|[\p{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+, fixed value
BLANK, LETTER, NUMBER, OTHER = range(4)
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")
# code points that are cut here lie below
LATIN = 0x180


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(LATIN, OTHER, np.uint8)
    for kind, member in ((BLANK, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[[c for c in range(LATIN) if regex.match(member, chr(c))]] = kind
    return kinds


def cut_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of lower-case Latin texts, and where each text's begin, with the end of the last."""
    codes = np.frombuffer("\n".join(texts).encode("utf-16-le"), "<u2")
    kind = _kinds()[codes]
    begins = kind == NUMBER
    begins[:1] = True
    begins[1:] |= kind[1:] != kind[:-1]
    # an apostrophe that begins a run takes an ending with it, and what follows that is a piece of its own
    quote = np.flatnonzero(begins & (codes == ord("'")))
    after = [np.where(quote + k < len(codes), codes[np.minimum(quote + k, len(codes) - 1)], 0) for k in (1, 2)]
    long = np.any([(after[0] == ord(x[0])) & (after[1] == ord(x[1])) for x in LONG_ENDS], axis=0)
    short = np.isin(after[0], [ord(x) for x in SHORT_ENDS])
    begins[quote[short | long] + 1] = False
    rest = np.concatenate([quote[short] + 2, quote[long] + 3])
    rest = rest[rest < len(codes)]
    begins[rest[kind[rest] == LETTER]] = True
    kept = kind != BLANK
    begins &= kept
    # without blanks a piece ends where the next begins
    of_text = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(np.flatnonzero(begins), of_text)
    codes = codes[kept]
    at = np.append(np.flatnonzero(begins[kept]), len(codes))
    data = codes.tobytes().decode("utf-16-le").encode()
    if len(data) > len(codes):  # two bytes from U+0080 on
        at = np.append(0, np.cumsum(1 + (codes >= 128)))[at]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)), bounds


class Encoder:
    """The library's ids of a text, as 16-bit numbers.

    In Latin texts (no code point from U+0180 on, no dotted capital I) the normal
    form changes nothing but case, so pieces can be cut here and only new ones go
    to the library's model. All other texts go through the whole library, and so
    do texts that hold an added token ("<|endoftext|>") if ``added`` is set: then
    it has its own id, as the library has it by default; else it is read as text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.model = self.library.model
        self.held = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.foreign = re.compile("[^\0-\u012f\u0131-\u017f]").search
        # byte-level spelling: bytes that print stand for themselves, the others for letters from 256 on; no piece holds a space
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        spelling = {b: chr(256 + k) for k, b in enumerate(hidden)} | {ord(" "): " "}
        self.spelling = "".join(spelling.get(b, chr(b)) for b in range(256))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def other(self, text: str) -> bool:
        """Whether a text has to go through the whole library."""
        return not text.isascii() and self.foreign(text) is not None or any(t in text for t in self.held)

    def _piece(self, spelled: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _pack_latin(self, texts: list[str]) -> list[bytes]:
        pieces, bounds = cut_pieces(texts)
        if not len(pieces):
            return [b""] * len(texts)
        coded = pieces.dictionary_encode()
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")
        spelled = codecs.charmap_decode(line[0].as_buffer().to_pybytes(), "strict", self.spelling)[0].split(" ")
        number, packed = coded.indices.to_numpy(), list(map(self.known.get, spelled))
        for k in [k for k, x in enumerate(packed) if x is None]:
            packed[k] = self.known[spelled[k]] = self.older.get(spelled[k]) or self._piece(spelled[k])
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        ids, begin, size = np.frombuffer(b"".join(packed), "<u2"), (np.cumsum(size) - size)[number], size[number]
        ends = np.cumsum(size)
        out = ids[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)].tobytes()
        edges = (2 * np.append(0, ends)[bounds]).tolist()
        return [out[a:b] for a, b in zip(edges, edges[1:])]

    def pack_all(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        other = [self.other(t) for t in texts]
        whole = iter(self._whole([t for t, o in zip(texts, other) if o]))
        latin = iter(self._pack_latin([t.lower() for t, o in zip(texts, other) if not o]))
        return [next(whole) if o else next(latin) for o in other]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_column: str = "doc_id", text: str = "text", end: int = END, added: bool = False) -> None:
    """Encode all texts and write their blocks below ``path``; ``added`` as in ``Encoder``."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    used = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, -(-used // RANGE_BYTES))
    close = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_all, part = encoder(tokenizer, added).pack_all, TaskContext.get().partitionId()
        held, ids, n, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal held, ids, n, number
            counts = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            named = np.array([0 if d is None else d for d in held], dtype=np.int64)
            data = pack(named, counts, np.frombuffer(b"".join(ids), dtype="<u2"), FIRST_FREE)
            nulls = [k for k, d in enumerate(held) if d is None]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([nulls], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["range", "number", "n_tokens", "no_id", "data"])
            held, ids, n, number = [], [], 0, number + 1
            return out

        for batch in batches:
            for slice_ in byte_slices(batch, text, 4 << 20):
                for d, x in zip(slice_.column(id_column).to_pylist(), pack_all([t or "" for t in slice_.column(text).to_pylist()])):
                    held.append(d)
                    ids.append(x + close)
                    n += len(x) // 2 + 1
                    if n >= BLOCK_IDS:
                        yield block()
        if held:
            yield block()

    placed = docs.select(F.col(id_column), F.col(text), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    order = [F.col(id_column).asc_nulls_first(), F.col("_hash"), F.col("_place")]
    sorted_ = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    blocks = sorted_.select(id_column, text).mapInArrow(tidy(run), "range int, number int, n_tokens long, no_id array<int>, data binary")
    # blocks are compressed already
    blocks.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = "range int, number int, n_tokens long, no_id array<int>, data binary"
    blocks = spark.read.schema(schema).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["data"])
                ids, at = block.ids(), block.token_at.astype(np.int64)
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                named = block.doc_ids.tolist()
                for k in row["no_id"] or []:
                    named[k] = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["range"]] * len(named), pa.int32()), pa.array([row["number"]] * len(named), pa.int32()), pa.array(named, pa.int64()),
                     pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    names=["range", "number", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = blocks.select("range", "number", "no_id", "data").mapInArrow(tidy(run), "range int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    before = lambda *by: Window.partitionBy(*by).orderBy(*(["number"] if by else ["range"])).rowsBetween(Window.unboundedPreceding, -1)
    # running counts of blocks inside their range, then of whole ranges: small rows, few of them
    counts = blocks.select("range", "number", "n_tokens")
    inner = counts.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before("range")), F.lit(0))).drop("n_tokens")
    outer = counts.groupBy("range").agg(F.sum("n_tokens").alias("n")).withColumn("_out", F.coalesce(F.sum("n").over(before()), F.lit(0))).drop("n")
    starts = inner.join(outer, "range").select("range", "number", (F.col("_in") + F.col("_out")).alias("_start"))
    return docs.join(starts, ["range", "number"]).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, **options)
    return read(docs.sparkSession, path)
