"""What the corpus operators share: reading, whole-text batches, fixed character rules."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from limpid.session import stage  # noqa: F401  (re-exported for the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# fixed values: what separates words in the two word rules of the contracts
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = "\t\n\x0b\x0c\r "

# bytes of text that a task holds as Python strings at a time (a longer text is a batch of its own)
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A to Z change, and null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh_name(stem: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken``."""
    low = {c.lower() for c in taken}
    return stem if stem.lower() not in low else f"{stem}_{uuid.uuid4().hex[:8]}"


def byte_slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice take about ``limit`` bytes, one row at least."""
    size, start, held = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return what a task has freed; a Python worker lives on and would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def reuse_freed() -> None:
    """Let arrays of up to 2 MB take what others have freed; fresh pages cost more than what numpy does with them."""
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(-3, 2 << 20)   # M_MMAP_THRESHOLD
        library.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD; give_back returns it all


def one_thread() -> None:
    """Keep numpy's products of matrices on the core that the task has; its library would start threads for all cores."""
    with contextlib.suppress(OSError):  # a system without this file sets OMP_NUM_THREADS itself
        with open("/proc/self/maps") as maps:
            for path in {line.split(maxsplit=5)[-1].strip() for line in maps if "openblas" in line}:
                for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                    if hasattr(library := ctypes.CDLL(path), name):
                        getattr(library, name)(1)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that leaves its worker small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def map_texts(
    df: DataFrame, text: str, outputs: list[StructField], fn: Callable[[], Callable[[list[str]], list]],
) -> DataFrame:
    """Append ``outputs`` to the rows of ``df``, computed from whole texts in Arrow batches.

    ``fn`` is called once per task and returns the function that turns texts
    (null is empty) into one list per output. Input columns that have the name
    of an output are replaced. No shuffle; a lost task is simply run again.
    """
    names = {f.name.lower() for f in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name == text]
    if text.lower() in names:
        raise ValueError(f"the text column is called like an output: {text}")
    schema = StructType([*kept, *outputs])
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, work = to_arrow_schema(schema), fn()
        types = [target.field(len(keep_names) + i).type for i in range(len(outputs))]
        for batch in batches:
            for part in byte_slices(batch, text):
                made = work([x or "" for x in part.column(text).to_pylist()])
                arrays = [part.column(i) for i in range(len(keep_names))]
                arrays += [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep_names, *(f.name for f in outputs)])

    return df.select(*(f"`{c}`" for c in keep_names)).mapInArrow(tidy(run), schema)
