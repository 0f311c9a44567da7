"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.staging import stage

__all__ = ["Memo", "clean_columns", "documents", "digest_key", "stage", "table", "words_of", "free_name", "sample_texts"]

#: Entries a worker's memo holds before it starts anew; a matter of speed only.
MEMO_ENTRIES = 400_000


class Memo(dict):
    """A bounded memo of ``make(key)``: cleared when full, so memory does not follow the data."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


try:
    _LIBRARY = ctypes.CDLL(None)
except (OSError, TypeError):  # not a system with one C library in reach
    _LIBRARY = None
#: What operators keep in a worker from task to task: how each lets it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, let_go: Callable[[], None]) -> None:
    """Name ``let_go`` for what ``owner`` keeps in this process; tasks of others call it."""
    _KEPT[owner] = let_go


def give_back() -> None:
    """Hand freed memory back to the system; Arrow's pool and glibc would hold it for this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBRARY, "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable:
    """``run`` for mapInArrow: what other operators keep in the worker goes first, freed memory after every batch and at the end.

    Workers outlive their tasks, so what they hold stands beside the stages that follow, those without Python too.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, let_go in list(_KEPT.items()):
            if name != owner:
                let_go()
        yield from run(tidied(batches))
        give_back()

    return lean_run


#: Bytes of a group from which on a task hands memory back after it.
LARGE_GROUP = 1 << 22


def lean_group(run: Callable[..., pa.Table]) -> Callable:
    """``run`` for applyInArrow, called with all its arguments; freed memory goes after large groups."""
    def keyed(key: tuple, group: pa.Table) -> pa.Table:
        out = run(key, group)
        if group.nbytes >= LARGE_GROUP:
            del group
            give_back()
        return out

    return keyed


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(batch_schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in batch_schema], schema=batch_schema)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes split on exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def digest_key(*columns: str) -> Column:
    """128 bits that tell rows with different values of ``columns`` apart; equal rows agree, nulls included."""
    parts = [F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def sample_texts(docs: DataFrame, text: str, rows: int, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """text: at most ``rows`` distinct texts, those of the smallest hashes.

    The rows are counted first and only hashes below a cut, under which about four times as many rows are expected, go on: the texts that
    meet in one task are a bounded number, whatever the size of the table. Copies fall together before they are sorted.
    """
    part = min(1.0, 4 * rows / max(docs.count(), 1))
    few = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    if part < 1.0:
        few = few.where(F.col("h") < int(part * 2**64) - 2**63)
    if where is not None:
        few = few.where(where(F.col("text")))
    return few.dropDuplicates(["h", "text"]).orderBy("h", "text").limit(rows).select("text")


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``, so that extra columns with clashing names cannot meet the operator's own."""
    return df.select(*names)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that nearby values spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches_of(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows: Python objects of one slice are alive at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def batches_of_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows whose texts in ``column`` hold ``most`` bytes at most, or one row each."""
    for batch in batches_of(batches, size):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end
