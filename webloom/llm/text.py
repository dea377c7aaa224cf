"""Words, hashes and folds that several operators share.

Words are the runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased: on bytes, ``lower`` and
``split`` do exactly that and leave every other character alone.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
M1, M2 = U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), U, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * M2
    x = (x ^ (x >> U(29))) * M1
    return x ^ (x >> U(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row; a shorter sequence counts as one; none without words. Order matters."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc *= M1
        acc += h[j : n - k + 1 + j]
        acc ^= acc >> U(31)
    return mixed(acc + U(k))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no further column can clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def numbered(df: DataFrame) -> DataFrame:
    """The same columns called c0, c1, ...: whatever their own names are, none clashes with an operator's. toDF(*names) undoes it."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What numbered() calls the column of this name."""
    return f"c{df.columns.index(name)}"


#: Rows that one call of a mapped function holds as Python objects.
SLICE = 500


def release_memory() -> None:
    """Gives freed memory back to the system, as far as Arrow and the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """A mapInArrow function that gives freed memory back when it ends: workers live on, idle beside the next job's."""

    def whole(it):
        try:
            yield from run(it)
        finally:
            release_memory()

    return whole


def slices(it, size: int = SLICE):
    """Record batches of at most ``size`` rows."""
    for b in it:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def batches(fn):
    """A mapInArrow function from one that takes a record batch; it gets a bounded number of rows at once."""

    def run(it):
        for b in slices(it):
            yield from fn(b)

    return released(run)


def squeezed(df: DataFrame) -> DataFrame:
    """The same frame with each text as zstd-compressed bytes, for shuffles of whole texts; null stays null."""
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in df.schema.fields]
    names = df.columns
    at = names.index("text")

    def run(it):
        z = zstandard.ZstdCompressor(level=1)
        for b in it:
            own = [None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(own, pa.binary()), *b.columns[at + 1 :]], names=names)

    return df.mapInArrow(released(run), T.StructType(fields))


def unsqueezed(column) -> list[str | None]:
    """The texts of an Arrow column that squeezed() made."""
    z = zstandard.ZstdDecompressor()
    return [None if t is None else z.decompress(t).decode("utf-8", "surrogatepass") for t in column.to_pylist()]
