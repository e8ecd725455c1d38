"""Small helpers that the text operators share: byte tables, bounded chunks, words of a chunk as arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonloom.session import cut

#: A-Z to a-z; every other byte stays, so UTF-8 sequences are untouched.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Text bytes that are worked on at once (one longer document makes a chunk of its own).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of (id, text hash) up to which a list of documents is broadcast: 2 MB of keys.
BROADCAST_IDS = 100_000


def listed(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose (doc_id, text hash) is in ``ids`` (doc_id, text_key) by a left_semi join, or isn't by a
    left_anti; null ids are equal. A list that is proven small is broadcast, so the texts aren't shuffled."""
    ids = cut(ids.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    same = docs["doc_id"].eqNullSafe(ids["_id"]) & (F.xxhash64(docs["text"]) == ids["_key"])
    return docs.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, same, how)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


def sliced(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Row ranges whose texts hold about ``limit`` bytes (one row at least) with their texts, null as None. Sizes come
    from the column's offsets; only one range's texts are made at a time."""
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(column):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + limit, side="right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def give_back() -> None:
    """Memory that Arrow's pool and the C library hold for reuse goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (for mapInArrow) that gives its memory back when its partition ends. Spark keeps a Python worker for later
    tasks, so what it holds idle would stand beside all that its executor does next."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return call


def drawn(key: Column, rows: int, total: int, seed: int) -> Column:
    """True for about ``rows`` of ``total`` keys, by a uniform 62-bit hash: the bound holds at any total."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 62)) < F.lit(min(1 << 62, (1 << 62) * rows // max(total, 1)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x100000001B3
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 1 << 16), _BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step)
    return _powers[:n]


class Words:
    """Words of several texts laid out as arrays: byte ranges, text number, place in the text.

    ``is_word`` marks word bytes (256 booleans). Byte 0 parts the texts and is never a word byte."""

    BLOCK = 1 << 16

    def __init__(self, texts: list[bytes | None], is_word: np.ndarray, lower: bool = True):
        data = b"\0".join(t or b"" for t in texts)
        self.data = data.translate(LOWER) if lower else data
        self.bytes = np.frombuffer(self.data, np.uint8)
        mask = np.zeros(len(self.bytes) + 2, bool)
        mask[1:-1] = is_word[self.bytes]
        edges = np.flatnonzero(mask[1:] != mask[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.start, side="right")
        #: Words before each text, and after the last.
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.n = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (or of its bytes up to ``end``), from prefix sums; temporaries stay at a block of
        words."""
        ends = self.end if end is None else end
        out = np.empty(self.n, np.uint64)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        for lo in range(0, self.n, self.BLOCK):
            hi = min(self.n, lo + self.BLOCK)
            at = self.start[lo]
            seg = self.bytes[at : self.end[hi - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(seg * _powers_to(len(seg)), out=sums[1:])
            s, e = self.start[lo:hi] - at, ends[lo:hi] - at
            down = np.full(len(seg) + 1, inverse, np.uint64)
            down[0] = 1
            down = np.cumprod(down)
            out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        return out

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode("utf-8", "replace")
