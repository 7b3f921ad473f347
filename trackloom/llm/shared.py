"""Helpers that the operators share: Arrow text blocks, word hashes.

The numpy helpers work on the raw buffers of an Arrow string column. A block holds whole texts of about
``BLOCK_BYTES`` together (a longer text is a block of its own), so the memory of a task follows the block, not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stow

BLOCK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
PLACE = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
GRAM = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space (space, tab to carriage return).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Words of a-z, 0-9 and any non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


#: Rows of an Arrow batch: whole texts of a few kilobytes, and some much longer, pass through it.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for tables of texts: each task holds a batch several times, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond it Spark's own choice (a shuffled join) stands.

    For tables of a few numbers or short keys a row, so that the rows bound the bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of a hash over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of its texts in them) for blocks of whole texts; null counts as empty."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind, width = pa.large_binary(), np.int64
    else:
        kind, width = pa.binary(), np.int32
    col = pc.fill_null(col.cast(kind), b"") if col.null_count else col
    if not len(col):
        return
    _, where, what = col.buffers()
    offsets = np.frombuffer(where, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(col))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a block: start and end bytes, 64-bit hashes, and first[i]:first[i + 1] for the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashes: bool = True):
        low = LOWER[data]
        word = kind[low]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edges = offsets[1:-1]  # texts lie side by side: a word ends with its text
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = word[edges]
        end[edges - 1] = word[edges - 1]
        self.low, self.starts, self.ends = low, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            self.hashes = self._hashes(word)

    def _hashes(self, word: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        skip = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(skip, size)
        value = BYTE_CODE[self.low[word]] * PLACE[place & 4095] * (2 * (place >> 12) + 1).astype(np.uint64)
        return mix(np.add.reduceat(value, skip) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words that begin at each word, and whether such a run ends within the text."""
        return grams(self.hashes, n), fits(self.first, n)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(len(h), np.uint64)
    out = np.zeros(len(h), np.uint64)
    for j in range(n):
        out[: len(h) - n + 1] += h[j : len(h) - n + 1 + j] * GRAM[j % 64] * np.uint64(2 * (j // 64) + 1)
    return mix(out)


def fits(first: np.ndarray, n: int) -> np.ndarray:
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(len(last)) + n <= last


def list_column(values: np.ndarray, counts, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))
