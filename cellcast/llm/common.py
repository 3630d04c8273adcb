"""Shared pieces: Arrow batch settings, tables in the shared folder, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellcast.sources.scratch import shared_folder

#: Python workers receive batches of at most this many rows and about this many bytes.
BATCH_ROWS = 2_000
BATCH_BYTES = 2 << 20

def return_freed_memory() -> None:
    """Let freed blocks go back to the system: workers live through many stages and tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_MUL = np.uint64(0x9E3779B97F4A7C15)
_POW = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INV = pow(_POW, -1, 1 << 64)
_CHUNK = 1 << 18

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and by bytes, as one text can be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


class SharedTables:
    """Parquet tables below the folder that ``spark.checkpoint.dir`` names.

    That folder is shared by the driver and all executors, so a table written there cuts the
    lineage and outlives a lost executor.  ``drop`` removes a table that nothing reads any more,
    ``keep`` all but the ones that a returned DataFrame still reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_folder(spark, label)
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        for name in self.names - {*names}:
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


_P = _powers(_POW, _CHUNK + 1)
_Q = _powers(_INV, _CHUNK + 1)


def bits_at(marks: np.ndarray, slot: np.ndarray, slot_bits: int) -> np.ndarray:
    """Which of the slots a bitmap of ``2 ** slot_bits`` bits marks."""
    slot = slot & np.uint64((1 << slot_bits) - 1)
    return (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, found and hashed by numpy.

    ``first`` gives for each text the index of its first word (one more entry at the end),
    ``start``/``end`` are byte positions in ``data``, ``hash`` is a 64-bit hash of the bytes.
    A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[raw] if lower else raw
        n = len(self.data)
        word = ~_WHITE[self.data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] if n else opens[1:]
        closes[:-1] &= ~word[1:] if n else closes[:-1]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(out):
                base = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.end, base + _CHUNK, side="right")))
                size = int(self.end[j - 1] - base)
                p, q = (_P, _Q) if size <= _CHUNK else (_powers(_POW, size + 1), _powers(_INV, size + 1))
                sums = np.zeros(size + 1, np.uint64)
                np.cumsum((self.data[base : base + size].astype(np.uint64) + np.uint64(1)) * p[:size], out=sums[1:])
                a, b = self.start[i:j] - base, self.end[i:j] - base
                out[i:j] = (sums[b] - sums[a]) * q[a] + (b - a).astype(np.uint64) * _MUL
                i = j
        return mix(out)

    def code_points(self) -> np.ndarray:
        """Code points before each byte position: a running count without continuation bytes."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(m, n, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(_POW) + words[k : k + m]
    return mix(acc)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            done = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    return_freed_memory()
