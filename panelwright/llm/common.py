"""Helpers shared by the operators: shared folders, cut lineages, and vectorised words.

Words are maximal runs of bytes other than space and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 character, so words are found in the Arrow buffer itself, without one Python
object per word. A word is known by a 64-bit hash of its bytes that is the same in every task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 4 << 20
_FALLBACK: dict[str, str] = {}


# --- shared storage --------------------------------------------------------------------------

def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _FALLBACK.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="panelwright-llm-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once and return a scan of it; a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given helper names, each lengthened until it clashes with no column of the table (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


# --- words -----------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SEED = np.random.RandomState(20_011)
_BYTE = (_SEED.randint(0, 2**32, 256, dtype=np.uint64) << np.uint64(32)) | _SEED.randint(0, 2**32, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE = (_BASE & ~7) | 5
_POWERS: list[np.ndarray] = []
END = np.uint64(0x0123456789ABCDEF)  # the end token: no word's bytes are known to hash to it


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that near inputs have unlike hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of some texts, in order: hash, byte span, and first[i]:first[i+1] the words of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(texts, lower: bool = False) -> Words:
    """All words of a string column. lower: A-Z count as a-z."""
    data, offsets = text_buffer(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    word = ~_SPACE[data]
    edge = offsets[offsets < n]
    opens = np.empty(n, bool)
    opens[0] = True
    np.logical_not(word[:-1], out=opens[1:])
    opens[edge] = True
    opens &= word
    closes = np.empty(n, bool)
    closes[-1] = True
    np.logical_not(word[1:], out=closes[:-1])
    closes[edge[edge > 0] - 1] = True
    closes &= word
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    del opens, closes, word
    table, hashes, i = _BYTE_LOWER if lower else _BYTE, np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
        low, high = start[i], end[j - 1]
        power, inverse = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power[:high - low], out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        hashes[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return Words(hashes, start, end, np.searchsorted(start, offsets), data, offsets)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about `size` bytes together (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `size` words in a text and the place of its first word; a text of fewer words has one window, all of it."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = np.cumprod(np.full(size, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    last = np.repeat(w.first[1:], w.count)  # end of the text of each word
    place = np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        inside = place + k < last
        at = np.minimum(place + k, n - 1)
        total += np.where(inside, w.hash[at], np.uint64(0)) * factor[k]
    begins = np.repeat(w.first[:-1], w.count)
    keep = (place + size <= last) | (place == begins)
    return mix(total[keep]), place[keep]


def long_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """array<long> column from flat values and the bounds of each row."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
