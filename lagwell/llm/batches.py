"""Arrow batches as NumPy views: bytes, words, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at once; bounds the memory of the vectors below, not what is read.
CHUNK_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def texts(column: pa.Array) -> pa.Array:
    """The column as large strings with NULL as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``most`` bytes of text; a longer row is a run of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def with_text(part: pa.RecordBatch, text: list[str | None], sizes: dict[int, int]) -> pa.RecordBatch:
    """The rows with another ``text``, and another ``n_chars`` where that column is there and ``sizes`` names the row."""
    columns = {f.name: part.column(f.name) for f in part.schema}
    columns["text"] = pa.array(text, part.schema.field("text").type)
    if "n_chars" in columns and sizes:
        known = columns["n_chars"].to_pylist()
        for i, n in sizes.items():
            known[i] = n
        columns["n_chars"] = pa.array(known, part.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts travel to Python in batches of so many rows at most, so that a few megabytes stand on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory to the system; several workers share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i holds bytes[offsets[i]:offsets[i + 1]]."""
    column = texts(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(0, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(self.n - 1, x, U)])) for x in (self.base, self.inverse))
        return self.up, self.down


POWERS = Powers(_BASE)
POWERS2 = Powers(0xD1342543DE82EF95)


def prefix_hash(symbols: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """H with H[j] - H[i] the polynomial of symbols[i:j], times base**i."""
    up, _ = powers.of(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum((symbols.astype(U) + U(1)) * up[: len(symbols)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """A 64-bit hash of each symbols[start:end], wherever it stands."""
    _, down = powers.of(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of ``[^\\x20\\x09-\\x0D]+``, and for each row the index of its first word (one more at the end)."""
    ink = ~_WHITE[data]
    before = np.concatenate([np.zeros(1, bool), ink[:-1]]) if len(ink) else ink.copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.concatenate([ink[1:], np.zeros(1, bool)]) if len(ink) else ink.copy()
    after[edges - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of each run of ``k`` words within one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * U(0xFF51AFD7ED558CCD) + hashes[j : j + n])
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    keep = np.arange(n) + k <= row_end
    return np.flatnonzero(keep), out[keep]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (data & 0xC0) != 0x80
