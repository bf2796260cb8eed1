"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch_path

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as a table in the shared folder and read again.

    The files live until the driver ends, since results that read them are lazy.
    """
    spark = df.sparkSession
    free_shuffles(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's cleaner delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[str, dict] = {}


def hold(owner: str, cache: dict) -> None:
    """Names a cache that an operator keeps in a worker between its tasks."""
    _HELD[owner] = cache


def release_others(owner: str) -> None:
    """Empties what other operators keep in this worker: Spark uses a worker for the tasks of all of them."""
    for name, cache in _HELD.items():
        if name != owner and cache:
            cache.clear()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8_blocks(arr: pa.Array | pa.ChunkedArray, max_bytes: int = 2 << 20):
    """Rows of a string or binary column as blocks of about max_bytes: (first row, bytes, offsets).

    bytes is a zero-copy uint8 view; offsets has a row's start at i and its end at i + 1, counted
    from the block's first byte. A row longer than max_bytes is a block by itself. Null is empty.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        arr = arr.cast(pa.large_binary())
    elif pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_table(seed: int) -> np.ndarray:
    """256 random odd 64-bit values, the same on every machine."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the polynomial base modulo 2**64, or of its inverse."""
    key = "i" if inverse else "b"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = _INVERSE if inverse else _BASE
        np.multiply.accumulate(have, out=have)
        if size > 2 << 20:
            return have[:n]
        _POWERS[key] = have
    return have[:n]


def prefix_hashes(coded: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of coded[j] * base**j for j < i; span_hashes() reads any span from it."""
    out = np.zeros(len(coded) + 1, np.uint64)
    np.cumsum(coded * powers(len(coded)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end), equal for equal contents wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]


#: A word is a run of ASCII letters and digits and of non-ASCII characters, in lower case.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD_CODE = byte_table(5)


def word_blocks(arr: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20, digests: bool = False):
    """Texts as word hashes, in blocks of rows: (first row, hashes, bounds), and with digests a fourth value.

    hashes has a 64-bit value a word, equal for equal words; bounds[i] to bounds[i + 1] are row i's. A row's digest
    is 128 bits of BLAKE2b over its words themselves, joined by spaces.
    """
    import pyarrow.compute as pc

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    for first, data, offsets in utf8_blocks(pc.utf8_lower(arr), max_bytes):
        n = len(data)
        if not n:
            none = (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
            yield (first, *none, [_digest(b"")] * (len(offsets) - 1)) if digests else (first, *none)
            continue
        inside = _WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        begins = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        hashes = mix64(span_hashes(prefix_hashes(_WORD_CODE[data]), begins, ends))
        if not digests:
            yield first, hashes, np.searchsorted(begins, offsets)
            continue
        keep = inside | (before & ~edge[:-1])  # words, and what comes right after a word
        plain, cuts = np.where(inside, data, 32)[keep].astype(np.uint8), np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
        own = [_digest(plain[a:b].tobytes().rstrip(b" ")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield first, hashes, np.searchsorted(begins, offsets), own


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word (the last k - 1 are left out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15) ^ (out >> np.uint64(29))
    return mix64(out)
