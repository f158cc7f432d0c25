"""Shared helpers of the training-data operators: stored tables, Arrow text chunks, word tables."""

from __future__ import annotations

import contextlib
import hashlib
import io
import os
import uuid
import weakref
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, drop_at_exit, tables_dir

#: Bytes of text that one numpy pass works on at a time (a longer single text is its own chunk).
CHUNK_BYTES = 2 << 20

#: Bytes up to which a string is hashed in step with others.
FOLDED = 256

#: The white space that separates words: space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application (they may not share its
    folder): a zip file in the shared folder, which Spark fetches from there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc = spark.sparkContext
        path = f"{checkpoint_dir(spark).rstrip('/')}/{app}/arledger-sources.zip"
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(path)
        _SHIPPED.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder of ``spark.checkpoint.dir`` and return a scan of
    it: lineage is cut, two readers see the same rows, and a lost executor loses nothing. The table goes when it is
    freed, or when the application ends."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    drop_at_exit(spark)
    scan = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(scan)] = (weakref.ref(scan), path)
    for paths in _WATCHED:
        paths.append(path)
    return scan


#: Where stored tables are, by their scans; and the lists of those that ``temporaries`` notes down.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}
_WATCHED: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(*scans: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more (other frames are left alone)."""
    for scan in scans:
        of, path = _PATHS.pop(id(scan), (None, None))
        if of is not None and of() is scan:
            _delete(scan.sparkSession, path)


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that were stored inside but the last: the one that holds the result."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield
    finally:
        _WATCHED.remove(paths)
        for path in paths[:-1]:
            _delete(spark, path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the named columns, under new names (other columns can't clash)."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def plus(df: DataFrame, name: str, column) -> DataFrame:
    """``df`` with ``name`` set to ``column``; an old column of that name is replaced."""
    return df.select(*[df[c] for c in df.columns if c.lower() != name.lower()], column.alias(name))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column (no decoding)."""
    return column.cast(pa.large_binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one of them."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def lined_up(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and where each begins."""
    lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    joined = b"\n".join([t or b"" for t in texts]) + b"\n"
    return np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)


def per_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each text of ``lined_up``."""
    return np.add.reduceat(flags.view(np.uint8) if flags.dtype == bool else flags, begins, dtype=np.int64)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of True."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def exact_ids(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids of the byte strings that lie back to back in ``data``: equal id = equal bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def word_table(data: np.ndarray, white: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the words between ``white`` bytes: exact ids, number per text, begin of each in ``data``, ids in use."""
    starts, ends = spans(~white)
    ids, used = exact_ids(data[~white], ends - starts) if len(starts) else (np.zeros(0, np.int64), 0)
    flags = np.zeros(len(data), bool)
    flags[starts] = True
    return ids, per_text(flags, begins), starts, used


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit integers (wrapping arithmetic)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]``, folded over blocks of eight bytes (BLAKE2b beyond ``FOLDED``
    bytes): equal bytes give equal hashes wherever they lie, so strings of unequal hashes are different."""
    left = (ends - starts).astype(np.int64)
    out = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(left > FOLDED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        left[i] = 0
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at = np.flatnonzero(left > 0), starts.astype(np.int64).copy()
    while len(live):
        unused = (8 * (8 - np.minimum(left[live], 8))).astype(np.uint64)
        block = (eights[at[live]] << unused) >> unused
        out[live] = mix64((out[live] * np.uint64(0x9E3779B97F4A7C15)) ^ block)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return out
