"""Shared helpers of the corpus operators: shared-folder tables and hashed words of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark) -> None:
    """Small Arrow batches, so that what a task holds outside the heap doesn't hang on how long its texts are. A session
    that has set the size itself keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


#: What a broadcast table may hold; larger ones are joined by sort-merge.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df, row_bytes: int = 64):
    """df, marked for broadcasting if its rows (of a table of materialize(), so counting is cheap) fit BROADCAST_BYTES."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def scratch_dir(spark) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset: a temporary one if driver and executors are one
    process (local master), else an error, as no machine-local folder would do."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: the corpus operators need a folder that driver and executors share")
        where = getattr(spark, "_arterial_scratch", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="arterial-")
            spark._arterial_scratch = where
    return where.rstrip("/")


def new_path(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/arterial/{name}-{uuid.uuid4().hex}"


def materialize(spark, df, name: str):
    """Write df as Parquet in the shared folder and reread it: cuts lineage and survives lost executors."""
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arterial_path = path
    return out


def attach(df, *things):
    """df, with broadcasts and tables of materialize() that it reads and that are of no use after it."""
    df._arterial_spent = [*getattr(df, "_arterial_spent", []), *things]
    return df


def release(spark, df) -> None:
    """Give back what was attached to df, once its rows are written."""
    for thing in getattr(df, "_arterial_spent", []):
        if hasattr(thing, "destroy"):
            thing.destroy()
        else:
            discard(spark, thing)
    df._arterial_spent = []


def discard(spark, *frames) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        path = getattr(df, "_arterial_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def partitions_for(spark, least: int = 1) -> int:
    """Number of shuffle partitions that the session is set up for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quiet_worker(keep: int = 1 << 21) -> None:
    """One thread per Python worker: Spark's tasks are the parallelism. Memory freed by earlier tasks goes back to the system,
    and so do arrays of more than `keep` bytes as soon as they are freed; Arrow takes its memory from where it can go back."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, keep)  # M_MMAP_THRESHOLD, else it rises with use
        libc.mallopt(-1, 2 * keep)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


# ---------------------------------------------------------------------------------------------------------------
# words of an Arrow text column as 64-bit hashes, without a Python object per word

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True
#: What is a word: runs without ASCII white space, or runs of letters, digits and non-ASCII characters.
WORDS = {"space": _SPACE, "alnum": _ALNUM}
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (int(n) - 1).bit_length()
        for k, base in enumerate((_MULT, pow(_MULT, -1, 2**64))):
            a = np.full(size, U64(base & 0xFFFFFFFFFFFFFFFF), U64)
            a[0] = U64(1)
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_column(column, lower: bool = True) -> pa.Array:
    """A null-free (null: empty), optionally lower-case, large_string array without chunks."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    return pc.utf8_lower(arr) if lower else arr


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and n + 1 offsets."""
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(arr: pa.Array, most: int = 1 << 20):
    """(first, after last) of runs of texts of about `most` bytes; a longer text is a run of its own, never cut."""
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    first = 0
    while first < len(arr):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + 2048, len(arr))
        yield first, last
        first = last


def word_spans(buf: np.ndarray, offsets: np.ndarray, words: str = "space"):
    """(start, end) byte positions of all words, and the text of each."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORDS[words][buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray, words: str = "space"):
    """64-bit hash of each word, the text of each word, and word counts by text."""
    starts, stops, doc = word_spans(buf, offsets, words)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, U64), doc, counts
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[stops] - total[starts]) * inverse[starts]), doc, counts


def word_list(text: str, words: str = "space") -> list[str]:
    """The same words as Python strings (lower case), for checks of single passages."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    starts, stops, _ = word_spans(raw, np.array([0, len(raw)]), words)
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
