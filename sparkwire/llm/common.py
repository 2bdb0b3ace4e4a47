"""Shared pieces: shared-folder tables, Arrow text kernels, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Modulus of the polynomial hash, a Mersenne prime (no text has a structure that makes it collide, as texts have modulo 2^64), its base and that one's inverse.
PRIME = (1 << 61) - 1
BASE = 0x1E3779B97F4A7C15 % PRIME
BASE_INV = pow(BASE, -1, PRIME)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine (master local) a new local folder, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkwire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tidy() -> None:
    """Give memory that this process no longer uses back to the machine: the driver, and workers that are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkwire-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, names: list[str]) -> str:
    """`name`, or a longer one that no column has."""
    while name in names:
        name += "_"
    return name


def columns_by_position(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with unique names c0, c1, ... and its own names: repeated names do no harm."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with columns c0, c1, ... for its own, whatever their names, and id_, text, key1_ and key2_ (hashes of both)."""
    flat, names = columns_by_position(docs)
    i, t = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    return flat.withColumns({"id_": i, "text": t, "key1_": F.xxhash64(i, t), "key2_": F.xxhash64(F.lit(1), t, i)})


def keep_keys(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Of keyed() rows those whose keys are among `keys`, one for each, under their own names."""
    one = rows.dropDuplicates(["key1_", "key2_"]).join(keys, ["key1_", "key2_"])
    return one.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def byte_slices(batch: pa.RecordBatch, text_at: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about max_bytes of text; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    offsets = text_offsets(batch.column(text_at))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def text_offsets(arr: pa.Array) -> np.ndarray:
    buf = arr.buffers()[1]
    if buf is None:
        return np.zeros(len(arr) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(buf, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins (a null counts as empty)."""
    if arr.null_count:
        arr = arr.fill_null("")
    offsets = text_offsets(arr)
    buf = arr.buffers()[2]
    data = np.zeros(0, np.uint8) if buf is None else np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def map_text(
    df: DataFrame,
    kernel: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    text_col: str = "text",
    carry: list[str] | None = None,
    max_bytes: int = 1 << 20,
) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches of about max_bytes of text.

    kernel() is made once for each task; it maps an array of texts to one array for each field. `carry`
    names the columns kept (default: all). A column that has the name of a result gives way to it.
    """
    spark = df.sparkSession
    limit_batches(spark)
    flat, names = columns_by_position(df)
    text_at = names.index(text_col)
    keep = [i for i, n in enumerate(names) if carry is None or n in carry]
    used = [*keep, *([] if text_at in keep else [text_at])]
    where, k = used.index(text_at), len(keep)
    out_schema = T.StructType([T.StructField(f"c{i}", flat.schema[f"c{i}"].dataType) for i in keep] + [T.StructField(f"r{j}", f.dataType) for j, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        labels = [f.name for f in out_schema]
        for batch in batches:
            for part in byte_slices(batch, where, max_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *work(part.column(where))], names=labels)
        tidy()

    out = flat.select(*[f"c{i}" for i in used]).mapInArrow(run, out_schema)
    made = {f.name for f in fields}
    return out.select(*[F.col(f"c{i}").alias(names[i]) for i in keep if names[i] not in made], *[F.col(f"r{j}").alias(f.name) for j, f in enumerate(fields)])


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, for the session; a setting made by the user stays."""
    own = spark.conf.getAll() if callable(spark.conf.getAll) else spark.conf.getAll
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if key not in own:
            spark.conf.set(key, str(most))


# ---------------------------------------------------------------- hashing

_powers: dict[str, np.ndarray] = {}
_P, _M31, _M30, _M29 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1), U64((1 << 29) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, from 31-bit halves."""
    a1, a0, b1, b0 = a >> U64(31), a & _M31, b >> U64(31), b & _M31
    mid = a0 * b1 + a1 * b0
    return _fold(((a1 * b1) << U64(1)) + (mid >> U64(30)) + ((mid & _M30) << U64(31)) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo PRIME for i < n (kept, and grown by need)."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INV)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                out[done : 2 * done] = times(out[:done], U64(pow(base, done, PRIME)))
                done *= 2
            _powers[key] = out
    return _powers["up"], _powers["down"]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A fixed random value below 2^30 for each byte.
BYTE_VALUES = splitmix((np.arange(256, dtype=U64) + U64(1)) * U64(BASE)) >> U64(34)
_RUN = 1 << 15


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo PRIME, one longer than the symbols; see span_hash. Bytes stand for their BYTE_VALUES, 64-bit
    symbols for themselves. Values may exceed PRIME by a little."""
    n, short = len(symbols), symbols.dtype == np.uint8
    up, _ = powers(n + 1)
    out = np.zeros(n + 1, U64)
    for k in range(0, n, _RUN):
        x, y = symbols[k : k + _RUN], up[k : min(k + _RUN, n)]
        if short:
            x = BYTE_VALUES[x]
            m = x * (y >> U64(31))
            x = (m >> U64(30)) + ((m & _M30) << U64(31)) + x * (y & _M31)
        else:
            x = times(_fold(x), y)
        low, high = np.cumsum(x & U64(0xFFFFFFFF)), np.cumsum(x >> U64(32))
        # a sum of high halves, below 2^47, times 2^32: its bits from 29 on come back as ones
        high = ((high & _M29) << U64(32)) + (high >> U64(29)) + low + out[k]
        out[k + 1 : k + 1 + len(x)] = (high & _P) + (high >> U64(61))
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A position-free hash, below PRIME, of each span [begin, end)."""
    _, down = powers(len(prefix))
    return times(_fold(prefix[end] + (U64(2 * PRIME) - prefix[begin])), down[begin])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a run ends where a text begins (`starts`: offsets of texts)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = starts[(starts > 0) & (starts < n)]
    before[cut] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return begin, np.flatnonzero(inside & ~after) + 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
